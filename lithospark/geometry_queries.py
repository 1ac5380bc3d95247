"""Queries of surfaces, meshes, thinned neighbors, variogram maps and their models, imputation, cokriging, wavelets and forests; in the same registry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lithospark.more_queries import QUERIES, SQL
from lithospark.operators import cokriging, filters, fitting, forests, frame, grids, horizons, imputation, markov, mesh, sections, spatial, wavelets
from lithospark.queries import _GRID, _PS, _PT, _SEG, _SEQ, _exp, _ftm, _horizons, query, rounded
from lithospark.sources import tables as T
from lithospark.spec import GridSpec, Structure, VariogramModel

__all__ = ["QUERIES", "SQL"]

# --- lines through surfaces: four intervals a customer, bent and with gaps, through the surface of order prices
_WELL = """w AS (SELECT c_custkey AS hole, n AS seq, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS cx, CAST(c_custkey * 53 % 137 AS DOUBLE) / 10 AS cy, CAST(c_custkey % 9 - 4 AS DOUBLE) / 3 + 0.0625 AS sx, CAST(c_custkey % 5 - 2 AS DOUBLE) / 3 + 0.03125 AS sy,
  CAST(1.75 AS DOUBLE) - CAST(c_custkey % 4 AS DOUBLE) / 4 AS bz, CASE WHEN c_custkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS gap, CASE WHEN (c_custkey + n) % 11 <> 0 THEN CAST((c_custkey + n * n) % 4 AS INTEGER) END AS cat FROM customer, range(0, 4) t(n)),
g AS (SELECT hole, seq, cat, cx + sx * seq AS x0, cy + sy * seq AS y0, bz - 2 * seq AS z0, cx + sx * (seq + 1) - sx * gap / 2 AS x1, cy + sy * (seq + 1) - sy * gap / 2 AS y1, bz - 2 * (seq + 1) + gap AS z1 FROM w)"""
_LINES = "l AS (SELECT hole, seq, false AS gap, x0, y0, z0, x1, y1, z1 FROM g UNION ALL SELECT * FROM (SELECT hole, seq, true, lag(x1) OVER q AS x0, lag(y1) OVER q AS y0, lag(z1) OVER q AS z0, x0 AS x1, y0 AS y1, z0 AS z1 FROM g WINDOW q AS (PARTITION BY hole ORDER BY seq)) WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2) > 0)"


def _crossing_sql(name: str, z: str) -> str:
    """CTE name(hole, seq, gap, t, x, y, z): every line against every square under its box."""
    return f"""{name}_s AS (SELECT o_orderkey % 100 AS i, o_orderkey // 100 AS j, {z} AS z FROM orders WHERE {z} IS NOT NULL),
{name}_q AS (SELECT a.i, a.j, a.z AS z00, b.z AS z10, c.z AS z01, e.z AS z11 FROM {name}_s a JOIN {name}_s b ON b.i = a.i + 1 AND b.j = a.j JOIN {name}_s c ON c.i = a.i AND c.j = a.j + 1 JOIN {name}_s e ON e.i = a.i + 1 AND e.j = a.j + 1),
{name}_m AS (SELECT l.*, low, x0 - 0.5 - i AS u0, x1 - 0.5 - i AS u1, y0 - 0.5 - j AS v0, y1 - 0.5 - j AS v1, z00, z10, z01, z11
  FROM l JOIN {name}_q q ON q.i BETWEEN floor(least(x0, x1) - 0.5) - 1 AND floor(greatest(x0, x1) - 0.5) + 1 AND q.j BETWEEN floor(least(y0, y1) - 0.5) - 1 AND floor(greatest(y0, y1) - 0.5) + 1, (VALUES (true), (false)) k(low)),
{name}_f AS (SELECT *, z0 - CASE WHEN low THEN z00 + u0 * (z10 - z00) + v0 * (z11 - z10) ELSE z00 + v0 * (z01 - z00) + u0 * (z11 - z01) END AS f0, z1 - CASE WHEN low THEN z00 + u1 * (z10 - z00) + v1 * (z11 - z10) ELSE z00 + v1 * (z01 - z00) + u1 * (z11 - z01) END AS f1 FROM {name}_m),
{name}_t AS (SELECT *, CASE WHEN f0 <> f1 THEN f0 / (f0 - f1) END AS t FROM {name}_f),
{name}_h AS (SELECT hole, seq, gap, t, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y, z0 + t * (z1 - z0) AS z FROM {name}_t
  WHERE t BETWEEN 0 AND 1 AND least(u0 + t * (u1 - u0), v0 + t * (v1 - v0)) >= -1e-9 AND greatest(u0 + t * (u1 - u0), v0 + t * (v1 - v0)) <= 1 + 1e-9 AND CASE WHEN low THEN 1 ELSE -1 END * (u0 + t * (u1 - u0) - v0 - t * (v1 - v0)) >= -1e-9
  QUALIFY coalesce(t - lag(t) OVER (PARTITION BY hole, seq, gap ORDER BY t) > 1e-9, true)),
{name} AS (SELECT * FROM {name}_h WINDOW q AS (PARTITION BY hole ORDER BY seq, gap DESC, t) QUALIFY coalesce(sqrt((x - lag(x) OVER q) ** 2 + (y - lag(y) OVER q) ** 2 + (z - lag(z) OVER q) ** 2) > 1e-9, true))"""


_TOP_Z, _BASE_Z = "CASE WHEN o_orderkey % 7 <> 0 THEN -o_totalprice / 100000 END", "-o_totalprice / 100000 - 2 - o_orderkey % 3"


def _wells(s, d):
    c, n = F.col("c_custkey"), F.col("n")
    rows = T.table(s, d, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, range(4)))).alias("n"))
    rows = rows.select(
        c.alias("hole"), n.alias("seq"), ((c * 37 % 1000) / 10).alias("bx"), ((c * 53 % 137) / 10).alias("by"), ((c % 9 - 4) / 3 + 0.0625).alias("sx"), ((c % 5 - 2) / 3 + 0.03125).alias("sy"),
        (1.75 - (c % 4) / 4).alias("bz"), F.when(c % 3 == 0, 0.5).otherwise(0.0).alias("gap"), F.when((c + n) % 11 != 0, ((c + n * n) % 4).cast("int")).alias("cat"))
    bx, by, sx, sy, bz, gap, seq = map(F.col, ("bx", "by", "sx", "sy", "bz", "gap", "seq"))
    ends = [(bx + sx * seq).alias("x0"), (by + sy * seq).alias("y0"), (bz - 2 * seq).alias("z0"), (bx + sx * (seq + 1) - sx * gap / 2).alias("x1"), (by + sy * (seq + 1) - sy * gap / 2).alias("y1"), (bz - 2 * (seq + 1) + gap).alias("z1")]
    return rows.select("hole", "seq", "cat", *ends)


def _surfaces(s, d):
    g, k = T.table(s, d, "orders"), F.col("o_orderkey")
    z = -F.col("o_totalprice") / 100000
    place = [(k % 100).cast("int").alias("i"), F.floor(k / 100).cast("int").alias("j")]
    spec = GridSpec(100, g.agg(F.max(F.floor(k / 100))).first()[0] + 1)
    return g.select(*place, F.when(k % 7 != 0, z).alias("z")), g.select(*place, (z - 2 - k % 3).alias("z")), spec


@query("J14_intersect_horizon", f"WITH {_WELL}, {_LINES}, {_crossing_sql('hit', _TOP_Z)} SELECT hole, CAST(seq AS INTEGER) AS seq, gap, round(t, 6) AS t, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM hit")
def j14(s, d):
    top, _, spec = _surfaces(s, d)
    return rounded(horizons.hole_crossings(_wells(s, d), top, spec), "t", "x", "y", "z")


_BOUNDS = f"""{_WELL}, {_LINES}, {_crossing_sql('hit', _TOP_Z)}, {_crossing_sql('hib', _BASE_Z)},
e AS (SELECT hole, max(greatest(z0, z1)) AS high, min(least(z0, z1)) AS low, arg_min(x0, seq) AS hx, arg_min(y0, seq) AS hy, arg_min(z0, seq) AS hz, arg_max(x1, seq) AS tx, arg_max(y1, seq) AS ty, arg_max(z1, seq) AS tz FROM g GROUP BY hole),
nt AS (SELECT hole, count(*) AS nt, max(z) AS zt FROM hit GROUP BY hole), nb AS (SELECT hole, count(*) AS nb, max(z) AS zb FROM hib GROUP BY hole),
b AS (SELECT e.*, coalesce(nt, 0) AS nt, coalesce(nb, 0) AS nb, coalesce(zt, high) AS top, coalesce(zb, low) AS base FROM e LEFT JOIN nt USING (hole) LEFT JOIN nb USING (hole)),
o AS (SELECT b.*, coalesce((hz > ht.z AND tz > tt.z) OR (hz < hb.z AND tz < tb.z), false) AND nt = 0 AND nb = 0 AS outside FROM b
  LEFT JOIN hit_s ht ON ht.i = floor(hx) AND ht.j = floor(hy) LEFT JOIN hit_s tt ON tt.i = floor(tx) AND tt.j = floor(ty) LEFT JOIN hib_s hb ON hb.i = floor(hx) AND hb.j = floor(hy) LEFT JOIN hib_s tb ON tb.i = floor(tx) AND tb.j = floor(ty)),
bounds AS (SELECT hole, base, top FROM o WHERE nt <= 1 AND nb <= 1 AND base <= top AND NOT outside)"""


@query("C12_horizon_bounds", f"WITH {_BOUNDS} SELECT hole, round(base, 6) AS base, round(top, 6) AS top FROM bounds")
def c12b(s, d):
    return rounded(horizons.horizon_bounds(_wells(s, d), *_surfaces(s, d)), "base", "top")


@query("C12_vpc_wells", f"""WITH {_BOUNDS}, p AS (SELECT hole, cat, (least(z0, z1) - base) / (top - base) AS lo, (greatest(z0, z1) - base) / (top - base) AS hi FROM g JOIN bounds USING (hole) WHERE cat IS NOT NULL AND top > base),
c AS (SELECT hole, d, cat, sum(least(hi, d / 20.0::DOUBLE + 0.05, 1) - greatest(lo, d / 20.0::DOUBLE - 0.05, 0)) AS len FROM p, range(0, 21) t(d) WHERE least(hi, d / 20.0::DOUBLE + 0.05, 1) - greatest(lo, d / 20.0::DOUBLE - 0.05, 0) > 1e-12 GROUP BY ALL),
f AS (SELECT cat, count(*) / sum(count(*)) OVER () AS p FROM g WHERE cat IS NOT NULL GROUP BY cat),
s AS (SELECT hole, d, cat, len / sum(len) OVER (PARTITION BY hole, d) AS p FROM c UNION ALL SELECT hole, d, cat, p FROM (SELECT hole, d FROM bounds, range(0, 21) t(d) WHERE top > base EXCEPT SELECT hole, d FROM c), f)
SELECT d, cat, round(sum(p) / sum(sum(p)) OVER (PARTITION BY d), 6) AS p FROM s GROUP BY d, cat""")
def c12(s, d):
    wells = _wells(s, d)
    known = wells.where("cat IS NOT NULL")
    share = known.groupBy("cat").count().join(F.broadcast(known.agg(F.count(F.lit(1)).alias("_n")))).select("cat", (F.col("count") / F.col("_n")).alias("p"))  # one row
    curves = horizons.vpc_between(wells, horizons.horizon_bounds(wells, *_surfaces(s, d)), 20, 0.1, share)
    return rounded(markov.vpc_mean(curves), "p")


# --- places in a mesh whose pillars are vertical, for which SQL interpolates the layers' triangles
_INSIDE = """h AS (SELECT CAST(o_orderkey % 100 AS INTEGER) AS i, CAST(o_orderkey // 100 AS INTEGER) AS j, -o_totalprice / 1000000 AS top, -o_totalprice / 1000000 - 5 - CAST(o_orderkey % 3 AS DOUBLE) / 10 AS base FROM orders),
p AS (SELECT c_custkey AS row_id, CAST((c_custkey * c_custkey * 31 + c_custkey * 7919) % 1009 AS DOUBLE) / 10 + 0.03 AS x, CAST((c_custkey * c_custkey * c_custkey * 17 + c_custkey * 104729) % 157 AS DOUBLE) / 10 + 0.01 AS y, -CAST(c_custkey % 61 AS DOUBLE) / 10 AS z FROM customer),
q AS (SELECT row_id, x, y, z, CAST(floor(x - 0.5) AS INTEGER) AS i, CAST(floor(y - 0.5) AS INTEGER) AS j FROM p),
c AS (SELECT q.*, k, x - 0.5 - q.i AS fx, y - 0.5 - q.j AS fy, a.base + (k + n) / 4 * (a.top - a.base) AS z0, b.base + (k + n) / 4 * (b.top - b.base) AS z1, e.base + (k + n) / 4 * (e.top - e.base) AS z2, f.base + (k + n) / 4 * (f.top - f.base) AS z3, n
  FROM q JOIN h a ON a.i = q.i AND a.j = q.j JOIN h b ON b.i = q.i + 1 AND b.j = q.j JOIN h e ON e.i = q.i + 1 AND e.j = q.j + 1 JOIN h f ON f.i = q.i AND f.j = q.j + 1, range(0, 4) t(k), range(0, 2) u(n)),
m AS (SELECT l.row_id, l.x, l.y, l.z, l.i, l.j, CAST(l.k AS INTEGER) AS k, l.fx, l.fy, l.z0, l.z1, l.z2, t.z0 AS z4, t.z2 AS z6, t.z3 AS z7,
  CASE WHEN l.fx + l.fy <= 1 THEN l.z0 + l.fx * (l.z1 - l.z0) + l.fy * (l.z3 - l.z0) ELSE l.z2 + (1 - l.fx) * (l.z3 - l.z2) + (1 - l.fy) * (l.z1 - l.z2) END AS low,
  CASE WHEN t.fx >= t.fy THEN t.z0 + t.fx * (t.z1 - t.z0) + t.fy * (t.z2 - t.z1) ELSE t.z0 + t.fy * (t.z3 - t.z0) + t.fx * (t.z2 - t.z3) END AS high
  FROM c l JOIN c t ON t.row_id = l.row_id AND t.k = l.k AND l.n = 0 AND t.n = 1),
inside AS (SELECT * FROM m WHERE z BETWEEN low - 1e-12 AND high + 1e-12 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY k, j, i) = 1)"""


def _asked(s, d):
    c = F.col("c_custkey")
    m, n = c % 1009, c % 157  # of remainders: cubes of large keys overflow
    return T.table(s, d, "customer").select(c.alias("row_id"), ((m * m * 31 + m * 7919) % 1009 / 10 + 0.03).alias("x"), ((n * n * n * 17 + n * 104729) % 157 / 10 + 0.01).alias("y"), (-(c % 61) / 10).alias("z"))


def _meshed(s, d):
    top = -F.col("o_totalprice") / 1000000
    h = T.table(s, d, "orders").select((F.col("o_orderkey") % 100).cast("int").alias("i"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("j"), top.alias("top"), (top - 5 - F.col("o_orderkey") % 3 / 10).alias("base"))
    h = h.withColumns({"x": F.col("i") + 0.5, "y": F.col("j") + 0.5})
    ni, nj = h.agg(F.max("i"), F.max("j")).first()
    return mesh.cells(mesh.vertices(mesh.near(h, _asked(s, d), 1.0), 4)), (ni, nj, 4)


@query("J13_locate", f"WITH {_INSIDE} SELECT row_id, i, j, k FROM inside")
def j13(s, d):
    return mesh.locate(_asked(s, d), _meshed(s, d)[0], 1.0).select("row_id", "i", "j", "k")


_FAR = {"d0": "abs(z - z0 - fx * (z1 - z0) - fy * (z2 - z1)) / sqrt(1 + (z1 - z0) ** 2 + (z2 - z1) ** 2)", "d1": "abs(z - z4 - fy * (z7 - z4) - fx * (z6 - z7)) / sqrt(1 + (z7 - z4) ** 2 + (z6 - z7) ** 2)"}


@query("G17_unfold", f"WITH {_INSIDE}, n AS (SELECT max(i) AS ni, max(j) AS nj FROM h) SELECT row_id, i, j, k, round((x - 0.5) / ni, 6) AS u, round((y - 0.5) / nj, 6) AS v, round((k + d0 / (d0 + d1)) / 4, 6) AS w FROM (SELECT *, {_FAR['d0']} AS d0, {_FAR['d1']} AS d1 FROM inside), n")
def g17(s, d):
    cells, shape = _meshed(s, d)
    return rounded(mesh.unfold(_asked(s, d), cells, shape, 1.0), "u", "v", "w").select("row_id", "i", "j", "k", "u", "v", "w")


# --- neighbors at least 8 apart, walked from the nearest on
@query("J7_thin_min_distance", f"""WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT q.row_id AS a, p.row_id AS b, p.x, p.y, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d FROM q JOIN p ON abs(p.x - q.x) < 60 AND abs(p.y - q.y) < 60),
l AS (SELECT a, list({{'b': b, 'x': x, 'y': y}} ORDER BY d, b) AS l FROM n WHERE d < 60 GROUP BY a),
k AS (SELECT a, list_reduce(list_transform(l, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda f: sqrt((f.x - e[1].x) ** 2 + (f.y - e[1].y) ** 2) < 20)) = 0 THEN list_concat(acc, e) ELSE acc END) AS k FROM l)
SELECT a AS row_id_a, unnest(list_transform(k, lambda e: e.b)) AS row_id_b FROM k""")
def j7(s, d):
    return spatial.thin_neighbors(T.few_points(s, d), T.points(s, d), 60.0, 20.0, "xy")


# --- variogram maps by transforms, against sums over all pairs of cells
@query("V6_varmap_fast", f"""WITH g AS (SELECT i, j, v FROM ({_GRID}) WHERE v IS NOT NULL), n AS (SELECT 100 AS ni, max(o_orderkey // 100) + 1 AS nj FROM orders),
c AS (SELECT b.i - a.i AS di, b.j - a.j AS dj, count(*) AS n, sum(a.v * b.v) / count(*) - avg(a.v) * avg(b.v) AS cov FROM g a, g b, n WHERE b.i - a.i BETWEEN -(ni // 2) AND ni - ni // 2 - 1 AND b.j - a.j BETWEEN -(nj // 2) AND nj - nj // 2 - 1 GROUP BY ALL)
SELECT CAST(di AS INTEGER) AS di, CAST(dj AS INTEGER) AS dj, n, round((max(cov) OVER () - cov) / 1e6 + 1.7e-5, 3) AS gamma FROM c""")
def v6(s, d):
    g = T.grid(s, d)
    nj = g.agg(F.max("j")).first()[0] + 1
    out = grids.varmap_fast(g, "v", 100, nj)
    return out.select(F.col("di").cast("int").alias("di"), F.col("dj").cast("int").alias("dj"), "n", F.round(F.col("gamma") / 1e6 + 1.7e-5, 3).alias("gamma"))


@query("V7_varmap_fim", f"""WITH n AS (SELECT 100 AS ni, max(o_orderkey // 100) + 1 AS nj FROM orders), g AS (SELECT i, j, v FROM ({_GRID}) WHERE v IS NOT NULL),
c AS (SELECT (b.i - a.i + ni) % ni AS di, (b.j - a.j + nj) % nj AS dj, sum(a.v * b.v) / (any_value(ni) * any_value(nj)) AS cov FROM g a, g b, n GROUP BY ALL),
a AS (SELECT di, dj, coalesce(cov, 0) AS cov FROM (SELECT x AS di, y AS dj FROM n, range(0, 100) s(x), range(0, nj) t(y)) LEFT JOIN c USING (di, dj))
SELECT CAST(CASE WHEN di < (ni + 1) // 2 THEN di ELSE di - ni END AS INTEGER) AS di, CAST(CASE WHEN dj < (nj + 1) // 2 THEN dj ELSE dj - nj END AS INTEGER) AS dj, round((max(cov) OVER () - cov) / 1e6 + 1.7e-5, 3) AS gamma FROM a, n""")
def v7(s, d):
    g = T.grid(s, d)
    out = grids.varmap_fim(g, "v", 100, g.agg(F.max("j")).first()[0] + 1)
    return out.select(F.col("di").cast("int").alias("di"), F.col("dj").cast("int").alias("dj"), F.round(F.col("gamma") / 1e6 + 1.7e-5, 3).alias("gamma"))


# --- lost intervals filled: what is drawn has no SQL, what must hold of it has
def _filled(s, d, realizations):
    seg = T.segments(s, d)
    known = seg.where("cat IS NOT NULL")
    ftm = markov.transition_counts(seg)
    q = [k / 10 for k in range(11)]
    thick = frame.percentiles_by(known.where("z1 > z0").withColumn("length", F.col("z1") - F.col("z0")), "cat", "length", q)
    thick = thick.select("cat", F.posexplode("q").alias("k", "value")).select("cat", F.greatest("value", F.lit(1e-3)).alias("value"), (F.col("k") / 10).alias("cum"))
    lines = seg.select("row_id", "hole", (F.col("hole") % 100 + F.col("z0") / 1000).alias("x0"), (F.col("hole") % 77).cast("double").alias("y0"), "z0", (F.col("hole") % 100 + F.col("z1") / 1000).alias("x1"), (F.col("hole") % 77).cast("double").alias("y1"), "z1", "cat")
    return imputation.impute_categories(lines, ftm, thick, realizations, 7, markov.proportion_by_length(seg), ftm, 0.0, tolerance=1e-3)


@query("S5_impute_categories")
def s5(s, d):
    return _filled(s, d, 3)


@query("S5_imputed_lengths", f"WITH g AS ({_SEG}) SELECT r AS \"real\", row_id, CASE WHEN cat IS NULL THEN 1 ELSE 0 END AS imputed, CAST(cat AS INTEGER) AS known, round(z1 - z0 + 1.7e-8, 6) AS length, 0 AS breaks FROM g, range(1, 4) t(r)")
def s5l(s, d):
    from pyspark.sql import Window

    out = _filled(s, d, 3)
    by = Window.partitionBy("real", "row_id").orderBy("piece")
    out = out.withColumn("_break", F.coalesce((F.abs(F.col("z0") - F.lag("z1").over(by)) > 1e-9).cast("int"), F.lit(0)))
    same = out.groupBy("real", "row_id", "imputed").agg(F.max(F.when(F.col("imputed") == 0, F.col("cat"))).alias("known"), F.round(F.sum(F.col("z1") - F.col("z0")) + 1.7e-8, 6).alias("length"), F.sum("_break").cast("int").alias("breaks"))
    return same.select(F.col("real").cast("bigint").alias("real"), "row_id", "imputed", "known", "length", "breaks")


# --- fitting, cokriging, wavelets, trees
_CANDIDATES = [(2.0, 0.5, 0.0, 9.0), (3.0, 1.0, 30.0, 6.0), (2.5, 0.4, 90.0, 12.0)]


def _misfit_sql() -> str:
    map_sql = f"WITH g AS ({_GRID}), m AS (SELECT di, dj, CAST(round(avg((b.v - a.v) * (b.v - a.v) / 2) / 1e9, 6) AS DOUBLE) AS gamma FROM g a, range(-3, 4) s(di), range(-2, 3) t(dj), g b WHERE b.i = a.i + di AND b.j = a.j + dj AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY di, dj)"
    rows = ", ".join(f"({n}, {a}, {r}, {z}, {s})" for n, (a, r, z, s) in enumerate(_CANDIDATES))
    h = "sqrt(((di * sin(radians(z)) + dj * cos(radians(z))) / a) ** 2 + ((di * cos(radians(z)) - dj * sin(radians(z))) / (a * r)) ** 2)"
    return f"{map_sql}, c AS (SELECT *, sqrt(di * di + dj * dj) AS d, {h} AS h FROM m, (VALUES {rows}) k(candidate, a, r, z, s)) SELECT candidate, round(sum(CASE WHEN d > 0 THEN 1 / d / (6.28 * d) * (CASE WHEN h >= 1 THEN s ELSE s * (1.5 * h - 0.5 * h * h * h) END - gamma) ** 2 END), 4) AS misfit FROM c GROUP BY candidate"


def _small_map(s, d):
    return mesh.varmap(T.grid(s, d), "v", 3, 2).select("di", "dj", F.round(F.col("gamma") / 1e9, 6).alias("gamma"))


@query("V9_misfits", _misfit_sql())
def v9(s, d):
    return rounded(fitting.misfits(_small_map(s, d), np.array(_CANDIDATES), ["spherical"]), "misfit", digits=4)


@query("V9_fit_variogram")
def v9f(s, d):
    rows = []
    for method in fitting.METHODS:
        model, misfit = fitting.fit_variogram(_small_map(s, d), ["spherical"], method, population=16, generations=8)
        (t,) = model.structures
        rows.append((method, t.ranges[0], t.ranges[1], t.azimuth, t.sill, misfit))
    return s.createDataFrame(rows, "method string, major double, minor double, azimuth double, sill double, misfit double")


@query("E6_cokrige_collocated", f"""WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT p.row_id, p.v AS v2, q.v AS v1, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d, q.row_id AS s FROM p JOIN q ON sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) < 150.5),
k AS (SELECT *, CASE WHEN d >= 100 THEN 0 ELSE 1 - 1.5 * d / 100 + 0.5 * (d / 100) ** 3 END AS c FROM n QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, s) = 1),
w AS (SELECT row_id, v1, v2, c, c * (1 - 0.36) / (1 - 0.36 * c * c) AS w1, 0.6 * (1 - c * c) / (1 - 0.36 * c * c) AS w2 FROM k)
SELECT row_id, round(w1 * (v1 - 4000) + w2 * (v2 - 4500) + 4000, 4) AS estimate, round(1 - w1 * c - w2 * 0.6, 6) AS variance FROM w""")
def e6(s, d):
    one = VariogramModel(0.0, (Structure("spherical", 1.0, (100.0, 100.0, 100.0)),))
    models = {(0, 0): one, (0, 1): cokriging.markov_model(one, 0.6, 1.0), (1, 1): one}
    targets = T.points(s, d).select("row_id", "x", "y", F.col("v").alias("v2"))
    out = cokriging.cokrige(targets, [(T.few_points(s, d).drop("z"), "v", 1)], models, 150.5, [4000.0, 4500.0], collocated="v2")
    return out.select("row_id", F.round("estimate", 4).alias("estimate"), F.round("variance", 6).alias("variance"))


@query("E6_cokrige_full")
def e6f(s, d):
    model = lambda sill: VariogramModel(0.05 * sill, (Structure("spherical", sill, (120.0, 120.0, 120.0)),))
    models = {(0, 0): model(1.0), (0, 1): model(0.5), (1, 1): model(0.8)}
    targets = T.parts(s, d).select("row_id", "x", "y")
    return cokriging.cokrige(targets, [(T.few_points(s, d).drop("z"), "v", 6), (T.points(s, d).select("row_id", "x", "y", "v"), "v", 6)], models, 150.5)


_SQUARE = f"g AS (SELECT i, j, v FROM ({_GRID})), n AS (SELECT CAST(max(o_orderkey // 100) + 1 AS BIGINT) AS nj FROM orders), e AS (SELECT nj, CAST(2 ** ceil(log2(greatest(100, nj))) AS BIGINT) AS n FROM n)"


@query("K8_haar_level", f"""WITH {_SQUARE}, a AS (SELECT *, unnest(range(n)) AS i FROM e), b AS (SELECT *, unnest(range(n)) AS j FROM a),
s AS (SELECT i, j, n, least(i % 200, 199 - i % 200) AS si, ((j - (n - nj)) % (2 * nj) + 2 * nj) % (2 * nj) AS r, nj FROM b),
q AS (SELECT s.i, s.j, n, coalesce(v, 0) AS v FROM s LEFT JOIN g ON g.i = si AND g.j = least(r, 2 * nj - 1 - r)),
h AS (SELECT i // 2 AS a, j // 2 AS b, n, sum(v) / 2 AS ll, sum(CASE WHEN i % 2 = 0 THEN v ELSE -v END) / 2 AS hl, sum(CASE WHEN j % 2 = 0 THEN v ELSE -v END) / 2 AS lh, sum(CASE WHEN (i + j) % 2 = 0 THEN v ELSE -v END) / 2 AS hh FROM q GROUP BY ALL)
SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, round(ll + 1.7e-5, 3) AS c FROM h UNION ALL SELECT CAST(a + n // 2 AS INTEGER), CAST(b AS INTEGER), round(hl + 1.7e-5, 3) FROM h
UNION ALL SELECT CAST(a AS INTEGER), CAST(b + n // 2 AS INTEGER), round(lh + 1.7e-5, 3) FROM h UNION ALL SELECT CAST(a + n // 2 AS INTEGER), CAST(b + n // 2 AS INTEGER), round(hh + 1.7e-5, 3) FROM h""")
def k8(s, d):
    g = T.grid(s, d)
    size = 100, g.agg(F.max("j")).first()[0] + 1
    out = wavelets.dwt_grid(g, "v", size, 2, levels=1)  # one level is the same interleaved or not
    return out.select("i", "j", (F.rint((F.col("v") + 1.7e-5) * 1000) / 1000).alias("c"))  # F.round goes by decimals, which costs more than all the rest


@query("K8_daubechies_back", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(coalesce(v, 0) + 1.7e-5, 3) AS v FROM ({_GRID})")
def k8b(s, d):
    g = T.grid(s, d)
    size = 100, g.agg(F.max("j")).first()[0] + 1
    back = wavelets.dwt_filter(g, "v", size, taps=8)
    return back.join(g.select("i", "j").hint("merge"), ["i", "j"], "left_semi").select("i", "j", F.round(F.col("v") + 1.7e-5, 3).alias("v"))


def _sold(s, d):
    return T.table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_extendedprice").cast("double").alias("price"))


@query("K12_regression_stump", """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS c, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
a AS (SELECT count(*) AS n, sum(y) AS s FROM r), h AS (SELECT 0 AS f, q AS x, count(*) AS n, sum(y) AS s FROM r GROUP BY q UNION ALL SELECT 1, c, count(*), sum(y) FROM r GROUP BY c),
k AS (SELECT f, x, sum(n) OVER w AS n, sum(s) OVER w AS s FROM h WINDOW w AS (PARTITION BY f ORDER BY x)),
b AS (SELECT f, x, k.n, k.s, a.n - k.n AS m, a.s - k.s AS t FROM k, a WHERE k.n < a.n ORDER BY k.s * k.s / k.n + (a.s - k.s) ** 2 / (a.n - k.n) DESC, f, x LIMIT 1)
SELECT row_id, round(CASE WHEN CASE WHEN f = 0 THEN q ELSE c END <= x THEN b.s / b.n ELSE t / m END, 4) AS mean, CAST(0 AS DOUBLE) AS variance FROM r, b""")
def k12(s, d):
    sold = _sold(s, d)
    forest = forests.grow(sold, ["quantity", "discount"], "price", False, depth=1, bins=128, bootstrap=False)
    return rounded(forests.predict(sold, forest), "mean", digits=4)


@query("K12_regression_forest")
def k12f(s, d):
    sold = _sold(s, d)
    return forests.predict(sold, forests.grow(sold, ["quantity", "discount"], "price", False, trees=5, depth=4, bins=16))


@query("K11_classification_forest")
def k11(s, d):
    points = T.points(s, d)
    return forests.predict(points, forests.grow(points, ["x", "y", "v"], "dom", True, trees=7, depth=4, bins=16))


# --- responses and splines
@query("K9_gabor", f"""WITH g AS (SELECT i, j, v FROM ({_GRID})),
o AS (SELECT a, b, a * sin(radians(30)) + b * cos(radians(30)) AS u, a * cos(radians(30)) - b * sin(radians(30)) AS w FROM range(-4, 5) s(a), range(-4, 5) t(b)),
k AS (SELECT a, b, u, exp(-0.5 * ((u / 2.0) ** 2 + (w / 1.5) ** 2)) AS e FROM o), n AS (SELECT a, b, e / sum(e) OVER () * cos(2 * pi() * 0.2 * u) AS re, e / sum(e) OVER () * sin(2 * pi() * 0.2 * u) AS im FROM k),
e AS (SELECT max(j) AS nj FROM g), c AS (SELECT x AS i, y AS j FROM e, range(0, 100) s(x), (SELECT unnest(range(nj + 1)) AS y FROM e) t),
r AS (SELECT c.i, c.j, sum(coalesce(v, 0) * re) AS re, sum(coalesce(v, 0) * im) AS im FROM c, n, g WHERE g.i = c.i - a AND g.j = c.j - b GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(re + 1.7e-5, 3) AS re, round(im + 1.7e-5, 3) AS im, round(sqrt(re * re + im * im) + 1.7e-5, 3) AS amplitude FROM r""")
def k9(s, d):
    g = T.grid(s, d)
    out = filters.gabor(g, "v", 100, g.agg(F.max("j")).first()[0] + 1, 0.2, 30.0, (2.0, 1.5), 4)
    return out.select("i", "j", *[F.round(F.col(c) + 1.7e-5, 3).alias(c) for c in ("re", "im", "amplitude")])


@query("E10_spline")
def e10(s, d):
    return filters.fill_nulls_spline(T.grid(s, d), "v", 0.0, 20, 6)


@query("E10_spline_known", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 2) AS spline FROM ({_GRID}) WHERE v IS NOT NULL")
def e10k(s, d):
    g = T.grid(s, d)
    out = filters.fill_nulls_spline(g, "v", 0.0, 20, 6).join(g.where("v IS NOT NULL").select("i", "j"), ["i", "j"], "left_semi")
    return out.select("i", F.col("j").cast("int").alias("j"), F.round("spline", 2).alias("spline"))


# --- factors, sections, grid values in meshes and sections, phases
@query("E8_factors_two", f"""WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT p.row_id, q.row_id AS s, q.x, q.y, q.v, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d FROM p JOIN q ON sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) < 150.5),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, s) AS r, CASE WHEN d >= 100 THEN 0 ELSE 1 - 1.5 * d / 100 + 0.5 * (d / 100) ** 3 END AS c FROM n),
w AS (SELECT a.row_id, a.v AS v1, b.v AS v2, a.c AS c1, b.c AS c2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h FROM k a JOIN k b ON b.row_id = a.row_id AND a.r = 1 AND b.r = 2),
f AS (SELECT *, (c1 - c2) / (2 * (1 - CASE WHEN h >= 100 THEN 0 ELSE 1 - 1.5 * h / 100 + 0.5 * (h / 100) ** 3 END)) AS w FROM w)
SELECT row_id, round((v1 + v2) / 2 + 1.7e-6, 4) AS mean, round(w * (v1 - v2) + 1.7e-6, 4) AS factor FROM f""")
def e8(s, d):
    model = VariogramModel(0.0, (Structure("spherical", 1.0, (100.0, 100.0, 100.0)),))
    targets, samples = T.points(s, d).drop("v", "dom", "z"), T.few_points(s, d).drop("z")
    mean, factor = (spatial.factorial_krige(targets, samples, "v", model, n, 150.5, 2, 2).select("row_id", F.round(F.col("estimate") + 1.7e-6, 4).alias(c)) for n, c in ((-1, "mean"), (1, "factor")))
    return mean.join(factor, "row_id")


_PATH = "p AS (SELECT s_suppkey AS n, CAST(s_suppkey * 3 % 90 AS DOUBLE) AS x, CAST(s_suppkey * 7 % 13 AS DOUBLE) AS y, CAST(s_suppkey % 4 AS DOUBLE) + 9 AS top, CAST(s_suppkey % 3 AS DOUBLE) AS base, s_suppkey * 4 AS col FROM supplier), q AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(top) OVER w AS top2, lead(base) OVER w AS base2, lead(col) OVER w - CASE WHEN lead(col, 2) OVER w IS NULL THEN 0 ELSE 1 END AS fin FROM p WINDOW w AS (ORDER BY col)), c AS (SELECT *, fin - col + 1 AS m FROM q WHERE fin IS NOT NULL), e AS (SELECT *, unnest(range(col, fin + 1)) AS i FROM c), l AS (SELECT *, unnest(range(0, 5)) AS k, (i - col) / m AS t0, (i - col + 1) / m AS t1 FROM e), z AS (SELECT *, (base + (base2 - base) * t0) AS b0, (base + (base2 - base) * t1) AS b1, (top + (top2 - top) * t0) AS p0, (top + (top2 - top) * t1) AS p1 FROM l), s AS (SELECT i, k, x + (x2 - x) * (t0 + t1) / 2 AS x, y + (y2 - y) * (t0 + t1) / 2 AS y, (b0 + (p0 - b0) * k / 6 + b1 + (p1 - b1) * k / 6 + b0 + (p0 - b0) * (k + 1) / 6 + b1 + (p1 - b1) * (k + 1) / 6) / 4 AS z, ((p0 - b0) / 6 + (p1 - b1) / 6) / 2 * sqrt((x2 - x) ** 2 + (y2 - y) ** 2) / m AS area FROM z)"


def _path(s, d):
    k = F.col("s_suppkey")
    return T.table(s, d, "supplier").select((k * 3 % 90).cast("double").alias("x"), (k * 7 % 13).cast("double").alias("y"), ((k % 4).cast("double") + 9).alias("top"), (k % 3).cast("double").alias("base"), (k * 4).alias("col"))


@query("G18_section_cells", f"WITH {_PATH} SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(area, 6) AS area FROM s")
def g18(s, d):
    return rounded(sections.section_cells(_path(s, d), 5), "x", "y", "z", "area")


@query("J12_grid_to_section", f"WITH {_PATH}, g AS (SELECT i AS gi, j AS gj, v FROM ({_GRID})) SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, v AS cell_value FROM s LEFT JOIN g ON gi = floor(x + 0.01) AND gj = floor(y + 0.01) AND floor(z / 100) = 0")
def j12s(s, d):
    g = T.grid(s, d).withColumn("k", F.lit(0))
    spec = GridSpec(100, g.agg(F.max("j")).first()[0] + 1, 1, x0=-0.01, y0=-0.01, dz=100.0)
    return sections.collocate_grid_to_section(_path(s, d), 5, g, spec, "v").select("i", "k", "cell_value")


@query("J12_grid_to_mesh", f"WITH h AS (SELECT DISTINCT o_orderkey % 100 AS i, o_orderkey // 100 AS j FROM orders), g AS (SELECT i AS gi, j AS gj, v FROM ({_GRID})), c AS (SELECT a.i, a.j FROM h a JOIN h b ON b.i = a.i + 1 AND b.j = a.j JOIN h e ON e.i = a.i AND e.j = a.j + 1 JOIN h f ON f.i = a.i + 1 AND f.j = a.j + 1) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, v AS cell_value FROM c LEFT JOIN g ON gi = i + 1 AND gj = j + 1, range(0, 2) t(k)")
def j12m(s, d):
    g = T.grid(s, d).withColumn("k", F.lit(0))
    spec = GridSpec(100, g.agg(F.max("j")).first()[0] + 1, 1, z0=-100.0, dz=200.0)
    return sections.collocate_grid_to_mesh(mesh.cells(mesh.vertices(_horizons(s, d), 2)), g, spec, "v").select("i", "j", "k", "cell_value")


@query("S6_phase_symmetry", "WITH n AS (SELECT max(o_orderkey // 100) + 1 AS nj FROM orders), c AS (SELECT i, y AS j, nj FROM n, range(0, 100) s(i), (SELECT unnest(range(nj)) AS y FROM n) t) SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (WHERE 100 - i < 100 AND 2 * (nj // 2) - j BETWEEN 0 AND nj - 1) AS BIGINT) AS paired, CAST(0 AS BIGINT) AS unlike, true AS spread FROM c")
def s6(s, d):
    nj = T.grid(s, d).agg(F.max("j")).first()[0] + 1
    f = sections.random_phase_field(s, 100, nj, 11)
    other = f.select((100 - F.col("i")).alias("i"), (2 * (nj // 2) - F.col("j")).alias("j"), F.col("phase").alias("_p"))
    both = f.join(other, ["i", "j"], "left")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count("_p").alias("paired"), F.coalesce(F.sum((F.abs(F.col("phase") + F.col("_p")) > 1e-12).cast("bigint")), F.lit(0)).alias("unlike"), ((F.stddev("phase") > 1.6) & (F.max(F.abs("phase")) <= math.pi)).alias("spread"))


# --- intervals of bent holes, and the test of independence
def _bent(s, d):
    return _wells(s, d).withColumn("row_id", F.col("seq"))


@query("F14_bent_intervals", f"WITH {_WELL} SELECT hole, CAST(seq AS INTEGER) AS seq, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2), 8) AS length, round(abs(z1 - z0), 8) AS height, round((x0 + x1) / 2, 8) AS mid_x, round((y0 + y1) / 2, 8) AS mid_y, round((z0 + z1) / 2, 8) AS mid FROM g")
def f14b(s, d):
    return rounded(markov.segment_measures(_wells(s, d)).select("hole", "seq", "length", "height", "mid_x", "mid_y", "mid"), "length", "height", "mid_x", "mid_y", "mid", digits=8)


@query("G11_bent_midpoints", f"WITH {_WELL} SELECT hole, CAST(seq AS INTEGER) AS seq, cat, round((x0 + x1) / 2, 8) AS x, round((y0 + y1) / 2, 8) AS y, round((z0 + z1) / 2, 8) AS z, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2), 8) AS weight FROM g")
def g11b(s, d):
    return rounded(markov.to_midpoints(_wells(s, d)), "x", "y", "z", "weight", digits=8).select("hole", "seq", "cat", "x", "y", "z", "weight")


@query("T4_bent_ends", f"WITH {_WELL} SELECT hole, round(arg_min(x0, seq), 8) AS head_x, round(arg_min(y0, seq), 8) AS head_y, round(arg_min(z0, seq), 8) AS head_z, round(arg_max(x1, seq), 8) AS tail_x, round(arg_max(y1, seq), 8) AS tail_y, round(arg_max(z1, seq), 8) AS tail_z FROM g GROUP BY hole")
def t4b(s, d):
    return rounded(markov.hole_ends(_bent(s, d)), *[f"{e}_{c}" for e in ("head", "tail") for c in "xyz"], digits=8)


@query("C8_independence_test", f"WITH {_exp(_SEQ)} SELECT round(sum(CASE WHEN trail * rs > 0 THEN (n - trail * rs) * (n - trail * rs) / (trail * rs) END), 4) AS chi2, CAST(5 AS BIGINT) AS categories, CAST(15 AS BIGINT) AS freedom FROM x")
def c8t(s, d):
    return rounded(markov.independence_test(_ftm(s, d)), "chi2", digits=4)
