"""More queries: tables and roles, places, other grids, functions; in the same registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithospark.functions import scalar as S
from lithospark.operators import frame, grids, markov, spatial
from lithospark.queries import _ALONG, _GRID, _MODEL, _PS, _PT, _SEG, QUERIES, SQL, query, rounded
from lithospark.sources import tables as T
from lithospark.spec import GridSpec, Structure, VariogramModel

__all__ = ["QUERIES", "SQL"]


# --- tables and roles
@query("P7_roles", f"WITH p AS ({_PT}) SELECT row_id, dom, 2.5::DOUBLE AS c FROM p")
def p7(s, d):
    p = frame.add_constant(T.points(s, d).select("row_id", "dom", "v"), "c", 2.5)
    p = frame.with_role(p.withColumn("score", F.col("v") / 2), "score", "normal score", "v")
    return frame.drop_column(frame.add_constant(p, "w", 1.0, "weight", "v"), "v")


@query("P6_unmatched", "SELECT r_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL")
def p6u(s, d):
    region = T.table(s, d, "region")
    names = region.where("r_name NOT IN ('ASIA', 'EUROPE')").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("code"))
    rows = T.table(s, d, "customer").join(T.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return frame.unmatched_names(rows, "r_name", names)


@query("T1_sort_by", f"WITH p AS ({_PT}) SELECT row_id, v FROM p ORDER BY v DESC, row_id")
def t1(s, d):
    return frame.sort_by(T.points(s, d), "v", ascending=False).select("row_id", "v")


@query("T2_group_tables", f'WITH s AS ({_SEG}) SELECT hole AS "value", row_number() OVER (ORDER BY hole) - 1 AS "table", count(*) AS n, min(row_id) AS "first", max(row_id) AS "last" FROM s GROUP BY hole')
def t2(s, d):
    return frame.group_tables(T.segments(s, d), "hole")


@query("T4_hole_ends", f'WITH s AS ({_SEG}) SELECT hole, round(arg_min(z0, (z0, row_id)), 6) AS head, round(arg_max(z1, (z0, row_id)), 6) AS tail FROM s GROUP BY hole')
def t4(s, d):
    return rounded(markov.hole_ends(T.segments(s, d)), "head", "tail")


@query("IO7_row_numbers", 'SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id, o_orderkey FROM orders')
def io7(s, d):
    from lithospark.sources.geoeas import with_row_id

    return with_row_id(T.table(s, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("row_id", "o_orderkey")


@query("G9_append_array", f"WITH g AS ({_GRID}), a AS (SELECT l_orderkey AS cell, sum(l_extendedprice) / nullif(count(*) - 3, 0) AS u FROM lineitem GROUP BY 1) SELECT cell, round(coalesce(u, -999), 4) AS u FROM g LEFT JOIN a USING (cell)")
def g9(s, d):
    n = F.count(F.lit(1)) - 3
    values = T.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.when(n != 0, F.try_divide(F.sum("l_extendedprice"), n)).otherwise(float("inf")).alias("u"))
    return rounded(frame.append_array(T.grid(s, d), values, "u").select("cell", "u"), "u", digits=4)


@query("E12_residuals", f"WITH p AS ({_PT}) SELECT row_id, round(0.001 * x * x - 0.002 * y * y + 0.01 * x * y + x - 2 * y, 4) AS trend, round(v - (0.001 * x * x - 0.002 * y * y + 0.01 * x * y + x - 2 * y), 4) AS residual FROM p")
def e12(s, d):
    return rounded(frame.detrended(T.points(s, d), "v", (0.001, -0.002, 0, 0.01, 0, 0, 1.0, -2.0, 0)), "trend", "residual", digits=4).select("row_id", "trend", "residual")


# --- holes
@query("F14_segment_measures", f"WITH s AS ({_SEG}) SELECT row_id, round(abs(z1 - z0), 6) AS length, round((z0 + z1) / 2, 6) AS mid FROM s")
def f14(s, d):
    return rounded(markov.segment_measures(T.segments(s, d)).select("row_id", "length", "mid"), "length", "mid")


@query("G11_midpoints", f"WITH s AS ({_SEG}) SELECT row_id, hole, cat, round((z0 + z1) / 2, 6) AS z, round(z1 - z0, 6) AS weight FROM s")
def g11(s, d):
    return rounded(markov.to_midpoints(T.segments(s, d)).select("row_id", "hole", "cat", "z", "weight"), "z", "weight")


@query("C3_transiogram", f'WITH {_ALONG}, hs AS (SELECT unnest([4.5, 9.5, 19.5]::DOUBLE[]) AS h), st AS (SELECT h, hole, k, cat, along, row_id FROM hs, a, range(0, 3000) t(k) WHERE k * h >= along AND k * h <= along + z1 - z0), m AS (SELECT h, hole, k, arg_min(cat, (along, row_id)) AS cat FROM st GROUP BY ALL), t AS (SELECT h, cat AS f, lead(cat) OVER (PARTITION BY h, hole ORDER BY k) AS t FROM m WHERE cat IS NOT NULL), c AS (SELECT h, f, t, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL), e AS (SELECT t, sum(n) / (SELECT sum(n) FROM c) AS sill FROM c GROUP BY t) SELECT h, f AS "from", t AS "to", n, round(n / sum(n) OVER (PARTITION BY h, f), 6) AS up, round(sill, 6) AS sill FROM c JOIN e USING (t)')
def c3(s, d):
    return rounded(markov.transiogram(T.segments(s, d, True), [4.5, 9.5, 19.5]), "up", "sill")


# --- functions
@query("F3_linear_interpolate", f"WITH p AS ({_PT}) SELECT row_id, round(10 + (x - 5) * (y - 10) / (1009 - 5), 6) AS t FROM p")
def f3(s, d):
    return rounded(T.points(s, d).select("row_id", S.linear_interpolate(F.col("x"), F.lit(5.0), F.lit(1009.0), F.lit(10.0), F.col("y")).alias("t")), "t")


@query("F5_pdf_checks", "SELECT l_orderkey, abs(sum(l_discount) - 0.15) <= 0.0215 AS near, bool_or(l_discount <= 0) AS none FROM lineitem GROUP BY l_orderkey")
def f5(s, d):
    a = T.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("a"))  # an order's lines
    shifted = F.concat("a", F.array(F.lit(0.85)))
    return a.select("l_orderkey", S.sums_to_one(shifted, 0.0215).alias("near"), S.has_no_chance(F.col("a")).alias("none"))


@query("F11_transiogram_model", f"WITH p AS ({_PT}), h AS (SELECT row_id, x / 100 AS h FROM p), g AS (SELECT row_id, CASE WHEN h >= 1 THEN 1 ELSE 1.5 * h - 0.5 * h * h * h END AS a, 1 - exp(-9 * h * h) AS b FROM h) SELECT row_id, round(1 - a * (1 - 0.3), 6) AS auto, round(b * 0.3, 6) AS cross_, 0.0::DOUBLE AS none FROM g")
def f11(s, d):
    x = F.col("x")
    return rounded(T.points(s, d).select("row_id", S.transiogram_p("spherical", x, 100.0, 0.3, True).alias("auto"), S.transiogram_p("gaussian", x, 100.0, 0.3, False).alias("cross_"), S.transiogram_p("?", x, 100.0, 0.3, True).alias("none")), "auto", "cross_")


_KINDS = {"gaussian": "1 - exp(-9 * pow({h} / 300, 2))", "power": "pow({h}, 1.5)", "hole": "1 - cos(pi() * {h} / 300)"}


def _one(kind):
    return VariogramModel(0.2, (Structure(kind, 0.5, (300.0, 300.0, 300.0)),))


@query("F10_structures", f"WITH p AS ({_PT}), h AS (SELECT row_id, sqrt(x * x + y * y + z * z) AS h FROM p) SELECT row_id, " + ", ".join(f"CASE WHEN h = 0 THEN 0.0 ELSE round(0.2 + 0.5 * ({e.format(h='h')}), 5) END AS {k}" for k, e in _KINDS.items()) + " FROM h")
def f10s(s, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return rounded(T.points(s, d).select("row_id", *[S.gamma(x, y, z, _one(k)).alias(k) for k in _KINDS]), *_KINDS, digits=5)


@query("F15_polar", f"WITH p AS ({_PT}) SELECT row_id, round(sqrt(x * x + v * v), 6) AS magnitude, round(atan2(v, x), 6) AS phase, round(x, 6) AS re, round(v, 6) AS im FROM p")
def f15(s, d):
    magnitude, phase = S.to_polar(F.col("x"), F.col("v"))
    re, im = S.to_rectangular(F.col("magnitude"), F.col("phase"))
    out = T.points(s, d).select("row_id", magnitude.alias("magnitude"), phase.alias("phase")).withColumns({"re": re, "im": im})
    return rounded(out, "magnitude", "phase", "re", "im")


@query("V8_model_curve", f"WITH h AS (SELECT o_orderkey, o_orderkey % 400 / 2.0 AS h FROM orders), r AS (SELECT *, sqrt(pow((h * sin(radians(20)) * sin(radians(30)) + h * cos(radians(20)) * cos(radians(30))) / 60, 2) + pow((-h * sin(radians(20)) * cos(radians(30)) + h * cos(radians(20)) * sin(radians(30))) / 30, 2)) AS a, h / 200 AS b FROM h) SELECT o_orderkey, CASE WHEN h = 0 THEN 0.0 ELSE round(0.1 + 0.6 * CASE WHEN a >= 1 THEN 1 ELSE 1.5 * a - 0.5 * a * a * a END + 0.3 * (1 - exp(-3 * b)), 6) END AS gamma FROM r")
def v8(s, d):
    lags = T.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 / 2.0).alias("h"))
    return rounded(spatial.model_curve(_MODEL, lags, 20.0), "gamma").select("o_orderkey", "gamma")


@query("K5_equalize", f"WITH g AS ({_GRID}) SELECT cell, round(CASE WHEN i BETWEEN 20 AND 60 AND j >= 3 AND v IS NOT NULL THEN (CASE WHEN v < 50000 THEN -1 ELSE 1 END) * greatest(abs(v - 50000), 1e-3) * pow(10, 0.3) ELSE v - 50000 END, 4) AS v FROM g")
def k5(s, d):
    centered = T.grid(s, d).withColumn("v", F.col("v") - 50000)
    area = F.col("i").between(20, 60) & (F.col("j") >= 3) & F.col("v").isNotNull()
    return centered.select("cell", F.round(F.when(area, S.equalized(F.col("v"), 3.0, 100.0, 1e-3)).otherwise(F.col("v")), 4).alias("v"))


# --- places and grids
@query("J3_in_box", f"WITH p AS ({_PT}), q AS ({_PS}) SELECT q.row_id AS box, p.row_id FROM q JOIN p ON p.x BETWEEN q.x - 15 AND q.x + 15 AND p.y BETWEEN q.y - 7 AND q.y + 7")
def j3(s, d):
    x, y = F.col("x"), F.col("y")
    boxes = T.few_points(s, d).select(F.col("row_id").alias("box"), (x - 15).alias("low_x"), (x + 15).alias("high_x"), (y - 7).alias("low_y"), (y + 7).alias("high_y"))
    return spatial.in_box(T.points(s, d), boxes, 30.0).select("box", "row_id")


@query("J6_sector_neighbors", f"WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT q.row_id AS a, p.row_id AS b, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS d, least(CAST(floor((CASE WHEN atan2(p.x-q.x, p.y-q.y) < 0 THEN degrees(atan2(p.x-q.x, p.y-q.y)) + 360 ELSE degrees(atan2(p.x-q.x, p.y-q.y)) END) / 90) AS INTEGER), 3) AS sector FROM q JOIN p ON sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) < 70.7), s AS (SELECT *, row_number() OVER (PARTITION BY a, sector ORDER BY d, b) AS k FROM n), g AS (SELECT a FROM s WHERE k = 2 GROUP BY a HAVING count(*) = 4) SELECT a AS row_id_a, b AS row_id_b, sector, CAST(row_number() OVER (PARTITION BY a ORDER BY k, sector) AS INTEGER) AS rank FROM s WHERE k <= 3 AND a IN (SELECT a FROM g) QUALIFY row_number() OVER (PARTITION BY a ORDER BY k, sector) <= 10")
def j6(s, d):
    pairs = spatial.nearest_pairs(T.few_points(s, d), T.points(s, d), 3, 70.7, "xy", sectors=4, carry=("row_id",))  # as many as a sector gives
    return spatial.sector_neighbors(pairs, 4, 10, 2, 3).select("row_id_a", "row_id_b", "sector", "rank")


@query("J5_shell", f"WITH p AS ({_PT}), q AS ({_PS}) SELECT q.row_id AS row_id_a, p.row_id AS row_id_b FROM q JOIN p ON (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) > 400.5 AND (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) <= 900.5")
def j5s(s, d):
    pairs = spatial.within_distance(T.few_points(s, d), T.points(s, d), 30.1, "xy", ("row_id", "x", "y"))
    inside = spatial.in_annulus(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a"), 400.5**0.5, 900.5**0.5)
    return pairs.where(inside).select("row_id_a", "row_id_b")


@query("J11_grid_to_grid", f"WITH g AS ({_GRID}), c AS (SELECT cell, floor((5 + (i + 0.5) * 7.0) / 10) AS i, floor((3 + (j + 0.5) * 6.0) / 10) AS j FROM g) SELECT c.cell, g.v AS source_value FROM c LEFT JOIN g ON g.i = c.i AND g.j = c.j")
def j11(s, d):
    g = T.grid(s, d).withColumn("k", F.lit(0))
    target = GridSpec(100, 1 << 20, 1, 5, 3, 0, 7, 6, 1)
    return spatial.collocate_grid_to_grid(g.drop("v"), target, g, GridSpec(100, 1 << 20, 1, 0, 0, 0, 10, 10, 1), "v").select("cell", "source_value")


@query("G3_grid_to_points", f"WITH g AS ({_GRID}) SELECT cell, 10 + (i + 0.5) * 2.0 AS x, 20 + (j + 0.5) * 3.0 AS y, v FROM g")
def g3(s, d):
    return spatial.grid_to_points(T.grid(s, d).withColumn("k", F.lit(0)), GridSpec(100, 1 << 20, 1, 10, 20, 0, 2, 3, 1)).select("cell", "x", "y", "v")


@query("G6_reposition", f"WITH g AS ({_GRID}) SELECT cell, round(100 + (i - 10) * 2.5, 6) AS x, round(-50 + (j - 2) * 4.0, 6) AS y FROM g")
def g6(s, d):
    spec = spatial.repositioned(GridSpec(100, 1 << 20), ((10, 2), (50, 7)), ((100.0, -50.0), (200.0, -30.0)))
    return rounded(spatial.center_of(spec, T.grid(s, d).withColumn("k", F.lit(0))).select("cell", "x", "y"), "x", "y")


@query("G1_make_grid", f"WITH p AS ({_PT}), b AS (SELECT min(x) AS x0, min(y) AS y0, CAST(ceil((max(x) - min(x)) / 20 + 1e-9) AS BIGINT) AS nx, CAST(ceil((max(y) - min(y)) / 20 + 1e-9) AS BIGINT) AS ny FROM p) SELECT c AS cell, CAST(c % nx AS INTEGER) AS i, CAST(c // nx AS INTEGER) AS j, x0 + (c % nx + 0.5) * 20 AS x, y0 + (c // nx + 0.5) * 20 AS y FROM b, range(0, 100000) t(c) WHERE c < nx * ny")
def g1(s, d):
    return grids.make_grid(s, grids.around(T.points(s, d), 20.0)).select("cell", "i", "j", "x", "y")


# --- estimation from two samples, for which the weights are a formula
@query("E1_krige_two", f"WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT p.row_id, q.row_id AS s, q.x - p.x AS dx, q.y - p.y AS dy, q.v, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS d FROM p JOIN q ON sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) < 150.5), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, s) AS r FROM n), w AS (SELECT a.row_id, a.v AS v1, b.v AS v2, least(a.d / 100, 1) AS h1, least(b.d / 100, 1) AS h2, least(sqrt(pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2)) / 100, 1) AS h3 FROM k a JOIN k b USING (row_id) WHERE a.r = 1 AND b.r = 2), g AS (SELECT row_id, v1, v2, 1.5 * h1 - 0.5 * h1 * h1 * h1 AS g1, 1.5 * h2 - 0.5 * h2 * h2 * h2 AS g2, 1.5 * h3 - 0.5 * h3 * h3 * h3 AS g3 FROM w WHERE h3 > 0), l AS (SELECT *, 0.5 + (g2 - g1) / (2 * g3) AS w1 FROM g) SELECT row_id, round(w1 * v1 + (1 - w1) * v2, 4) AS estimate, round(w1 * g1 + (1 - w1) * g2 + g1 - (1 - w1) * g3, 6) AS variance FROM l")
def e1two(s, d):
    model = VariogramModel(0.0, (Structure("spherical", 1.0, (100.0, 100.0, 100.0)),))
    out = spatial.krige(T.points(s, d).drop("v", "dom", "z"), T.few_points(s, d).drop("z"), "v", model, 150.5, n_max=2, n_min=2)
    return out.select("row_id", F.round("estimate", 4).alias("estimate"), F.round("variance", 6).alias("variance"))


_TWO = "1.5 * {h} - 0.5 * {h} * {h} * {h}"


@query("E4_indicator_krige", f"WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT p.row_id, q.row_id AS s, q.x - p.x AS dx, q.y - p.y AS dy, q.v, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS d FROM p JOIN q ON sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) < 150.5), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, s) AS r FROM n), w AS (SELECT a.row_id, a.v AS v1, b.v AS v2, least(a.d / 100, 1) AS h1, least(b.d / 100, 1) AS h2, least(sqrt(pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2)) / 100, 1) AS h3 FROM k a JOIN k b USING (row_id) WHERE a.r = 1 AND b.r = 2), l AS (SELECT row_id, v1, v2, 0.5 + ({_TWO.format(h='h2')} - ({_TWO.format(h='h1')})) / (2 * ({_TWO.format(h='h3')})) AS w1 FROM w), e AS (SELECT row_id, " + ", ".join(f"greatest(0, least(1, w1 * CASE WHEN v1 <= {t} THEN 1 ELSE 0 END + (1 - w1) * CASE WHEN v2 <= {t} THEN 1 ELSE 0 END)) AS e{i}" for i, t in enumerate((0, 2500, 6000))) + " FROM l) SELECT row_id, round(e0, 6) AS p0, round(greatest(e0, e1), 6) AS p1, round(greatest(e0, e1, e2), 6) AS p2 FROM e")
def e4(s, d):
    model = VariogramModel(0.0, (Structure("spherical", 1.0, (100.0, 100.0, 100.0)),))
    out = spatial.indicator_krige(T.points(s, d).drop("v", "dom", "z"), T.few_points(s, d).drop("z"), "v", [0, 2500, 6000], model, 150.5, n_max=2, n_min=2)
    return rounded(out, "p0", "p1", "p2")


@query("E7_fill_nulls", f"WITH g AS ({_GRID}), n AS (SELECT a.cell, b.cell AS s, b.i - a.i AS dx, b.j - a.j AS dy, b.v, sqrt((b.i - a.i) * (b.i - a.i) + (b.j - a.j) * (b.j - a.j)) AS d FROM g a, range(-2, 3) x(di), range(-2, 3) y(dj), g b WHERE a.v IS NULL AND b.v IS NOT NULL AND b.i = a.i + di AND b.j = a.j + dj), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d, s) AS r FROM n WHERE d < 2.5), w AS (SELECT a.cell, a.v AS v1, b.v AS v2, a.d / 10 AS h1, b.d / 10 AS h2, sqrt(pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2)) / 10 AS h3 FROM k a JOIN k b USING (cell) WHERE a.r = 1 AND b.r = 2), l AS (SELECT cell, v1, v2, 0.5 + ({_TWO.format(h='h2')} - ({_TWO.format(h='h1')})) / (2 * ({_TWO.format(h='h3')})) AS w1 FROM w) SELECT cell, round(coalesce(g.v, w1 * v1 + (1 - w1) * v2, -1) + 1.7e-5, 3) AS filled FROM g LEFT JOIN l USING (cell)")
def e7(s, d):
    model = VariogramModel(0.0, (Structure("spherical", 1.0, (10.0, 10.0, 10.0)),))
    out = spatial.fill_nulls_kriging(T.grid(s, d), "v", model, 2.5, n_max=2, n_min=2, default=-1.0)
    return out.select("cell", F.round(F.col("filled") + 1.7e-5, 3).alias("filled"))


@query("J5_neighborhoods", f"WITH p AS ({_PT}), q AS (SELECT *, CAST(row_id % 50 AS DOUBLE) AS z FROM ({_PS})), n AS (SELECT q.row_id AS row_id_a, p.row_id AS row_id_b, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz FROM q JOIN p ON abs(p.x - q.x) < 41 AND abs(p.y - q.y) < 41) SELECT *  EXCLUDE (dx, dy, dz) FROM (SELECT *, dx * dx + dy * dy > 100.5 AND dx * dx + dy * dy <= 900.5 AND abs(dz) <= 6 AS washer, dx * dx + dy * dy <= 625.5 AND abs(dz) <= 12 AS dumbbell, pow((dx * sin(radians(30)) + dy * cos(radians(30))) / 40, 2) + pow((-dx * cos(radians(30)) + dy * sin(radians(30))) / 15, 2) + pow(dz / 20, 2) <= 1 AS ellipsoid, dx * dx + dy * dy > 100.5 AND dx * dx + dy * dy <= 900.5 AND floor((dz + 0) / 1) = 0 AS layer FROM n) WHERE washer OR dumbbell OR ellipsoid OR layer")
def j5n(s, d):
    pairs = spatial.within_distance(T.few_points(s, d), T.points(s, d), 41.0, "xy", ("row_id", "x", "y", "z"))  # no shape is wider than 40
    dx, dy, dz = (F.col(f"{c}_b") - F.col(f"{c}_a") for c in "xyz")
    near = pairs.where((F.abs(dx) < 41) & (F.abs(dy) < 41))
    kinds = {
        "washer": spatial.in_washer(dx, dy, dz, 100.5**0.5, 900.5**0.5, 12.0), "dumbbell": spatial.in_vertical_dumbbell(dx, dy, dz, 625.5**0.5, 7.0, 10.0),
        "ellipsoid": spatial.in_rotated_ellipsoid(dx, dy, dz, Structure("spherical", 1.0, (40.0, 15.0, 20.0), 30.0)), "layer": spatial.in_stratigraphic_annulus(dx, dy, F.col("z_a"), F.col("z_b"), 100.5**0.5, 900.5**0.5),
    }
    return near.select("row_id_a", "row_id_b", *[v.alias(k) for k, v in kinds.items()]).where("washer OR dumbbell OR ellipsoid OR layer")


@query("K4_ridges_valleys", f"WITH g AS ({_GRID}), c AS (SELECT a.cell, a.v, d, side, avg(b.v) AS m FROM g a, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) o(d, x, y), (VALUES (1), (-1)) t(side), range(-1, 2) u(p), range(-1, 2) w(q), g b WHERE b.i = a.i + side * x * 2 + p AND b.j = a.j + side * y * 2 + q GROUP BY ALL HAVING avg(b.v) IS NOT NULL), n AS (SELECT cell, any_value(v) AS v, d, max(m) AS top, min(m) AS low FROM c GROUP BY cell, d HAVING count(*) = 2), r AS (SELECT cell, count(*) FILTER (v > top AND abs(v) >= 9000) AS ridge, count(*) FILTER (v < low AND abs(v) >= 9000) AS valley FROM n GROUP BY cell) SELECT cell, coalesce(ridge, 0) AS ridge, coalesce(valley, 0) AS valley FROM g LEFT JOIN r USING (cell)")
def k4(s, d):
    g = T.grid(s, d)
    return grids.ridges_valleys(g, "v", 1, (100, g.agg(F.max("j")).first()[0] + 1), 9000.0).select("cell", "ridge", "valley")


@query("S1_percentiles", 'WITH e AS (SELECT l_linenumber, l_orderkey AS cell, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT cell, round(quantile_cont(v, 0.1) + 1.7e-7, 4) AS q0, round(quantile_cont(v, 0.9) + 1.7e-7, 4) AS q1, round(quantile_cont(v, 0.2) + 1.7e-7, 4) AS low, round(quantile_cont(v, 0.8) + 1.7e-7, 4) AS high FROM e GROUP BY cell')
def s1p(s, d):
    out = grids.percentiles(T.ensemble(s, d), [0.1, 0.9], 0.6)
    return out.withColumns({c: F.round(F.col(c) + 1.7e-7, 4) for c in ("q0", "q1", "low", "high")})


@query("A12_best_size", f"WITH p AS ({_PT}), s AS (SELECT row_id, v, size, o, floor((x + o * size / 5.0) / size) AS cx, floor((y + o * size / 5.0) / size) AS cy FROM p, (SELECT 10.0::DOUBLE + 8 * k AS size FROM range(24) t(k)), range(5) t(o) WHERE v IS NOT NULL), c AS (SELECT size, o, cx, cy, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT size, o, count(*) AS occ, sum(n) AS total FROM c GROUP BY ALL), w AS (SELECT row_id, any_value(v) AS v, size, avg(total / (n * occ)) AS weight FROM s JOIN c USING (size, o, cx, cy) JOIN k USING (size, o) GROUP BY row_id, size), m AS (SELECT size, sum(v * weight) / sum(weight) AS mean FROM w GROUP BY size ORDER BY mean, size LIMIT 1) SELECT row_id, size, round(weight, 6) AS weight FROM w JOIN m USING (size)")
def a12b(s, d):
    return rounded(frame.decluster_best(T.points(s, d), "v", [10.0 + 8 * k for k in range(24)]), "weight")
