"""Queries of the library's operators on the given tables, and their SQL written from the definitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lithospark.functions import scalar as S
from lithospark.operators import frame, grids, lookup, markov, mesh, spatial
from lithospark.sources import tables as T
from lithospark.spec import GridSpec, Structure, VariogramModel

QUERIES: dict = {}
SQL: dict = {}

_PT = "SELECT c_custkey AS row_id, CAST((c_custkey*c_custkey*31+c_custkey*7919)%1009 AS DOUBLE) AS x, CAST((c_custkey*c_custkey*c_custkey*17+c_custkey*104729)%997 AS DOUBLE) AS y, CAST(c_custkey%50 AS DOUBLE) AS z, c_acctbal AS v, dense_rank() OVER (ORDER BY c_mktsegment) AS dom FROM customer"
_PS = "SELECT s_suppkey AS row_id, CAST((s_suppkey*s_suppkey*31+s_suppkey*7919)%1009 AS DOUBLE) AS x, CAST((s_suppkey*s_suppkey*s_suppkey*17+s_suppkey*104729)%997 AS DOUBLE) AS y, s_acctbal AS v FROM supplier"
_SEG = "SELECT event_id AS row_id, hole, z0, z1, CASE WHEN event_id % 17 <> 0 THEN c END AS cat, grade FROM (SELECT event_id, user_id AS hole, (epoch_us(ts) / 1e6 - 1704067200) / 3600 AS z0, lead((epoch_us(ts) / 1e6 - 1704067200) / 3600) OVER (PARTITION BY user_id ORDER BY ts) AS z1, dense_rank() OVER (ORDER BY event_type) AS c, value AS grade FROM events) WHERE z1 IS NOT NULL"
_GRID = "SELECT o_orderkey AS cell, CAST(o_orderkey % 100 AS INTEGER) AS i, CAST(o_orderkey // 100 AS INTEGER) AS j, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v, o_orderpriority AS cat FROM orders"
_ENS = "SELECT l_linenumber AS \"real\", l_orderkey AS cell, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL"
_MODEL = VariogramModel(0.1, (Structure("spherical", 0.6, (60.0, 30.0, 20.0), 30.0), Structure("exponential", 0.3, (200.0, 200.0, 50.0))))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _r(*columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# --- tables, predicates, summaries
@query("P1_ndv_to_null", f"WITH g AS ({_GRID}) SELECT cell, CASE WHEN cat <> '1-URGENT' THEN v END AS v, coalesce(CASE WHEN cat <> '1-URGENT' THEN v END, -999) AS back FROM g")
def p1(s, d):
    g = T.grid(s, d)
    lost = g.select("cell", F.when(F.col("cat") != "1-URGENT", F.col("v")).otherwise(-999.0).alias("v"))
    return frame.null_to_ndv(frame.ndv_to_null(lost, ["v"], -999.0).withColumn("back", F.col("v")), ["back"], -999.0)


@query("P2_filter_range", f"WITH p AS ({_PT}) SELECT row_id, v FROM p WHERE v >= 100 AND v <= 5000")
def p2(s, d):
    return frame.filter_range(T.points(s, d), "v", 100, 5000).select("row_id", "v")


@query("P3_filter_category", f"WITH p AS ({_PT}) SELECT row_id, v FROM p WHERE dom = 2")
def p3(s, d):
    names = s.createDataFrame(list(zip(T.SEGMENTS, range(1, 6))), "name string, code int")
    return frame.filter_category(T.points(s, d), "dom", names, "BUILDING").select("row_id", "v")


@query("P4_classify", f"WITH p AS ({_PT}) SELECT row_id, CAST(CASE WHEN v BETWEEN -1000 AND 0 THEN 1 WHEN v BETWEEN 0 AND 4000 THEN 2 WHEN v BETWEEN 3000 AND 8000 THEN 3 ELSE -1 END AS INTEGER) AS code FROM p")
def p4(s, d):
    return T.points(s, d).select("row_id", frame.classify("v", [(-1000, 0, 1), (0, 4000, 2), (3000, 8000, 3)], -1).alias("code"))


@query("P5_to_categorical", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN round(l_quantity / 10) IN (1, 2, 4) THEN round(l_quantity / 10) ELSE 9 END AS INTEGER) AS code FROM lineitem")
def p5(s, d):
    x = T.table(s, d, "lineitem").withColumn("q", F.col("l_quantity") / 10)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", frame.to_categorical("q", [1, 2, 4], 9).alias("code"))


@query("P6_names_to_codes", "SELECT c_custkey, CASE WHEN r_name <> 'ASIA' THEN r_regionkey END AS code, CASE WHEN r_name <> 'ASIA' THEN CAST(r_regionkey AS VARCHAR) ELSE r_name END AS token FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def p6(s, d):
    names = T.table(s, d, "region").where("r_name <> 'ASIA'").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("code"))
    regions = T.table(s, d, "nation").join(T.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return frame.names_to_codes(T.table(s, d, "customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")), "region", names).select("c_custkey", "code", "token")


@query("P8_append_column", f"WITH p AS ({_PT}), q AS ({_PS}) SELECT p.row_id, p.v, q.v AS w FROM p LEFT JOIN q USING (row_id)")
def p8(s, d):
    return frame.append_column_from(T.points(s, d), T.few_points(s, d).withColumnRenamed("v", "w"), "w").select("row_id", "v", "w")


@query("P9_calculate", f"WITH p AS ({_PT}) SELECT row_id, CASE WHEN v > 0 THEN round(ln(v), 6) END AS l, round(x * 2 + y, 6) AS m FROM p")
def p9(s, d):
    return rounded(frame.calculate(T.points(s, d), {"l": "ln(v)", "m": "x * 2 + y"}), "l", "m").select("row_id", "l", "m")


@query("P10_in_polygon", f"WITH p AS ({_PT}) SELECT row_id FROM p WHERE x BETWEEN 100.5 AND 800.5 AND y BETWEEN 100.5 AND 700.5 AND (x - 100.5) * 600 >= (y - 100.5) * 350 AND (800.5 - x) * 600 >= (y - 100.5) * 350")
def p10(s, d):
    return T.points(s, d).where(S.in_polygon(F.col("x"), F.col("y"), [(100.5, 100.5), (800.5, 100.5), (450.5, 700.5)])).select("row_id")


@query("A1_summary", f"WITH p AS ({_PT}) SELECT dom, min(v) AS min, max(v) AS max, min(abs(v)) AS min_abs, max(abs(v)) AS max_abs, round(avg(v), 4) AS mean, round(var_pop(v), 2) AS variance, count(v) AS n FROM p GROUP BY dom")
def a1(s, d):
    return frame.summary(T.points(s, d), "v", "dom").withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 2)})


@query("A2_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def a2(s, d):
    return frame.correlation(T.table(s, d, "lineitem"), "l_quantity", "l_extendedprice").withColumns({"r": F.round("r", 6), "slope": F.round("slope", 4), "intercept": F.round("intercept", 4)})


@query("A3_proportion", f"WITH p AS ({_PT}) SELECT round(avg(CASE WHEN v BETWEEN 0 AND 3000 THEN 1.0 ELSE 0.0 END), 6) AS p FROM p WHERE v IS NOT NULL")
def a3(s, d):
    return rounded(frame.proportion(T.points(s, d), "v", 0, 3000), "p")


@query("A4_proportion_by_length", f"WITH s AS ({_SEG}) SELECT cat, round(sum(z1 - z0) / (SELECT sum(z1 - z0) FROM s WHERE cat IS NOT NULL), 6) AS p FROM s WHERE cat IS NOT NULL GROUP BY cat")
def a4(s, d):
    return rounded(markov.proportion_by_length(T.segments(s, d)), "p")


@query("A5_bounding_box", f"WITH p AS ({_PT}) SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y, round(avg(z), 6) AS center_z FROM p")
def a5(s, d):
    return rounded(frame.bounding_box(T.points(s, d)), "center_x", "center_y", "center_z")


@query("A7_mean_thickness", f"WITH s AS ({_SEG}) SELECT cat, round(avg(z1 - z0), 6) AS thickness FROM s WHERE cat IS NOT NULL GROUP BY cat")
def a7(s, d):
    return rounded(markov.mean_thickness(T.segments(s, d)), "thickness")


@query("A8_drift", f"WITH p AS ({_PT}), a AS (SELECT 'x' AS axis, x AS c, v FROM p UNION ALL SELECT 'y', y, v FROM p UNION ALL SELECT 'z', z, v FROM p), b AS (SELECT axis, min(c) AS lo, max(c) AS hi FROM a GROUP BY axis) SELECT axis, CAST(least(floor((c - lo) / (hi - lo) * 10), 9) AS INTEGER) AS slice, round(avg(v), 4) AS mean, count(v) AS n FROM a JOIN b USING (axis) GROUP BY ALL")
def a8(s, d):
    return rounded(frame.drift(T.points(s, d), "v", 10), "mean", digits=4)


@query("A10_histogram", f"WITH p AS ({_PT}) SELECT CAST(least(floor((v + 1000) / 11000 * 20), 19) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM p WHERE v BETWEEN -1000 AND 10000 GROUP BY ALL")
def a10(s, d):
    return frame.histogram(T.points(s, d), "v", 20, -1000, 10000)


@query("A11_realization_histograms", f"WITH e AS ({_ENS}) SELECT \"real\", CAST(least(floor(v / 100000 * 15), 14) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM e WHERE v BETWEEN 0 AND 100000 GROUP BY ALL")
def a11(s, d):
    return frame.histogram(T.ensemble(s, d), "v", 15, 0, 100000, by=("real",))


@query("A12_decluster", f"WITH p AS ({_PT}), s AS (SELECT row_id, size, o, floor((x + o * size / 5.0) / size) AS cx, floor((y + o * size / 5.0) / size) AS cy FROM p, (SELECT unnest([20.0, 50.0, 110.0]::DOUBLE[]) AS size), range(5) t(o)), c AS (SELECT size, o, cx, cy, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT size, o, count(*) AS occ, sum(n) AS total FROM c GROUP BY ALL) SELECT row_id, size, round(avg(total / (n * occ)), 6) AS weight FROM s JOIN c USING (size, o, cx, cy) JOIN k USING (size, o) GROUP BY ALL")
def a12(s, d):
    return rounded(frame.decluster(T.points(s, d), [20.0, 50.0, 110.0]), "weight")


@query("A13_soft_calibration", "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS class, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN l_extendedprice <= {t} THEN 1.0 ELSE 0.0 END), 6) AS p{i}" for i, t in enumerate((20000, 40000, 60000))) + " FROM lineitem GROUP BY ALL")
def a13(s, d):
    return rounded(frame.soft_calibration(T.table(s, d, "lineitem"), "l_extendedprice", F.floor(F.col("l_quantity") / 10), [20000, 40000, 60000]), "p0", "p1", "p2")


@query("A16_value_counts", f"WITH g AS ({_GRID}) SELECT cat, count(*) AS count FROM g GROUP BY cat")
def a16(s, d):
    return frame.value_counts(T.grid(s, d), "cat")


# --- drill holes
@query("W1_distance_to_next", f"WITH s AS (SELECT * FROM ({_SEG}) WHERE z1 - z0 <= 24) SELECT row_id, round(coalesce(lead(z0) OVER (PARTITION BY hole ORDER BY z0, row_id) - z1, 0), 6) AS gap FROM s")
def w1(s, d):
    return rounded(markov.distance_to_next(T.segments(s, d, True)), "gap").select("row_id", "gap")


_ALONG = f"s AS (SELECT * FROM ({_SEG}) WHERE z1 - z0 <= 24), g AS (SELECT *, coalesce(lead(z0) OVER (PARTITION BY hole ORDER BY z0, row_id) - z1, 0) AS gap FROM s), a AS (SELECT *, coalesce(sum(z1 - z0 + gap) OVER (PARTITION BY hole ORDER BY z0, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along FROM g)"


@query("W2_distance_along", f"WITH {_ALONG} SELECT row_id, round(along, 5) AS along FROM a")
def w2(s, d):
    return rounded(markov.distance_along(T.segments(s, d, True)), "along", digits=5).select("row_id", "along")


_SEQ = f"s AS (SELECT * FROM ({_SEG}) WHERE z1 - z0 <= 24), b AS (SELECT *, CASE WHEN least(abs(z0 - lag(z1) OVER w), abs(z1 - lag(z0) OVER w), abs(z0 - lag(z0) OVER w), abs(z1 - lag(z1) OVER w)) > 1e-6 THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY hole ORDER BY z0, row_id)), q AS (SELECT *, sum(brk) OVER (PARTITION BY hole ORDER BY z0, row_id) AS seq FROM b), t AS (SELECT cat AS \"from\", lead(cat) OVER (PARTITION BY hole, seq ORDER BY z0, row_id) AS \"to\" FROM q WHERE cat IS NOT NULL), f AS (SELECT \"from\", \"to\", count(*) AS n FROM t WHERE \"to\" IS NOT NULL GROUP BY ALL)"


@query("W3_gap_breaks", f"WITH {_SEQ} SELECT row_id, CAST(seq AS BIGINT) AS seq FROM q")
def w3(s, d):
    return markov.gap_breaks(T.segments(s, d, True)).select("row_id", "seq")


def _ftm(s, d):
    return markov.transition_counts(T.segments(s, d, True))


@query("C1_transition_counts", f"WITH {_SEQ} SELECT * FROM f")
def c1(s, d):
    return _ftm(s, d)


@query("C4_probabilities", f"WITH {_SEQ} SELECT \"from\", \"to\", n, round(n / sum(n) OVER (PARTITION BY \"from\"), 6) AS up, round(n / sum(n) OVER (PARTITION BY \"to\"), 6) AS down FROM f")
def c4(s, d):
    return rounded(markov.probabilities(_ftm(s, d)), "up", "down")


_FULL = 'c AS (SELECT "from" AS c FROM f UNION SELECT "to" FROM f), w AS (SELECT a.c AS "from", b.c AS "to", coalesce(n, 0) AS n FROM c a CROSS JOIN c b LEFT JOIN f ON f."from" = a.c AND f."to" = b.c)'


@query("C5_rates", f"WITH {_SEQ}, m AS (SELECT cat, avg(z1 - z0) AS l FROM s WHERE cat IS NOT NULL GROUP BY cat), {_FULL}, o AS (SELECT \"from\", \"to\", CASE WHEN \"from\" = \"to\" THEN -1.0 ELSE n / sum(n) OVER (PARTITION BY \"from\") END AS p FROM w) SELECT \"from\", \"to\", round(p / l, 6) AS rate FROM o JOIN m ON cat = \"from\"")
def c5(s, d):
    seg = T.segments(s, d, True)
    return rounded(markov.transition_rates(markov.transition_counts(seg), markov.mean_thickness(seg)), "rate")


@query("C6_entropy", f'WITH {_SEQ}, {_FULL}, o AS (SELECT *, n / sum(n) OVER (PARTITION BY "from") AS p, n / sum(n) OVER (PARTITION BY "to") AS q FROM w) SELECT a.cat, round(post, 6) AS post, round(pre, 6) AS pre FROM (SELECT "from" AS cat, -sum(CASE WHEN "from" <> "to" AND p > 0 THEN p * log2(p) ELSE 0 END) / log2(4) AS post FROM o GROUP BY 1) a JOIN (SELECT "to" AS cat, -sum(CASE WHEN "from" <> "to" AND q > 0 THEN q * log2(q) ELSE 0 END) / log2(4) AS pre FROM o GROUP BY 1) b USING (cat)')
def c6(s, d):
    return rounded(markov.entropies(_ftm(s, d), 5), "post", "pre")


def _exp(f):
    return f'{f}, {_FULL}, r AS (SELECT *, sum(n) OVER (PARTITION BY "from") AS rs, sum(n) OVER (PARTITION BY "to") AS cs, sum(n) OVER () AS tt FROM w), x AS (SELECT *, CASE WHEN "from" = "to" THEN 0.0 ELSE cs / (tt - rs) END AS trail, CASE WHEN "from" = "to" THEN 0.0 ELSE n / rs - cs / (tt - rs) END AS difference FROM r)'


@query("C7_expected", f'WITH {_exp(_SEQ)} SELECT "from", "to", n, round(trail, 6) AS trail, round(difference, 6) AS difference, round(trail * rs, 4) AS expected FROM x')
def c7(s, d):
    return markov.expected(_ftm(s, d)).withColumns({"trail": F.round("trail", 6), "difference": F.round("difference", 6), "expected": F.round("expected", 4)})


@query("C8_chi_squared", f"WITH {_exp(_SEQ)} SELECT round(sum(CASE WHEN trail * rs > 0 THEN (n - trail * rs) * (n - trail * rs) / (trail * rs) END), 4) AS chi2 FROM x")
def c8(s, d):
    return rounded(markov.chi_squared(_ftm(s, d)), "chi2", digits=4)


@query("C2_transition_counts_at", f"WITH {_ALONG}, st AS (SELECT hole, k, cat, along, row_id FROM a, range(0, 2000) t(k) WHERE k * 5.5 >= along AND k * 5.5 <= along + z1 - z0), m AS (SELECT hole, k, arg_min(cat, (along, row_id)) AS cat FROM st GROUP BY ALL), t AS (SELECT cat AS \"from\", lead(cat) OVER (PARTITION BY hole ORDER BY k) AS \"to\" FROM m WHERE cat IS NOT NULL) SELECT \"from\", \"to\", count(*) AS n FROM t WHERE \"to\" IS NOT NULL GROUP BY ALL")
def c2(s, d):
    return markov.transition_counts_at(T.segments(s, d, True), 5.5).drop("h")


@query("C11_vpc", f"WITH s AS ({_SEG}), c AS (SELECT CAST(k AS BIGINT) AS d, cat, least(z1, 100 + k * 10.0 + 12.5, 500) - greatest(z0, 100 + k * 10.0 - 12.5, 100) AS len FROM s, range(0, 41) t(k) WHERE cat IS NOT NULL), l AS (SELECT d, cat, sum(len) AS len FROM c WHERE len > 0 GROUP BY ALL) SELECT d, cat, round(len, 4) AS len, round(len / sum(len) OVER (PARTITION BY d), 6) AS p FROM l")
def c11(s, d):
    return markov.vpc(T.segments(s, d), 100, 500, 40, 25).select("d", "cat", F.round("len", 4).alias("len"), F.round("p", 6).alias("p"))


@query("G12_segments_to_points", f"WITH s AS ({_SEG}) SELECT row_id, hole, CAST(n AS BIGINT) AS n, round(z0 + n * 4.3, 6) AS z FROM s, range(0, 1000) t(n) WHERE n <= floor((z1 - z0) / 4.3)")
def g12(s, d):
    return rounded(markov.to_points(T.segments(s, d), 4.3), "z").select("row_id", "hole", F.col("n").cast("bigint").alias("n"), "z")


# --- grids
@query("G2_index", f"WITH g AS ({_GRID}) SELECT cell, i, j, round(10 + (i + 0.5) * 2, 6) AS x, round(20 + (j + 0.5) * 3, 6) AS y FROM g")
def g2(s, d):
    return spatial.center_of(GridSpec(100, 1 << 20, 1, 10, 20, 0, 2, 3, 1), T.grid(s, d).withColumn("k", F.lit(0))).select("cell", "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("G4_resample", f"WITH g AS ({_GRID}) SELECT CAST(i // 4 AS INTEGER) AS i, CAST(j // 3 AS INTEGER) AS j, v FROM g WHERE i % 4 = 0 AND j % 3 = 0")
def g4(s, d):
    return grids.resample(T.grid(s, d), 4, 3).select("i", "j", "v")


@query("G5_subgrid", f"WITH g AS ({_GRID}) SELECT i - 10 AS i, j - 5 AS j, v FROM g WHERE i BETWEEN 10 AND 89 AND j BETWEEN 5 AND (SELECT max(j) FROM g) - 5")
def g5(s, d):
    g = T.grid(s, d)
    return grids.subgrid(g, (10, 89), (5, g.agg(F.max("j")).first()[0] - 5)).select("i", "j", "v")


@query("G7_flip", f"WITH g AS ({_GRID}) SELECT 99 - i AS i, j, v FROM g")
def g7(s, d):
    return grids.flip(T.grid(s, d), "i", 100).select("i", "j", "v")


@query("W5_neigh", f"WITH g AS ({_GRID}) SELECT g.cell, g.v, h.v AS neigh FROM g LEFT JOIN g h ON h.i = g.i + 1 AND h.j = g.j - 2")
def w5(s, d):
    return grids.neigh(T.grid(s, d), "v", 1, -2).select("cell", "v", "neigh")


@query("K1_window_mean", f"WITH g AS ({_GRID}) SELECT g.cell, round(avg(h.v) + 1e-7, 4) AS mean FROM g JOIN g h ON h.i BETWEEN g.i - 3 AND g.i + 3 AND h.j BETWEEN g.j - 3 AND g.j + 3 GROUP BY g.cell")
def k1(s, d):
    return grids.window_mean(T.grid(s, d), "v", 3).select("cell", F.round(F.col("mean") + 1e-7, 4).alias("mean"))


@query("K1_window_median", f"WITH g AS ({_GRID}) SELECT g.i, g.j, round(median(h.v), 4) AS median FROM g JOIN g h ON h.i BETWEEN g.i - 1 AND g.i + 1 AND h.j BETWEEN g.j - 1 AND g.j + 1 GROUP BY ALL")
def k1m(s, d):
    return rounded(grids.window_median(T.grid(s, d), "v", 1), "median", digits=4)


@query("K3_extrema", f"WITH g AS ({_GRID}) SELECT g.cell, coalesce(any_value(g.v) >= max(h.v), false) AS is_max, coalesce(any_value(g.v) <= min(h.v), false) AS is_min FROM g JOIN g h ON h.i BETWEEN g.i - 2 AND g.i + 2 AND h.j BETWEEN g.j - 2 AND g.j + 2 GROUP BY g.cell")
def k3(s, d):
    return grids.extrema(T.grid(s, d), "v", 2).select("cell", "is_max", "is_min")


_S1 = {"mean": ("avg(v)", 4), "variance": ("var_pop(v)", 1), "q25": ("quantile_cont(v, 0.25)", 4), "q50": ("quantile_cont(v, 0.5)", 4), "q75": ("quantile_cont(v, 0.75)", 4), "above": ("avg(CASE WHEN v > 30000 THEN 1.0 ELSE 0.0 END)", 6), "mean_above": ("avg(CASE WHEN v > 30000 THEN v END)", 4)}


# a small amount is added before rounding, on both sides, since means of cents often lie halfway
@query("S1_post_sim", f"WITH e AS ({_ENS}) SELECT cell, count(v) AS n, " + ", ".join(f"round({e} + 1.7e-{k + 3}, {k}) AS {c}" for c, (e, k) in _S1.items()) + " FROM e GROUP BY cell")
def s1(s, d):
    return grids.post_sim(T.ensemble(s, d), 30000).withColumns({c: F.round(F.col(c) + 1.7 * 10.0 ** -(k + 3), k) for c, (_, k) in _S1.items()})


_SHARES = "SELECT l_orderkey AS cell, " + ", ".join(f"avg(CASE WHEN l_returnflag = '{f}' THEN 1.0 ELSE 0.0 END) AS p{f}" for f in "ANR") + " FROM lineitem GROUP BY ALL"


def _shares(s, d):
    return T.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(*[F.avg(F.when(F.col("l_returnflag") == f, 1.0).otherwise(0.0)).alias(f"p{f}") for f in "ANR"])


@query("T5_facies", f"WITH s AS ({_SHARES}) SELECT cell, CASE WHEN pA >= pN AND pA >= pR THEN 1 WHEN pN >= pR THEN 2 ELSE 3 END AS facies FROM s")
def t5(s, d):
    return _shares(s, d).select("cell", grids.facies({1: F.col("pA"), 2: F.col("pN"), 3: F.col("pR")}).alias("facies"))


@query("F12_tau", f"WITH s AS ({_SHARES}), o AS (SELECT cell, pA, CASE WHEN pA <= 0 THEN 1000.0 ELSE (1 - pA) / pA END AS a FROM s) SELECT cell, round(1 / (1 + (0.7 / 0.3) * pow(a / (0.7 / 0.3), 1.5)), 6) AS p FROM o")
def f12(s, d):
    return _shares(s, d).select("cell", F.round(S.tau_combine(F.lit(0.3), [F.col("pA")], [1.5]), 6).alias("p"))


# --- functions
@query("F1_decibel", f"WITH p AS ({_PT}) SELECT row_id, round(10 * log10(greatest(abs(v), 1e-10) / 50), 6) AS db, round(v, 6) AS back, round(2 * v, 6) AS louder FROM p")
def f1(s, d):
    v, db = F.col("v"), S.decibel(F.col("v"), 50)
    return rounded(T.points(s, d).select("row_id", db.alias("db"), S.undecibel(db, 50, v < 0).alias("back"), S.equalized(v, 10 * math.log10(2), 50).alias("louder")), "db", "back", "louder")


_AZ = "CASE WHEN x = 500 THEN CASE WHEN y < 500 THEN 180 ELSE 0 END ELSE 90 - degrees(atan((y - 500) / (x - 500))) + {} END"


@query("F2_azimuth", f"WITH p AS ({_PT}) SELECT row_id, round({_AZ.format('CASE WHEN x < 500 THEN 180 ELSE 0 END')}, 6) AS azimuth, round({_AZ.format('0')}, 6) AS half FROM p")
def f2(s, d):
    x, y = F.col("x"), F.col("y")
    return rounded(T.points(s, d).select("row_id", S.azimuth(x, y, 500, 500).alias("azimuth"), S.azimuth(x, y, 500, 500, True).alias("half")), "azimuth", "half")


_POS = "list_transform(embedding, lambda e: abs(e::DOUBLE) + 0.001)"


@query("F4_unitize", f"WITH a AS (SELECT vec_id, {_POS} AS a FROM embeddings), b AS (SELECT vec_id, unnest(a) AS e, unnest(range(1, len(a) + 1)) AS k FROM a), c AS (SELECT *, e / sum(e) OVER w AS u, exp(e) / sum(exp(e)) OVER w AS m FROM b WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, round(sum(u * k), 6) AS unitized, round(sum(m * k), 6) AS softmax, round(max(m), 6) AS top, abs(sum(u) - 1) <= 1e-6 AS one, CAST(min(k) FILTER (c >= 0.5) - 1 AS INTEGER) AS drawn FROM (SELECT *, sum(u) OVER (PARTITION BY vec_id ORDER BY k) AS c FROM c) GROUP BY vec_id")
def f4(s, d):
    weighted = lambda a: F.aggregate(F.transform(a, lambda e, k: e * (k + 1)), F.lit(0.0), lambda t, e: t + e)
    e = T.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.001).alias("a"))
    e = e.select("vec_id", S.unitize(F.col("a")).alias("u"), S.softmax(F.col("a")).alias("m"))
    return e.select("vec_id", F.round(weighted("u"), 6).alias("unitized"), F.round(weighted("m"), 6).alias("softmax"), F.round(F.array_max("m"), 6).alias("top"), S.sums_to_one(F.col("u")).alias("one"), S.draw_index(F.col("u"), F.lit(0.5)).alias("drawn"))


@query("F10_gamma", f"WITH p AS ({_PT}), h AS (SELECT row_id, x, y, z, sqrt(pow((x * sin(radians(30)) + y * cos(radians(30))) / 60, 2) + pow((-x * cos(radians(30)) + y * sin(radians(30))) / 30, 2) + pow(z / 20, 2)) AS h1, sqrt(pow(x / 200, 2) + pow(y / 200, 2) + pow(z / 50, 2)) AS h2 FROM p) SELECT row_id, CASE WHEN x = 0 AND y = 0 AND z = 0 THEN 0.0 ELSE round(0.1 + 0.6 * CASE WHEN h1 >= 1 THEN 1 ELSE 1.5 * h1 - 0.5 * h1 * h1 * h1 END + 0.3 * (1 - exp(-3 * h2)), 6) END AS gamma FROM h")
def f10(s, d):
    return rounded(spatial.model_surface(T.points(s, d), _MODEL), "gamma").select("row_id", "gamma")


@query("F16_trend", f"WITH p AS ({_PT}) SELECT row_id, round(x * x * 0.001 - 0.002 * y * y + 0.3 * z * z + 0.01 * x * y - 0.02 * x * z + 0.03 * y * z + x - 2 * y + 3 * z, 4) AS t FROM p")
def f16(s, d):
    return T.points(s, d).select("row_id", F.round(S.quadratic_trend(F.col("x"), F.col("y"), F.col("z"), (0.001, -0.002, 0.3, 0.01, -0.02, 0.03, 1.0, -2.0, 3.0)), 4).alias("t"))


# --- distributions
_CDF = f"p AS ({_PT}), u AS (SELECT v AS value, CAST(count(*) AS DOUBLE) AS w FROM p WHERE v IS NOT NULL GROUP BY v)"


@query("D3_cdf", f"WITH {_CDF} SELECT value, w, round((sum(w) OVER (ORDER BY value) - w / 2) / sum(w) OVER (), 6) AS p FROM u")
def d3(s, d):
    return rounded(frame.cdf_table(T.points(s, d), "v"), "p")


def _horner(c, x):
    out = "0.0"
    for k in c:
        out = f"({out} * {x} + ({k!r}))"
    return out


_TAIL = f"{_horner(frame._C, 't')} / ({_horner(frame._D, 't')} * t + 1)"
_SCORE = f"{_CDF}, m AS (SELECT value, (sum(w) OVER (ORDER BY value) - w / 2) / sum(w) OVER () AS p FROM u), n AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM m), z AS (SELECT value, CASE WHEN p < 0.02425 THEN {_TAIL} WHEN p > 1 - 0.02425 THEN -({_TAIL}) ELSE {_horner(frame._A, 'r')} * q / ({_horner(frame._B, 'r')} * r + 1) END AS score FROM n)"


@query("D1_normal_score", f"WITH {_SCORE} SELECT row_id, v, round(score, 6) AS score FROM p LEFT JOIN z ON v = value")
def d1(s, d):
    return rounded(frame.normal_score(T.points(s, d), "v"), "score").select("row_id", "v", "score")


@query("D7_bivariate", f"WITH p AS ({_PT}) SELECT CAST(floor(x / 200) AS BIGINT) AS bx, CAST(floor(v / 2000) AS BIGINT) AS by, round(count(*) / (SELECT count(*) FROM p), 6) AS p FROM p GROUP BY ALL")
def d7(s, d):
    return rounded(frame.bivariate(T.points(s, d), "x", "v", 200, 2000), "p")


_TERMS = ("x * x", "y * y", "z * z", "x * y", "x * z", "y * z", "x", "y", "z")
_SUMS = {f"a{i}{j}": f"sum({_TERMS[i]} * {_TERMS[j]})" for i in range(9) for j in range(i, 9)} | {f"b{i}": f"sum({t} * v)" for i, t in enumerate(_TERMS)}


# sums of all magnitudes: compared in units of their leading digit
@query("E11_trend_sums", f"WITH p AS ({_PT}), t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _SUMS.items())} FROM p WHERE v IS NOT NULL), r AS (UNPIVOT t ON COLUMNS(*) INTO NAME name VALUE value) SELECT name, round(value / pow(10, floor(log10(abs(value)))), 6) AS leading, CAST(floor(log10(abs(value))) AS BIGINT) AS power FROM r")
def e11(s, d):
    power = F.floor(F.log10(F.abs("value")))
    out = frame.trend_sums(T.points(s, d), "v").unpivot([], list(_SUMS), "name", "value")
    return out.select("name", F.round(F.col("value") / F.pow(F.lit(10.0), power), 6).alias("leading"), power.alias("power"))


# --- joins by place
def _to_micro(c: str) -> Column:
    """Six digits of very many rows: F.round goes by decimals, which costs more than making a pair."""
    return (F.rint(F.col(c) * 1e6) / 1e6).alias(c)


@query("J1_within_distance", f"WITH p AS ({_PT}) SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS d FROM p a JOIN p b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 650.25")
def j1(s, d):
    p = T.points(s, d).select("row_id", "x", "y", "z")
    return spatial.within_distance(p, p, 25.5, carry=("row_id",)).select("row_id_a", "row_id_b", _to_micro("d"))


@query("J2_knn", f"WITH p AS ({_PT}), q AS ({_PS}) SELECT q.row_id AS row_id_a, p.row_id AS row_id_b, CAST(row_number() OVER w AS INTEGER) AS rank FROM q JOIN p ON p.row_id <> q.row_id WINDOW w AS (PARTITION BY q.row_id ORDER BY sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)), p.row_id) QUALIFY row_number() OVER w <= 4")
def j2(s, d):
    return spatial.knn(T.few_points(s, d).select("row_id", "x", "y"), T.points(s, d).select("row_id", "x", "y"), 4, 40.0, "xy").select("row_id_a", "row_id_b", "rank")


@query("J5_ellipsoid", f"WITH p AS ({_PT}), q AS ({_PS}), n AS (SELECT q.row_id AS row_id_a, p.row_id AS row_id_b, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS d FROM q JOIN p ON pow((p.x-q.x)/60.5,2)+pow((p.y-q.y)/30.5,2) <= 1) SELECT row_id_a, row_id_b, CAST(row_number() OVER w AS INTEGER) AS rank FROM n WINDOW w AS (PARTITION BY row_id_a ORDER BY d, row_id_b) QUALIFY row_number() OVER w <= 6")
def j5(s, d):
    near = spatial.nearest_pairs(T.few_points(s, d), T.points(s, d), 6, 60.6, "xy", lambda dx, dy: spatial.in_ellipsoid(dx, dy, 0.0, (60.5, 30.5, 1.0)), carry=("row_id",))
    return near.select("row_id_a", "row_id_b", "rank")


@query("J8_close_samples", "WITH p AS (SELECT p_partkey AS row_id, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part) SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS d FROM p a JOIN p b ON a.row_id < b.row_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 2.25")
def j8(s, d):
    return spatial.close_samples(T.parts(s, d).select("row_id", "x", "y"), 1.5).withColumn("d", _to_micro("d"))


@query("J9_grid_to_points", f"WITH p AS ({_PT}), g AS ({_GRID}) SELECT p.row_id, g.v AS cell_value FROM p LEFT JOIN g ON g.i = floor(p.x / 10) AND g.j = floor(p.y / 10) AND p.x < 1000")
def j9(s, d):
    spec = GridSpec(100, 1 << 20, 1, 0, 0, 0, 10, 10, 1)
    return spatial.collocate_grid_to_points(T.points(s, d), T.grid(s, d).withColumn("k", F.lit(0)), spec, "v").select("row_id", "cell_value")


@query("J10_points_to_grid", f"WITH p AS ({_PT}), g AS ({_GRID}), c AS (SELECT floor(x / 10) AS i, floor(y / 10) AS j, arg_max(v, row_id) AS point_value FROM p WHERE x < 1000 GROUP BY ALL) SELECT g.cell, c.point_value FROM g LEFT JOIN c ON g.i = c.i AND g.j = c.j")
def j10(s, d):
    spec = GridSpec(100, 1 << 20, 1, 0, 0, 0, 10, 10, 1)
    return spatial.collocate_points_to_grid(T.points(s, d), T.grid(s, d).withColumn("k", F.lit(0)), spec, "v").select("cell", "point_value")


@query("V1_variogram_points", f"WITH p AS ({_PT}), q AS (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, (a.v-b.v)*(a.v-b.v)/2 AS g FROM p a JOIN p b ON a.row_id < b.row_id) SELECT CAST(floor(d / 10.05) AS INTEGER) AS lag, count(*) AS n, round(avg(d), 6) AS h, round(avg(g), 2) AS gamma FROM q WHERE d > 0 AND d < 100.5 GROUP BY ALL")
def v1(s, d):
    return spatial.variogram_points(T.points(s, d), "v", "v", 10.05, 10).withColumns({"h": F.round("h", 6), "gamma": F.round("gamma", 2)})


@query("V2_variogram_grid", f"WITH g AS ({_GRID}), o AS (SELECT dir, k, CASE dir WHEN 0 THEN k ELSE k END AS di, CASE dir WHEN 0 THEN 0 ELSE k END AS dj FROM range(2) a(dir), range(1, 11) b(k)) SELECT CAST(dir AS INTEGER) AS dir, CAST(k AS INTEGER) AS lag, count(*) AS n, round(avg((a.v-b.v)*(a.v-b.v)/2), 0) AS gamma FROM g a, o, g b WHERE b.i = a.i + di AND b.j = a.j + dj AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL")
def v2(s, d):
    return rounded(spatial.variogram_grid(T.grid(s, d), "v", [(1, 0), (1, 1)], 10), "gamma", digits=0)


@query("A9_contact_analysis", f"WITH p AS ({_PT}), n AS (SELECT a.row_id, a.v, a.dom, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM p a JOIN p b ON a.dom IN (1, 2) AND b.dom = 3 - a.dom GROUP BY ALL) SELECT CAST(dom - 1 AS INTEGER) AS side, CAST(ceil(d / 8.05) AS INTEGER) AS lag, count(v) AS n, round(avg(v), 4) AS mean FROM n WHERE d > 0 AND d <= 80.5 GROUP BY ALL")
def a9(s, d):
    return rounded(spatial.contact_analysis(T.points(s, d), "dom", "v", 1, 2, 8.05, 10), "mean", digits=4)


@query("E9_shepard", f"WITH p AS ({_PS}), g AS ({_PT}), q AS (SELECT g.row_id, p.v, sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)) AS d FROM g JOIN p ON sqrt((g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)) < 80.5) SELECT row_id, round(coalesce(avg(CASE WHEN d = 0 THEN v END), sum(CASE WHEN d > 0 THEN v / (d * d) END) / sum(CASE WHEN d > 0 THEN 1 / (d * d) END)), 4) AS estimate FROM q GROUP BY row_id")
def e9(s, d):
    return rounded(spatial.shepard(T.points(s, d), T.few_points(s, d), "v", 80.5), "estimate", digits=4)


@query("E1_krige")
def e1(s, d):
    return spatial.krige(T.points(s, d).drop("v", "dom", "z"), T.few_points(s, d).drop("z"), "v", _MODEL, 150.5)


@query("E3_cross_validate")
def e3(s, d):
    p = T.few_points(s, d).drop("z")
    return spatial.krige(p, p, "v", _MODEL, 150.5, leave_out_self=True).join(p.select("row_id", "v"), "row_id")


@query("K2_fft")
def k2(s, d):
    g = T.grid(s, d).select(F.lit(1).alias("real"), "i", "j", F.coalesce("v", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    return grids.fft(g)


@query("J4_in_z_interval", f"WITH s AS ({_SEG}), w AS (SELECT p_partkey AS interval, p_size * 10.0 AS low, p_size * 10.0 + p_partkey % 7 AS high FROM part) SELECT row_id, count(*) AS n, sum(interval) AS intervals FROM s JOIN w ON z0 <= high AND z1 >= low GROUP BY row_id")
def j4(s, d):
    low = F.col("p_size") * 10.0
    windows = T.table(s, d, "part").select(F.col("p_partkey").alias("interval"), low.alias("low"), (low + F.col("p_partkey") % 7).alias("high"))
    return markov.sums_in_z_interval(T.segments(s, d).select("row_id", "z0", "z1"), windows, 10.0)


@query("W4_cumulative_proportions", "WITH n AS (SELECT l_linenumber AS d, dense_rank() OVER (ORDER BY l_returnflag) AS cat FROM lineitem), c AS (SELECT d, cat, count(*) AS n FROM n GROUP BY ALL), p AS (SELECT d, cat, n / sum(n) OVER (PARTITION BY d) AS p FROM c) SELECT d, cat, round(sum(p) OVER (PARTITION BY d ORDER BY cat), 6) AS cum FROM p")
def w4(s, d):
    modes = T.table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("d"), "l_returnflag").count()
    by = Window.partitionBy("d")
    curve = modes.select("d", F.row_number().over(by.orderBy("l_returnflag")).alias("cat"), (F.col("count") / F.sum("count").over(by)).alias("p"))
    return markov.cumulative_proportions(curve).select("d", "cat", F.round("cum", 6).alias("cum"))


@query("A14_global_pdf", "SELECT 'discount' AS indicator, round(avg(l_discount * 10), 6) AS p FROM lineitem UNION ALL SELECT 'tax', round(avg(l_tax * 10), 6) FROM lineitem")
def a14(s, d):
    soft = T.table(s, d, "lineitem").select((F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"))
    return rounded(frame.global_pdf(soft, ["discount", "tax"]), "p")


@query("A15_trend_errors", f"WITH p AS ({_PT}) SELECT 0 AS candidate, round(avg(abs(v - (x + 2 * y))), 4) AS error FROM p UNION ALL SELECT 1, round(avg(abs(v - (0.01 * x * x - 0.02 * y * z + 3 * z))), 4) FROM p")
def a15(s, d):
    return rounded(frame.trend_errors(T.points(s, d), "v", [(0, 0, 0, 0, 0, 0, 1, 2, 0), (0.01, 0, 0, 0, 0, -0.02, 0, 0, 3)]), "error", digits=4)


@query("F6_draw_category", "SELECT o_orderkey, CASE WHEN u <= 0.25 THEN 1 WHEN u <= 0.625 THEN 2 WHEN u <= 0.875 THEN 5 END AS code FROM (SELECT o_orderkey, (o_orderkey * 7919 % 1000) / 1000.0 AS u FROM orders)")
def f6(s, d):
    pdf = s.createDataFrame([(1, 0.25), (2, 0.375), (5, 0.25)], "code int, p double")
    draws = T.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("u"))
    return frame.draw_category(pdf, draws).select("o_orderkey", "code")


# --- sets of transition matrices, proportion curves
_STEP = f"s AS ({_SEG}), t AS (SELECT hole, cat AS f, lead(cat) OVER (PARTITION BY hole ORDER BY z0, row_id) AS t FROM s WHERE cat IS NOT NULL)"


def _counts(s, d, where="true"):
    return markov.transition_counts(T.segments(s, d).where(where), ignore_gaps=True)


@query("U1_sum_counts", f'WITH {_STEP} SELECT f AS "from", t AS "to", count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL')
def u1(s, d):
    return markov.sum_counts([_counts(s, d, "hole % 2 = 0"), _counts(s, d, "hole % 2 = 1")])


@query("U2_drop_empty", f'WITH {_STEP} SELECT hole % 3 AS h, f AS "from", t AS "to", sum(CASE WHEN f <> 2 AND t <> 3 THEN 1 ELSE 0 END) AS n FROM t WHERE f <> 2 AND t <> 3 GROUP BY ALL')
def u2(s, d):
    n = F.when((F.col("from") != 2) & (F.col("to") != 3), F.col("n")).otherwise(0)
    parts = [_counts(s, d, f"hole % 3 = {h}").select(F.lit(h).alias("h"), "from", "to", n.alias("n")) for h in range(3)]
    return markov.drop_empty(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# finer categories, by length too: with five, nothing is missing in half of the holes
@query("U3_inexistent", f'WITH s AS ({_SEG}), t AS (SELECT hole, c AS f, lead(c) OVER (PARTITION BY hole ORDER BY z0, row_id) AS t FROM (SELECT *, cat * 10 + least(CAST(floor((z1 - z0) / 6) AS BIGINT), 9) AS c FROM s) WHERE c IS NOT NULL), r AS (SELECT DISTINCT f, t FROM t WHERE hole % 2 = 0 AND t IS NOT NULL), q AS (SELECT f, t, count(*) AS n FROM t WHERE hole % 2 = 1 AND t IS NOT NULL GROUP BY ALL) SELECT f AS "from", t AS "to", round(up, 6) AS up FROM (SELECT f, t, n / sum(n) OVER (PARTITION BY f) AS up FROM q) WHERE up > 0.01 AND (f, t) NOT IN (SELECT (f, t) FROM r)')
def u3(s, d):
    fine = T.segments(s, d).withColumn("cat", F.col("cat") * 10 + F.least(F.floor((F.col("z1") - F.col("z0")) / 6), F.lit(9)))
    counts = lambda h: markov.transition_counts(fine.where(f"hole % 2 = {h}"), ignore_gaps=True)
    return rounded(markov.inexistent_transitions(counts(0), counts(1), 0.01), "up")


@query("C9_embedded", f"WITH {_STEP} SELECT count(*) FILTER (f = t) = 0 AS embedded FROM t WHERE t IS NOT NULL")
def c9(s, d):
    return markov.is_embedded(_counts(s, d))


@query("C10_next_category", f'WITH {_STEP}, q AS (SELECT f, t, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL), c AS (SELECT f, t, sum(n) OVER (PARTITION BY f ORDER BY t) / sum(n) OVER (PARTITION BY f) AS c FROM q) SELECT row_id, (SELECT min(t) FROM c WHERE f = cat AND c >= (row_id * 37 % 1000) / 1000 + 0.0003) AS "next" FROM s WHERE cat IS NOT NULL')
def c10(s, d):
    draws = T.segments(s, d).where("cat IS NOT NULL").withColumn("u", (F.col("row_id") * 37 % 1000) / 1000 + 0.0003)
    return markov.next_category(_counts(s, d), draws).select("row_id", "next")


_ALL = f'{_STEP}, f AS (SELECT f AS "from", t AS "to", count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL)'


@query("C16_edges", f'WITH {_exp(_ALL)} SELECT "from", "to", round(difference, 6) AS difference FROM x WHERE difference > -0.07')
def c16(s, d):
    return rounded(markov.relationship_edges(_counts(s, d), -0.07), "difference")


def _curve_sql(name, where):
    return f"{name} AS (SELECT d, cat, len / sum(len) OVER (PARTITION BY d) AS p FROM (SELECT d, cat, sum(least(z1, d * 10 + 10, 200) - greatest(z0, d * 10 - 10, 0)) AS len FROM s, range(0, 21) t(d) WHERE cat IS NOT NULL AND {where} AND least(z1, d * 10 + 10, 200) > greatest(z0, d * 10 - 10, 0) GROUP BY d, cat))"


_MEAN = f"WITH s AS ({_SEG}), {_curve_sql('a', 'hole % 2 = 0')}, {_curve_sql('b', 'hole % 2 = 1')}, m AS (SELECT d, cat, p / sum(p) OVER (PARTITION BY d) AS p FROM (SELECT d, cat, sum(p) AS p FROM (FROM a UNION ALL FROM b) GROUP BY d, cat)), f AS (SELECT t.d, c.cat, coalesce(m.p, 0) AS p FROM range(0, 21) t(d) CROSS JOIN (SELECT DISTINCT cat FROM m) c LEFT JOIN m ON m.d = t.d AND m.cat = c.cat)"


def _mean_curve(s, d):
    one = lambda h: markov.vpc(T.segments(s, d).where(f"hole % 2 = {h}"), 0.0, 200.0, 20, 20.0).select(F.lit(h).alias("curve"), "d", "cat", "p")
    return markov.vpc_mean(one(0).unionByName(one(1)))


@query("C13_vpc_mean", f"{_MEAN} SELECT d, cat, round(p, 6) AS p FROM m")
def c13(s, d):
    return rounded(_mean_curve(s, d), "p")


@query("C14_vpc_at", f"{_MEAN} SELECT s_suppkey, f.cat, round(f.p + (x - f.d) * (g.p - f.p), 6) AS p FROM (SELECT s_suppkey, (s_suppkey * 13 % 997) / 997 * 20 AS x FROM supplier) JOIN f ON f.d = least(floor(x), 19) JOIN f g ON g.d = f.d + 1 AND g.cat = f.cat")
def c14(s, d):
    depths = T.table(s, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 13 % 997) / 997).alias("depth"))
    return rounded(markov.vpc_at(_mean_curve(s, d), depths, 20), "p").select("s_suppkey", "cat", "p")


@query("C15_fill_with_proportions", f"{_MEAN} SELECT o_orderkey AS cell, f.cat, round(f.p + (x - f.d) * (g.p - f.p), 6) AS p FROM (SELECT o_orderkey, (o_orderkey % 20 - 2 + 0.5) / 12 * 20 AS x FROM orders WHERE o_orderkey % 20 BETWEEN 2 AND 13) JOIN f ON f.d = least(floor(x), 19) JOIN f g ON g.d = f.d + 1 AND g.cat = f.cat")
def c15(s, d):
    layered = T.grid(s, d).select("cell", (F.col("cell") % 20).alias("k"))
    return rounded(markov.fill_with_proportions(layered, _mean_curve(s, d), 20, 2, 13), "p").select("cell", "cat", "p")


# --- piecewise linear tables
def _cdf_sql(name, source):
    return f"{name} AS (SELECT v, p, lead(v) OVER (ORDER BY v) AS v1, lead(p) OVER (ORDER BY v) AS p1, min(p) OVER () AS lo, max(p) OVER () AS hi FROM (SELECT v, (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS p FROM (SELECT v, count(*) AS w FROM {source} WHERE v IS NOT NULL GROUP BY v)))"


def _at(cdf, u):
    return f"least(greatest({u}, {cdf}.lo), {cdf}.hi) >= {cdf}.p AND (least(greatest({u}, {cdf}.lo), {cdf}.hi) < {cdf}.p1 OR {cdf}.p1 = {cdf}.hi AND {u} >= {cdf}.hi)"


def _value(cdf, u):
    return f"{cdf}.v + (least(greatest({u}, {cdf}.lo), {cdf}.hi) - {cdf}.p) * ({cdf}.v1 - {cdf}.v) / ({cdf}.p1 - {cdf}.p)"


@query("F7_draw_value", f"WITH q AS ({_PS}), {_cdf_sql('c', 'q')}, u AS (SELECT c_custkey AS row_id, (c_custkey * 7919 % 1000) / 1000 + 0.0003 AS u FROM customer) SELECT row_id, round({_value('c', 'u.u')}, 4) AS drawn FROM u JOIN c ON {_at('c', 'u.u')}")
def f7(s, d):
    draws = T.points(s, d).select("row_id", ((F.col("row_id") * 7919 % 1000) / 1000 + 0.0003).alias("u"))
    return rounded(lookup.draw_value(draws, "u", frame.cdf_table(T.few_points(s, d), "v")), "drawn", digits=4).select("row_id", "drawn")


@query("D4_qq_table", f"WITH x AS ({_PT}), y AS ({_PS}), {_cdf_sql('c', 'x')}, {_cdf_sql('e', 'y')}, u AS (SELECT range AS q, (range + 0.5) / 50 AS u FROM range(0, 50)) SELECT q, round({_value('c', 'u.u')}, 4) AS a, round({_value('e', 'u.u')}, 4) AS b FROM u JOIN c ON {_at('c', 'u.u')} JOIN e ON {_at('e', 'u.u')}")
def d4(s, d):
    return rounded(lookup.qq_table(T.points(s, d), T.few_points(s, d), "v", "v", 50), "a", "b", digits=4)


@query("D2_back_transform", f"WITH {_SCORE} SELECT row_id, v, round(score, 6) AS score, round(v, 4) AS back FROM p JOIN z ON v = value")
def d2(s, d):
    p = T.points(s, d)
    transform = frame.cdf_table(p, "v").select("value", frame.inverse_normal(F.col("p")).alias("score"))
    out = lookup.back_transform(frame.normal_score(p, "v").select("row_id", "v", "score"), "score", transform, "back")
    return out.withColumns({"score": F.round("score", 6), "back": F.round("back", 4)})


@query("F8_chi2_pdf", "SELECT l_orderkey, l_linenumber, l_partkey, round(exp(1.5 * ln(l_quantity) - l_quantity / 2 - (2.5 * ln(2) + lgamma(2.5))), 8) AS pdf FROM lineitem")
def f8(s, d):
    return rounded(T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.chi2_pdf(F.col("l_quantity"), 5).alias("pdf")), "pdf", digits=8)


@query("F13_soft_indicators", f"WITH p AS ({_PT}) SELECT row_id, floor((CASE WHEN v <= 0 THEN 0 + (v + 1000) * 0.2 / 1000 WHEN v <= 5000 THEN 0.2 + v * (0.7::DOUBLE - 0.2::DOUBLE) / 5000 ELSE 0.7 + (v - 5000) * (1.0::DOUBLE - 0.7::DOUBLE) / 5000 END) * 1e4 + 0.5) / 1e4 AS soft FROM p")
def f13(s, d):
    return T.points(s, d).select("row_id", lookup.soft_indicator(F.col("v"), [(-1000.0, 0.0), (0.0, 0.2), (5000.0, 0.7), (10000.0, 1.0)]).alias("soft"))


@query("E5_post_ik", "WITH c AS (SELECT l_orderkey, avg(CASE WHEN l_extendedprice <= 20000 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN l_extendedprice <= 50000 THEN 1.0 ELSE 0.0 END) AS q FROM lineitem GROUP BY l_orderkey), m AS (SELECT *, p * 10000 + (q - p) * 35000 + (1 - q) * 80000 AS mean, p * 4e8 / 3 + (q - p) * 3.9e9 / 3 + (1 - q) * 2.01e10 / 3 - (p * 10000 + (q - p) * 35000 + (1 - q) * 80000) ** 2 AS variance, (q - p) * (2.0 / 3) + 1 - q AS above, (q - p) * (2.0 / 3) * 40000 + (1 - q) * 80000 AS s FROM c) SELECT l_orderkey, round(mean, 3) AS mean, round(variance, 0) AS variance, round(above, 6) AS above, CASE WHEN above > 0 THEN round(s / above, 3) END AS mean_above FROM m")
def e5(s, d):
    x = F.col("l_extendedprice")
    cdf = T.table(s, d, "lineitem").groupBy("l_orderkey").agg(*[F.avg(F.when(x <= t, 1.0).otherwise(0.0)).alias(c) for c, t in (("p", 20000), ("q", 50000))])
    out = lookup.post_ik(cdf, [20000.0, 50000.0], ["p", "q"], 0.0, 110000.0, 30000.0)
    return out.select("l_orderkey", F.round("mean", 3).alias("mean"), F.round("variance", 0).alias("variance"), F.round("above", 6).alias("above"), F.round("mean_above", 3).alias("mean_above"))


@query("S7_bootstrap")
def s7(s, d):
    return lookup.bootstrap(T.points(s, d).select("row_id", "v"), 11)


# --- meshes, other grids, variograms
_HOR = "h AS (SELECT CAST(o_orderkey % 100 AS INTEGER) AS i, CAST(o_orderkey // 100 AS INTEGER) AS j, -o_totalprice / 100000 AS top, -o_totalprice / 100000 - 5 - o_orderkey % 3 AS base FROM orders)"


def _horizons(s, d):
    g, k = T.table(s, d, "orders"), F.col("o_orderkey")
    i, j, top = (k % 100).cast("int"), F.floor(k / 100).cast("int"), -F.col("o_totalprice") / 100000
    return g.select(i.alias("i"), j.alias("j"), (i + 0.5).alias("x"), (j + 0.5).alias("y"), top.alias("top"), (top - 5 - k % 3).alias("base"))


@query("G13_vertices", f"WITH {_HOR} SELECT i, j, CAST(k AS INTEGER) AS k, i + 0.5::DOUBLE AS x, j + 0.5::DOUBLE AS y, round(base + k / 4 * (top - base), 9) AS z FROM h, range(0, 5) t(k)")
def g13(s, d):
    return rounded(mesh.vertices(_horizons(s, d), 4), "z", digits=9).select("i", "j", "k", "x", "y", "z")


@query("G15_mesh_centers", f"WITH {_HOR}, v AS (SELECT i, j, CAST(k AS INTEGER) AS k, base + k / 4 * (top - base) AS z FROM h, range(0, 5) t(k)) SELECT c.i, c.j, c.k, c.i + 1.0::DOUBLE AS cx, c.j + 1.0::DOUBLE AS cy, c.i + 0.5::DOUBLE AS min_x, c.j + 1.5::DOUBLE AS max_y, round(avg(v.z), 12) AS cz, round(min(v.z), 12) AS min_z, round(max(v.z), 12) AS max_z FROM v c JOIN v ON v.i BETWEEN c.i AND c.i + 1 AND v.j BETWEEN c.j AND c.j + 1 AND v.k BETWEEN c.k AND c.k + 1 GROUP BY c.i, c.j, c.k HAVING count(*) = 8")
def g15(s, d):
    return rounded(mesh.centers(mesh.cells(mesh.vertices(_horizons(s, d), 4))), "cz", "min_z", "max_z", digits=12).select("i", "j", "k", "cx", "cy", "min_x", "max_y", "cz", "min_z", "max_z")


@query("G14_mesh_zones", f"WITH {_HOR} SELECT a.i, a.j, CAST(k AS INTEGER) AS k, CASE WHEN k < 2 THEN 0 ELSE 1 END AS zone FROM h a JOIN h b ON b.i = a.i + 1 AND b.j = a.j JOIN h c ON c.i = a.i AND c.j = a.j + 1 JOIN h e ON e.i = a.i + 1 AND e.j = a.j + 1, range(0, 5) t(k)")
def g14(s, d):
    h = _horizons(s, d)
    below = h.select("i", "j", "x", "y", F.col("base").alias("top"), (F.col("base") - 3).alias("base"))
    return mesh.stack_zones([(mesh.cells(mesh.vertices(below, 2)), 2), (mesh.cells(mesh.vertices(h, 3)), 3)]).select("i", "j", "k", "zone")


def _volume_sql():
    at = {n: (f"{a}", f"{b}", f"z{n}") for n, (a, b, _) in enumerate(mesh.CORNERS)}

    def part(*n):
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = [[f"({u} - {v})" for u, v in zip(at[k], at[3])] for k in n]
        return f"abs({ax} * ({by} * {cz} - {bz} * {cy}) - {ay} * ({bx} * {cz} - {bz} * {cx}) + {az} * ({bx} * {cy} - {by} * {cx})) / 6"

    total = " + ".join(part(a, b, c) + " + " + part(a, c, e) for a, b, c, e in ((1, 2, 6, 5), (4, 5, 6, 7), (0, 1, 5, 4)))
    corners = ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in enumerate(mesh.CORNERS))
    vertex = f"v AS (SELECT i - a AS i, j - b AS j, CAST(k - c AS INTEGER) AS k, n, base + k / 4 * (top - base) AS z FROM h, range(0, 5) t(k), (VALUES {corners}) o(n, a, b, c))"
    cell = f"c AS (SELECT i, j, k, {', '.join(f'max(CASE WHEN n = {n} THEN z END) AS z{n}' for n in range(8))} FROM v GROUP BY i, j, k HAVING count(*) = 8)"
    return f"WITH {_HOR}, {vertex}, {cell} SELECT i, j, k, round({total} + 1.7e-8, 5) AS volume FROM c"


@query("G16_cell_volumes", _volume_sql())
def g16(s, d):
    volume = F.round(F.col("volume") + 1.7e-8, 5)
    return mesh.volumes(mesh.cells(mesh.vertices(_horizons(s, d), 4))).select("i", "j", "k", volume.alias("volume"))


@query("U5_stack_realizations", f"WITH g AS ({_GRID}) SELECT cell, v, 1 AS real FROM g UNION ALL SELECT cell, -v, 2 FROM g")
def u5(s, d):
    g = T.grid(s, d).select("cell", "v")
    return mesh.stack_realizations([g, g.withColumn("v", -F.col("v"))])


@query("G8_project", f"WITH g AS ({_GRID}), n AS (SELECT max(j) + 1 AS nj FROM g) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, coalesce(v, 0) AS v FROM n, range(0, 130) a(i) CROSS JOIN range(0, (SELECT max(j) + 31 FROM g)) b(j) LEFT JOIN g ON g.i = a.i - 15 AND g.j = b.j - 15")
def g8(s, d):
    g = T.grid(s, d)
    nj = g.agg(F.max("j")).first()[0] + 1
    return mesh.project(g, "v", (100, nj), (130, nj + 30))


@query("V5_varmap", f"WITH g AS ({_GRID}) SELECT CAST(x.di AS INTEGER) AS di, CAST(y.dj AS INTEGER) AS dj, count(*) AS n, round(avg((a.v - b.v) * (a.v - b.v) / 2) / 1e6, 2) AS gamma FROM range(-3, 4) x(di), range(-2, 3) y(dj), g a, g b WHERE b.i = a.i + x.di AND b.j = a.j + y.dj AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL")
def v5(s, d):
    return mesh.varmap(T.grid(s, d), "v", 3, 2).withColumn("gamma", F.round(F.col("gamma") / 1e6, 2))


@query("V4_variogram_realizations", f'WITH e AS ({_ENS}), g AS (SELECT "real", cell % 100 AS i, cell // 100 AS j, v FROM e) SELECT a."real", CAST(k AS INTEGER) AS lag, count(*) AS n, round(avg((a.v - b.v) * (a.v - b.v) / 2) / 1e6, 2) AS gamma FROM range(1, 4) t(k), g a, g b WHERE b."real" = a."real" AND b.i = a.i + k AND b.j = a.j GROUP BY ALL')
def v4(s, d):
    e = T.ensemble(s, d).withColumns({"i": F.col("cell") % 100, "j": F.floor(F.col("cell") / 100)})
    return spatial.variogram_grid(e, "v", [(1, 0)], 3, ("real",)).select("real", "lag", "n", F.round(F.col("gamma") / 1e6, 2).alias("gamma"))


@query("V3_cross_variogram", f"WITH p AS ({_PT}) SELECT CAST(floor(d / 10) AS INTEGER) AS lag, count(*) AS n, round(avg((v - w) * (y1 - y2) / 2), 2) AS gamma FROM (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.v AS v, b.v AS w, a.z AS y1, b.z AS y2 FROM p a JOIN p b ON a.row_id < b.row_id) WHERE d < 50 AND d > 0 GROUP BY ALL")
def v3(s, d):
    p = T.points(s, d).withColumnRenamed("z", "u")
    return spatial.variogram_points(p, "v", "u", 10.0, 5).select("lag", "n", F.round("gamma", 2).alias("gamma"))


@query("K6_spectrogram", f"WITH g AS ({_GRID}), b AS (SELECT cell, v, sqrt((i - 50.0) * (i - 50.0) + (j - 5.0) * (j - 5.0)) AS d, abs((i - 50) * sin(radians(70)) + (j - 5) * cos(radians(70))) AS a FROM g WHERE v IS NOT NULL) SELECT cell, round(d, 6) AS distance, round(10 * log10(greatest(abs(v), 1e-10) / 100), 4) AS db FROM b WHERE a >= d * cos(radians(20.3))")
def k6(s, d):
    rows = lookup.band(T.grid(s, d), (50.0, 5.0), 70.0, 20.3)
    return rows.select("cell", F.round("distance", 6).alias("distance"), F.round(S.decibel(F.col("v"), 100.0), 4).alias("db"))


@query("K7_singular_values")
def k7(s, d):
    return mesh.singular_values(T.table(s, d, "embeddings"), "embedding", 64)
