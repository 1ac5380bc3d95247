import numpy as np
import pandas as pd
import pytest

from lithospark import queries
from lithospark.operators import lookup, mesh


def test_volume_of_a_sheared_box(spark):
    corners = [(i, j, k, 2.0 * i + 0.5 * k, 3.0 * j, 4.0 * k + 0.25 * i) for i in range(3) for j in range(2) for k in range(2)]
    m = mesh.cells(spark.createDataFrame(corners, "i int, j int, k int, x double, y double, z double"))
    got = mesh.volumes(mesh.vertex_ids(m, 3, 2)).orderBy("i").collect()
    assert len(got) == 2 and np.allclose([r["volume"] for r in got], 2 * 3 * 4 - 0.25 * 0.5 * 3)
    assert got[0]["ids"] == [0, 1, 4, 3, 6, 7, 10, 9]


@pytest.mark.parametrize("bins", [1, 7, 1000])
def test_interpolate(spark, bins):
    rng = np.random.default_rng(3)
    x, y, q = np.unique(rng.exponential(size=60)), rng.normal(size=60), np.append(rng.uniform(-0.5, 5, 200), [np.nan])
    x = np.append(x, 60.0)[:60]
    knots = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(q)] + [(500, float(x[-1])), (501, float(x[0]))], "i int, q double")
    out = lookup.interpolate(df, "q", knots, "x", "y", "v", bins).orderBy("i").collect()
    assert len(out) == len(q) + 2
    for r in out:
        assert r["v"] is None if r["q"] is None else np.isclose(r["v"], np.interp(r["q"], x, y))
    one = spark.createDataFrame([(1.0, 5.0)], "x double, y double")
    assert {r["v"] for r in lookup.interpolate(df.where("q IS NOT NULL"), "q", one, "x", "y", "v").collect()} == {5.0}
    assert {r["v"] for r in lookup.interpolate(df, "q", one.where("x > 1"), "x", "y", "v").collect()} == {None}


def test_singular_values(spark):
    got = queries.QUERIES["K7_singular_values"](spark, "/root/testdata/sf0.001").orderBy("factor").toPandas()
    m = np.stack(pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet")["embedding"].to_numpy()).astype(float)
    assert np.allclose(got["value"], np.linalg.svd(m, compute_uv=False), rtol=1e-6) and np.isclose(got["weight"].sum(), 1)


def test_back_transform_and_bootstrap(spark):
    back = queries.QUERIES["D2_back_transform"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(back) and np.allclose(back["v"], back["back"])
    drawn = queries.QUERIES["S7_bootstrap"](spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(drawn["draw"]) == list(range(len(back))) and drawn["row_id"].nunique() < len(back)


def test_sparse_transition_matrix(spark):
    """A facies without a way back, and pairs that never occur."""
    from lithospark.operators import markov

    counts = {(1, 1): 4, (1, 2): 6, (2, 3): 5, (3, 2): 3, (3, 3): 2}
    ftm = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "from int, to int, n bigint")
    n = np.zeros((3, 3))
    for (a, b), x in counts.items():
        n[a - 1, b - 1] = x
    row, column, total, off = n.sum(1, keepdims=True), n.sum(0, keepdims=True), n.sum(), 1 - np.eye(3)
    trail = off * column / (total - row)
    want = {"trail": trail, "difference": off * (n / row - trail), "expected": trail * row}
    got = markov.expected(ftm).collect()
    assert len(got) == 9
    for r in got:
        at = r["from"] - 1, r["to"] - 1
        assert all(np.isclose(r[k], w[at]) for k, w in want.items())
    e = want["expected"]
    assert np.isclose(markov.chi_squared(ftm).first()["chi2"], ((n - e) ** 2 / np.where(e > 0, e, 1))[e > 0].sum())
    p, q = n / row, n / column
    term = lambda x: np.where((x > 0) & (off > 0), x * np.log2(np.where(x > 0, x, 1)), 0)
    for r in markov.entropies(ftm, 3).collect():
        assert np.isclose(r["post"], -term(p).sum(1)[r["cat"] - 1]) and np.isclose(r["pre"], -term(q).sum(0)[r["cat"] - 1])
    thick = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 5.0)], "cat int, thickness double")
    rates = {(r["from"], r["to"]): r["rate"] for r in markov.transition_rates(ftm, thick).collect()}
    assert len(rates) == 9 and np.isclose(rates[1, 2], 0.6 / 2) and rates[2, 2] == -0.25 and rates[2, 1] == 0
    sets = ftm.selectExpr("1 AS h", "`from`", "`to`", "n").unionByName(spark.createDataFrame([(1, 4, 2, 0), (2, 2, 4, 1), (2, 4, 4, 0)], "h int, from int, to int, n bigint"))
    assert {(r["from"], r["to"]) for r in markov.drop_empty(sets).collect()} == {*counts, (2, 4)}


def test_row_numbers_and_cumulative_tables_in_ranges(spark):
    from pyspark.sql import functions as F

    from lithospark.operators import frame
    from lithospark.sources.geoeas import with_row_id

    df = spark.range(300_000).select(F.xxhash64("id").alias("a"), (F.col("id") % 1000 / 7).alias("v"))
    rows = with_row_id(df, ["a"])
    assert rows.agg(F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first() == (300_000, 0, 299_999)
    back = rows.alias("x").join(rows.alias("y"), F.expr("y.row_id = x.row_id + 1")).where("y.a <= x.a").count()
    assert back == 0
    table = frame.cdf_table(df, "v").orderBy("value").toPandas()
    assert len(table) == 1000 and np.allclose(table["p"], (np.arange(1000) + 0.5) / 1000)


def test_cells_across_tiles_send_vertices_about_once(spark):
    from pyspark.sql import functions as F

    from lithospark.operators import mesh

    points = spark.range(70 * 68 * 3).select((F.col("id") % 70 - 3).cast("int").alias("i"), (F.floor(F.col("id") / 70) % 68).cast("int").alias("j"), F.floor(F.col("id") / 4760).cast("int").alias("k"))
    points = points.where("NOT (i = 63 AND j = 5 AND k = 1)").select("*", (F.col("i") * 1.0).alias("x"), (F.col("j") * 2.0).alias("y"), (F.col("k") - 0.5).alias("z"))
    made = mesh.cells(points)
    got = {(r["i"], r["j"], r["k"]): r for r in made.collect()}
    want = {(i, j, k) for i in range(-3, 66) for j in range(67) for k in range(2)} - {(a, b, k) for a in (62, 63) for b in (4, 5) for k in (0, 1)}
    assert got.keys() == want
    for at in ((63, 63, 0), (-1, 10, 1), (62, 62, 1), (64, 64, 0)):
        assert [tuple(got[at][f"v{n}"]) for n in range(8)] == [(at[0] + a, (at[1] + b) * 2.0, at[2] + c - 0.5) for a, b, c in mesh.CORNERS]
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan  # the eight corners of a vertex are made after the shuffle
