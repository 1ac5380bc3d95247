import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithospark.operators import frame, grids, spatial
from lithospark.sources import geoeas
from lithospark.spec import GridSpec, Structure, VariogramModel

MODEL = VariogramModel(0.0, (Structure("spherical", 1.0, (50.0, 50.0, 50.0)),))


def test_geoeas_round_trip(spark, tmp_path):
    path = tmp_path / "a.dat"
    path.write_text("comment\n2\nx\nvalue\n1 2\n3 -999\n4\n5;6.5e1\n")
    table, rejects = geoeas.read_geoeas(spark, str(path), -999.0)
    assert [tuple(r) for r in table.orderBy("row_id").collect()] == [(0, 1.0, 2.0), (1, 3.0, None), (3, 5.0, 65.0)]
    assert [r["line"] for r in rejects.collect()] == ["4"]
    geoeas.write_geoeas(table, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["table", "2", "x", "value", "1 2", "3 -999", "5 65"]


def test_grid_index_and_flip(spark):
    g = grids.make_grid(spark, GridSpec(5, 4, 3))
    assert g.count() == 60
    assert g.where("cell = 33").select("i", "j", "k").first() == (3, 2, 1)
    back = grids.flip(grids.flip(g, "i", 5), "i", 5)
    assert back.exceptAll(g).count() == 0


def test_kriging_reproduces_data_and_matches_a_dense_solve(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 60, (7, 2))
    v = rng.normal(size=7)
    samples = spark.createDataFrame(pd.DataFrame({"row_id": range(7), "x": xy[:, 0], "y": xy[:, 1], "v": v}))
    same = spatial.krige(samples.drop("v"), samples, "v", MODEL, 200.0, 7).orderBy("row_id").toPandas()
    assert np.allclose(same["estimate"], v) and np.allclose(same["variance"], 0, atol=1e-9)
    at = np.array([20.0, 30.0])
    target = spark.createDataFrame([(99, *map(float, at))], "row_id long, x double, y double")
    got = spatial.krige(target, samples, "v", MODEL, 200.0, 7).first()
    cov = lambda h: np.where(h >= 50, 0, 1 - 1.5 * h / 50 + 0.5 * (h / 50) ** 3)
    a = np.ones((8, 8))
    a[7, 7] = 0
    a[:7, :7] = cov(np.linalg.norm(xy[:, None] - xy[None], axis=-1))
    w = np.linalg.solve(a, np.append(cov(np.linalg.norm(xy - at, axis=1)), 1))
    assert np.isclose(got["estimate"], w[:7] @ v)


def test_kriging_with_a_drift_and_more_variables(spark):
    rng = np.random.default_rng(3)
    xy, at = rng.uniform(0, 60, (9, 2)), np.array([25.0, 31.0])
    v, u = 3 + 2 * xy[:, 0] - xy[:, 1], rng.normal(size=9)
    samples = spark.createDataFrame(pd.DataFrame({"row_id": range(9), "x": xy[:, 0], "y": xy[:, 1], "v": v, "u": u, "a": xy[:, 0], "b": xy[:, 1]}))
    target = spark.createDataFrame([(99, *map(float, at), *map(float, at))], "row_id long, x double, y double, a double, b double")
    got = spatial.krige(target, samples, "v", MODEL, 200.0, 9, drift=("a", "b"), also=("u",)).first()
    assert np.isclose(got["estimate"], 3 + 2 * at[0] - at[1])  # a trend of the drift's form is met exactly
    cov = lambda h: np.where(h >= 50, 0, 1 - 1.5 * h / 50 + 0.5 * (h / 50) ** 3)
    f = np.column_stack([np.ones(9), xy])
    a = np.block([[cov(np.linalg.norm(xy[:, None] - xy[None], axis=-1)), f], [f.T, np.zeros((3, 3))]])
    w = np.linalg.solve(a, np.concatenate([cov(np.linalg.norm(xy - at, axis=1)), [1], at]))
    assert np.isclose(got["also"][0], w[:9] @ u)


def test_linear_model_of_coregionalization():
    model = lambda nugget, sill, kind="spherical": VariogramModel(nugget, (Structure(kind, sill, (50.0, 50.0, 50.0)),))
    assert spatial.is_lmc(model(0.2, 1.0), model(0.3, 2.0), model(-0.1, 1.2))
    assert not spatial.is_lmc(model(0.2, 1.0), model(0.3, 2.0), model(0.1, 1.5))
    assert not spatial.is_lmc(model(0.2, 1.0), model(0.3, 2.0), model(0.1, 1.0, "gaussian"))
    assert not spatial.is_lmc(model(0.0, 1.0), model(0.3, 2.0), model(0.0, 1.0))


def test_fft_and_back(spark):
    z = np.random.default_rng(1).normal(size=(4, 6))
    g = spark.createDataFrame(pd.DataFrame([(1, i, j, float(z[i, j]), 0.0) for i in range(4) for j in range(6)], columns=["real", "i", "j", "re", "im"]))
    out = grids.fft(g)
    got = np.zeros((4, 6), complex)
    for r in out.collect():
        got[r["i"], r["j"]] = r["re"] + 1j * r["im"]
    assert np.allclose(got, np.fft.fft2(z))
    assert all(abs(r["re"] - z[r["i"], r["j"]]) < 1e-9 for r in grids.fft(out, True).collect())


def test_normal_scores_and_trend(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 10, (400, 3)), columns=list("xyz")).assign(row_id=range(400), v=rng.lognormal(size=400)))
    s = frame.normal_score(df, "v").agg(F.avg("score"), F.var_pop("score")).first()
    assert abs(s[0]) < 0.01 and abs(s[1] - 1) < 0.05
    c = (1.0, -2.0, 0.5, 0.1, 0.2, 0.3, 4.0, 5.0, 6.0)
    from lithospark.functions.scalar import quadratic_trend

    t = df.withColumn("t", quadratic_trend(F.col("x"), F.col("y"), F.col("z"), c))
    assert np.allclose(frame.fit_trend(t, "t"), c, atol=1e-6)


def test_empty_tables(spark):
    p = spark.createDataFrame([], "row_id long, x double, y double, z double, v double")
    assert spatial.within_distance(p, p, 1.0).count() == 0
    assert frame.cdf_table(p, "v").count() == 0
    assert frame.drift(p, "v", 3).count() == 0 if p.count() else True


def test_knn_serves_far_targets(spark):
    from lithospark.operators import spatial

    b = spark.createDataFrame([(k, float(k), 0.0) for k in range(5)], "row_id bigint, x double, y double")
    a = spark.createDataFrame([(10, 500.0, 100.0), (11, 1.2, 0.0), (12, None, 0.0)], "row_id bigint, x double, y double")
    got = {(r["row_id_a"], r["rank"]): r["row_id_b"] for r in spatial.knn(a, b, 3, 1.0, "xy", rounds=2).collect()}
    assert got == {(10, 1): 4, (10, 2): 3, (10, 3): 2, (11, 1): 1, (11, 2): 2, (11, 3): 0}


def test_windows_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(grids, "TILE", 5)
    rng = np.random.default_rng(4)
    z = rng.normal(size=(23, 17))
    z[rng.uniform(size=z.shape) < 0.2] = np.nan
    g = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(23) for j in range(17)], "i int, j int, v double")
    for r in (1, 3, 7):
        out = grids.extrema(grids.window_mean(g, "v", r), "v", r).collect()
        assert len(out) == z.size
        for row in out:
            i, j = row["i"], row["j"]
            w = z[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]
            assert np.isclose(row["mean"], np.nanmean(w)) and row["is_max"] == (z[i, j] >= np.nanmax(w)) and row["is_min"] == (z[i, j] <= np.nanmin(w))


def test_places_of_large_keys(spark):
    from lithospark.sources.tables import _xyz

    keys = [0, 1, 1008, 14_999, 899_999, 5_399_999, 3_000_000_000]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", *_xyz(F.col("k"))).collect()
    assert {r.k: (r.x, r.y, r.z) for r in got} == {k: ((k * k * 31 + k * 7919) % 1009, (k**3 * 17 + k * 104729) % 997, k % 50) for k in keys}


def test_asked_places_of_large_keys(spark, tmp_path):
    from lithospark.geometry_queries import _asked

    keys = [3, 14_999, 899_999, 5_399_999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.row_id: (r.x, r.y) for r in _asked(spark, str(tmp_path)).collect()}
    assert got == {k: ((k * k * 31 + k * 7919) % 1009 / 10 + 0.03, (k**3 * 17 + k * 104729) % 157 / 10 + 0.01) for k in keys}


@pytest.mark.parametrize("axes, skip", [("xy", False), ("xy", True), ("xyz", False)])
def test_nearest_lists_equal_all_pairs(spark, axes, skip):
    rng = np.random.default_rng(5)
    dense = np.concatenate([rng.integers(0, 400, (150, 3)) * 1.0, rng.normal(70, 0.5, (300, 3)), np.full((40, 3), 71.0)])  # a cluster, and many at one place
    b = pd.DataFrame(dense, columns=list("xyz")).assign(row_id=range(len(dense)), v=1.0)
    a = pd.DataFrame(np.concatenate([dense[::3], rng.integers(-50, 500, (60, 3))]), columns=list("xyz"))
    a["row_id"] = [*range(0, len(dense), 3), *range(1000, 1060)]
    got = spatial.nearest_lists(spark.createDataFrame(a), spark.createDataFrame(b), 5, 90.0, axes, skip, chunk=16, crowded=7).collect()
    d = np.sqrt(sum((a[x].to_numpy()[:, None] - b[x].to_numpy()) ** 2 for x in axes))
    if skip:
        d[a.row_id.to_numpy()[:, None] == b.row_id.to_numpy()] = np.inf
    want = {int(r): [int(k) for k in np.lexsort((b.row_id, row))[:5] if row[k] < 90] for r, row in zip(a.row_id, d)}
    assert {r.row_id: [e.row_id for e in r.near] for r in got} == {r: k for r, k in want.items() if k}


def test_nearest_lists_meet_in_numpy_and_keep_repeated_targets(spark):
    b = spark.range(40).selectExpr("id AS row_id", "double(id) AS x", "double(0) AS y")
    a = b.where("row_id < 3").unionByName(b.where("row_id = 2"))
    out = spatial.nearest_lists(a, b, 2, 9.0, skip_own=True)
    got = sorted((r.row_id, [e.row_id for e in r.near]) for r in out.collect())
    assert got == [(0, [1, 2]), (1, [0, 2]), (2, [1, 3]), (2, [1, 3])]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()  # no function that Spark calls element by element


def test_buckets_around_targets_are_not_broadcast(spark):
    a = spark.createDataFrame([(n, float(n), 0.0, 0.0) for n in range(40)], "row_id bigint, x double, y double, z double")
    near = spatial.nearest_lists(a, a, 1, 5.0, "xyz", skip_own=True)
    assert near.count() == 40
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_contact_at_one_place_is_in_no_lag(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1, 5.0), (2, 0.0, 0.0, 0.0, 2, 7.0), (3, 3.0, 0.0, 0.0, 2, 9.0)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, z double, dom int, v double")
    got = spatial.contact_analysis(df, "dom", "v", 1, 2, 2.0, 5).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 9.0)]  # the first two meet at distance 0


def test_border_of_a_turned_ellipsoid(spark):
    d = spark.createDataFrame([(0.0, 24.0, 6.0), (0.0, -24.0, 6.0), (0.0, 24.1, 6.0)], "x double, y double, z double")
    inside = spatial.in_rotated_ellipsoid(F.col("x"), F.col("y"), F.col("z"), Structure("spherical", 1.0, (40.0, 15.0, 20.0), 30.0))
    assert [r[0] for r in d.select(inside).collect()] == [True, True, False]


def test_best_cell_size_makes_no_weights_of_the_others(spark, monkeypatch):
    rows = [(k, k * 7.0 % 40, k * 3.0 % 25, float(k * k % 11)) for k in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, v double")
    sizes, whole, asked = [4.0, 9.0, 15.0], frame.decluster(df, [4.0, 9.0, 15.0], 5).join(df, "row_id").toPandas(), []
    means = whole.assign(vw=whole.v * whole.weight).groupby("size")[["vw", "weight"]].sum()
    best = (means.vw / means.weight).idxmin()
    made = frame.decluster
    monkeypatch.setattr(frame, "decluster", lambda rows, sizes, offsets: asked.extend(sizes) or made(rows, sizes, offsets))
    got = frame.decluster_best(df, "v", sizes, 5).toPandas().set_index("row_id").sort_index()
    assert asked == [best] and set(got["size"]) == {best}
    assert np.allclose(got.weight, whole[whole["size"] == best].set_index("row_id").sort_index().weight)


def test_thinning_without_pairs_equals_the_walk_over_pairs(spark):
    rng = np.random.default_rng(2)
    samples = spark.createDataFrame(pd.DataFrame(rng.integers(-40, 40, (200, 2)) * 1.0, columns=["x", "y"]).assign(row_id=range(200)).iloc[::-1])
    targets = spark.createDataFrame(pd.DataFrame(rng.integers(-60, 60, (15, 2)) * 1.0, columns=["x", "y"]).assign(row_id=range(15)))
    got = spatial.thin_neighbors(targets, samples, 25.0, 8.0, "xy").collect()
    want = spatial.thin_min_distance(spatial.within_distance(targets, samples, 25.0, "xy"), 8.0, "xy").select("row_id_a", "row_id_b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_equal_intervals_meet_a_segment_once(spark):
    from lithospark.operators import markov

    segments = spark.range(2000).selectExpr("id AS row_id", "id % 40 + 0.5D AS z0", "id % 40 + 7.5D AS z1")
    intervals = spark.range(200_000).selectExpr("id AS interval", "CAST(id % 4 * 10 AS DOUBLE) AS low", "CAST(id % 4 * 10 + 2 AS DOUBLE) AS high")  # 400 million pairs, less than half of which meet
    got = {r["row_id"]: (r["n"], r["intervals"]) for r in markov.sums_in_z_interval(segments, intervals, 10.0).collect()}
    for k in range(2000):
        some = [m for m in range(4) if m * 10 <= k % 40 + 7.5 and m * 10 + 2 >= k % 40 + 0.5]
        assert got.get(k) == ((50_000 * len(some), sum(sum(range(m, 200_000, 4)) for m in some)) if some else None)


@pytest.fixture
def small_tiles(monkeypatch):
    from functools import partial

    monkeypatch.setattr(spatial, "meet", partial(spatial.meet, rows=20, most=16))


def random_rows(spark, n, seed, axes):
    rng = np.random.default_rng(seed)
    p = np.round(rng.normal(size=(n, 3)) * 20) / 2
    rows = [(k, *map(float, v), float(k % 7)) for k, v in enumerate(p)]
    return spark.createDataFrame([*rows, (n, None, 0.0, 0.0, 1.0), (n + 1, float("nan"), 0.0, 0.0, 1.0)], "row_id bigint, x double, y double, z double, v double"), p[:, : len(axes)]


@pytest.mark.parametrize("axes", ["x", "xy", "xyz"])
def test_pairs_of_tiles_and_of_parts(spark, small_tiles, axes):
    (a, p), (b, q) = random_rows(spark, 120, 1, axes), random_rows(spark, 150, 2, axes)
    far = np.sqrt(((p[:, None] - q) ** 2).sum(-1))
    got = spatial.within_distance(a, b, 4.0, axes, ("row_id",)).collect()
    assert sorted((r["row_id_a"], r["row_id_b"]) for r in got) == sorted(zip(*(x.tolist() for x in np.nonzero(far < 4)))) and all(r["d"] == far[r["row_id_a"], r["row_id_b"]] for r in got)
    own = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    twos = sorted(tuple(sorted((r["row_id_a"], r["row_id_b"]))) for r in spatial.self_pairs(a, 4.0, axes).collect())
    assert twos == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(own < 4, 1)))))


@pytest.mark.parametrize("sectors, skip", [(0, True), (4, False)])
def test_nearest_pairs(spark, small_tiles, sectors, skip):
    (a, p), (b, q) = random_rows(spark, 60, 3, "xy"), random_rows(spark, 200, 4, "xy")
    move = q - p[:, None]
    far = np.sqrt((move**2).sum(-1))
    angle = np.degrees(np.arctan2(move[..., 0], move[..., 1])) % 360
    want = set()
    for i in range(60):
        for s in range(max(1, sectors)):
            some = [j for j in range(200) if far[i, j] < 9 and abs(move[i, j, 1]) < 6 and not (skip and i == j) and (not sectors or int(angle[i, j] // 90) == s)]
            want |= {(i, j, k, s) for k, j in enumerate(sorted(some, key=lambda j: (far[i, j], j))[:3], 1)}
    got = spatial.nearest_pairs(a, b, 3, 9.0, "xy", lambda dx, dy: np.abs(dy) < 6, sectors, skip)
    assert {(r["row_id_a"], r["row_id_b"], r["rank"], r["sector"] if sectors else 0) for r in got.collect()} == want


def test_rows_at_one_place_go_as_their_sums(spark):
    """Some 10 ** 9 pairs of rows, of few places."""
    rows = spark.range(40_000).selectExpr("id AS row_id", "CAST(id % 4 AS DOUBLE) AS x", "0.0D AS y", "CAST(id % 8 AS DOUBLE) AS v")
    out = {r["lag"]: (r["n"], r["h"], round(r["gamma"], 9)) for r in spatial.variogram_points(rows, "v", "v", 1.0, 4).collect()}
    half = lambda k: sum((a + 4 * m - b - k - 4 * n) ** 2 / 2 for a in range(4 - k) for b in [a] for m in (0, 1) for n in (0, 1)) / (4 * (4 - k))
    assert out == {k: (10**8 * (4 - k), float(k), round(half(k), 9)) for k in (1, 2, 3)}
    est = {r["row_id"]: r["estimate"] for r in spatial.shepard(rows.selectExpr("row_id", "x + 0.5D * (row_id % 2) AS x", "y"), rows, "v", 1.2).collect()}
    assert len(est) == 40_000 and math.isclose(est[0], 2.0) and math.isclose(est[1], 3.5)


def test_close_samples_of_crowded_places(spark, small_tiles):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 6, size=(150, 2)).astype(float)
    rows = spark.createDataFrame([*((k, *map(float, v)) for k, v in enumerate(p)), (150, None, 1.0), (151, float("nan"), 1.0)], "row_id bigint, x double, y double")
    far = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    got = spatial.close_samples(rows, 1.5, most=3).collect()
    assert sorted((r["row_id_a"], r["row_id_b"]) for r in got) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(far < 1.5, 1))))) and all(r["d"] == far[r["row_id_a"], r["row_id_b"]] for r in got)
    many = rows.crossJoin(spark.range(100)).selectExpr("id * 1000 + row_id AS row_id", "x", "y")
    assert spatial.close_samples(many, 1.5).count() == 100 * 100 * len(got) + 150 * 100 * 99 // 2
