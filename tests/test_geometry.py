"""Surfaces, meshes, thinning, variogram maps and imputation against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithospark.operators import grids, horizons, imputation, mesh, spatial
from lithospark.spec import GridSpec

ENDS = "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_crossings_at_vertices_edges_and_holes_in_the_surface(spark):
    spec = GridSpec(4, 4, x0=10.0, dx=2.0)
    z = {(i, j): float(i + j) for i in range(4) for j in range(4)} | {(3, 3): None}
    surface = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "i int, j int, z double")
    lines = [
        (1, 13.0, 1.5, 9.0, 13.0, 1.5, -9.0),  # down through the vertex (1, 1)
        (2, 12.0, 0.5, 9.0, 12.0, 0.5, -9.0),  # through the border
        (3, 11.0, 0.5, 1.0, 15.0, 2.5, 1.0),  # level along the diagonal, crosses at height 1
        (4, 16.5, 3.2, 9.0, 16.5, 3.2, -9.0),  # over the square that has a lost corner
        (5, 0.0, 0.0, 9.0, 0.0, 0.0, -9.0),  # outside
        (6, 13.0, 1.5, 9.0, 13.0, 1.5, 3.0),  # ends over it
        (7, None, 1.5, 9.0, 13.0, 1.5, -9.0),
        (8, 11.0, 0.5, 0.0, 15.0, 2.5, 4.0),  # in the planes of the triangles
        (9, 14.0, 2.0, 9.0, 14.0, 2.0, 3.0),  # its end touches
    ]
    got = horizons.intersect_horizon(spark.createDataFrame(lines, f"k int, {ENDS}").withColumn("a", F.lit(1)), surface, spec, ["k"]).collect()
    assert [(r["k"], round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in sorted(got)] == [(1, 13.0, 1.5, 2.0), (2, 12.0, 0.5, 0.5), (3, 12.0, 1.0, 1.0), (9, 14.0, 2.0, 3.0)]


def test_crossings_equal_all_lines_against_all_triangles(spark):
    rng = np.random.default_rng(2)
    z = rng.uniform(0, 3, (9, 7))
    surface = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(9) for j in range(7)], "i int, j int, z double")
    ends = np.c_[rng.uniform(-2, 11, 60), rng.uniform(-2, 9, 60), rng.uniform(-1, 4, 60), rng.uniform(-2, 11, 60), rng.uniform(-2, 9, 60), rng.uniform(-1, 4, 60)]
    want = []
    for k, e in enumerate(ends):
        p, d = e[:3], e[3:] - e[:3]
        for i in range(8):
            for j in range(6):
                c = {o: np.array([i + o[0] + 0.5, j + o[1] + 0.5, z[i + o[0], j + o[1]]]) for o in ((0, 0), (1, 0), (0, 1), (1, 1))}
                for t in (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))):
                    a, b, q = (c[o] for o in t)
                    s = np.linalg.solve(np.c_[b - a, q - a, -d], p - a)  # a + s0 (b - a) + s1 (q - a) = p + s2 d
                    if min(s[0], s[1], s[2]) >= 0 and s[0] + s[1] <= 1 and s[2] <= 1:
                        want.append((k, round(float(s[2]), 7)))
    got = horizons.intersect_horizon(spark.createDataFrame([(k, *map(float, e)) for k, e in enumerate(ends)], f"k int, {ENDS}"), surface, GridSpec(9, 7), ["k"])
    assert sorted((r["k"], round(r["t"], 7)) for r in got.collect()) == sorted(want) and len(want) > 20


def test_holes_between_horizons(spark):
    flat = lambda v: spark.createDataFrame([(i, j, v) for i in range(3) for j in range(3)], "i int, j int, z double")
    lines = [(1, 0, 1.2, 1.2, 5.0, 1.2, 1.2, 2.0, 1), (1, 1, 1.2, 1.2, 1.5, 1.2, 1.2, -3.0, 2), (2, 0, 1.2, 1.2, 9.0, 1.2, 1.2, 8.0, 1), (3, 0, 1.2, 1.2, 1.0, 1.2, 1.2, 0.5, 1), (4, 0, 1.0, 1.2, 5.0, 1.4, 1.2, 2.0, 1), (4, 1, 1.4, 1.2, 2.0, 1.5, 1.2, 5.0, 1)]
    seg = spark.createDataFrame(lines, f"hole bigint, seq int, {ENDS}, cat int")
    spec = GridSpec(3, 3)
    bounds = horizons.horizon_bounds(seg, flat(3.0), flat(-1.0), spec)
    assert rows_of(bounds) == [(1, -1.0, 3.0), (3, 0.5, 1.0)]  # 2 is above, 4 crosses the top twice
    assert [r["gap"] for r in horizons.hole_crossings(seg, flat(1.75), spec).where("hole = 1").collect()] == [True]
    assert horizons.hole_crossings(seg, flat(2.0), spec).where("hole = 1").count() == 1  # at an end that two pieces share
    curve = {(r["d"], r["cat"]): round(r["p"], 9) for r in horizons.vpc_between(seg, bounds.where("hole = 1"), 4, 0.25).collect()}
    assert curve == {(0, 2): 1.0, (1, 2): 1.0, (2, 2): 1.0, (3, 1): 1.0, (4, 1): 1.0}
    lost = seg.withColumn("cat", F.lit(None).cast("int"))
    fallback = spark.createDataFrame([(7, 0.25), (8, 0.75)], "cat int, p double")
    assert horizons.vpc_between(lost, bounds, 2, 0.1, fallback).count() == 2 * 3 * 2
    assert horizons.horizon_bounds(seg.limit(0), flat(3.0), flat(-1.0), spec).count() == 0


@pytest.fixture(scope="module")
def bent(spark):
    """A mesh of 3 x 2 x 2 cells whose pillars lean."""
    rows = [(i, j, k, i + 0.2 * k + 0.05 * j, j - 0.1 * k, 2.0 * k + 0.1 * i - 0.05 * j) for i in range(4) for j in range(3) for k in range(3)]
    return mesh.cells(spark.createDataFrame(rows, "i int, j int, k int, x double, y double, z double"))


def test_places_in_a_bent_mesh(spark, bent):
    def point(i, j, k, f):
        """The same combination of a cell's corners as in a cube: these cells are images of one under an affine map."""
        i, j, k = i + f[0], j + f[1], k + f[2]
        return i + 0.2 * k + 0.05 * j, j - 0.1 * k, 2.0 * k + 0.1 * i - 0.05 * j

    rng = np.random.default_rng(4)
    want, rows = {}, []
    for n in range(60):
        c, f = (int(rng.integers(3)), int(rng.integers(2)), int(rng.integers(2))), rng.uniform(0.01, 0.99, 3)
        want[n] = (*c, *[round(float((a + b) / m), 7) for a, b, m in zip(c, f, (3, 2, 2))])
        rows.append((n, *map(float, point(*c, f))))
    rows += [(100, -1.0, 0.5, 0.5), (101, None, 0.5, 0.5), (102, 1.0, 1.0, 50.0), (103, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "row_id int, x double, y double, z double")
    for size in (1.0, 0.3, 5.0):
        got = {r["row_id"]: (r["i"], r["j"], r["k"], round(r["u"], 7), round(r["v"], 7), round(r["w"], 7)) for r in mesh.unfold(points, bent, (3, 2, 2), size).collect()}
        assert got == want
    near = {r["row_id"]: (r["i"], r["j"], r["k"]) for r in mesh.locate(points, bent, 1.0, nearest=True).collect()}
    centers = {(r["i"], r["j"], r["k"]): np.array([r["cx"], r["cy"], r["cz"]]) for r in mesh.centers(bent).collect()}
    assert near == {n: w[:3] for n, w in want.items() if min(centers, key=lambda c: (((centers[c] - rows[n][1:]) ** 2).sum(), c[::-1])) == w[:3]} and 20 < len(near) <= 60
    corner = spark.createDataFrame([(1, *map(float, point(1, 1, 1, (0, 0, 0))))], "row_id int, x double, y double, z double")
    assert mesh.locate(corner, bent, 1.0).select("i", "j", "k").collect() == [(0, 0, 0)]  # of eight cells
    lines = spark.createDataFrame([(1, *rows[0][1:], *rows[1][1:]), (2, *rows[0][1:], -1.0, 0.5, 0.5)], f"row_id int, {ENDS}")
    assert [r["row_id"] for r in mesh.unfold_lines(lines, bent, (3, 2, 2), 1.0).collect()] == [1]
    assert mesh.unfold(points.limit(0), bent, (3, 2, 2), 1.0).count() == mesh.unfold(points, bent.limit(0), (3, 2, 2), 1.0).count() == 0


def test_thinning_equals_the_walk(spark):
    rng = np.random.default_rng(9)
    b = np.round(rng.uniform(0, 20, (300, 3)))  # many ties and equal places
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "row_id int, x double, y double, z double")
    targets = spark.createDataFrame([(k, 5.0 * k, 10.0, 8.0) for k in range(4)], "row_id int, x double, y double, z double")
    pairs = spatial.within_distance(targets, points, 9.0)
    want = []
    for k in range(4):
        near = sorted((math.dist(p, (5.0 * k, 10.0, 8.0)), i) for i, p in enumerate(b) if math.dist(p, (5.0 * k, 10.0, 8.0)) < 9.0)
        kept = []
        for _, i in near:
            if all(math.dist(b[i], b[j]) >= 3.0 for j in kept):
                kept.append(i)
        want += [(k, i) for i in kept]
    got = spatial.thin_min_distance(pairs, 3.0)
    assert got.columns == pairs.columns and rows_of(got.select("row_id_a", "row_id_b")) == sorted(want, key=str)
    assert spatial.thin_min_distance(pairs.limit(0), 3.0).count() == 0


def test_variogram_maps_of_a_grid_with_lost_cells(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(5, 2, (5, 4))
    v[1, 2] = np.nan
    rows = [(i, j, None if np.isnan(v[i, j]) else float(v[i, j])) for i in range(5) for j in range(4) if (i, j) != (4, 3)]
    v[4, 3] = np.nan
    grid = spark.createDataFrame(rows, "i int, j int, v double")
    cov = {}
    for di in range(-2, 3):
        for dj in range(-2, 2):
            p = [(v[i, j], v[i + di, j + dj]) for i in range(5) for j in range(4) if 0 <= i + di < 5 and 0 <= j + dj < 4 and not np.isnan(v[i, j] + v[i + di, j + dj])]
            cov[di, dj] = (len(p), np.mean([a * b for a, b in p]) - np.mean([a for a, _ in p]) * np.mean([b for _, b in p]))
    top = max(c for _, c in cov.values())
    got = {(r["di"], r["dj"]): (r["n"], r["gamma"]) for r in grids.varmap_fast(grid, "v", 5, 4).collect()}
    assert got.keys() == cov.keys() and all(got[h][0] == n and abs(got[h][1] - (top - c)) < 1e-9 for h, (n, c) in cov.items())
    full = np.nan_to_num(v)
    a = np.fft.ifft2(np.abs(np.fft.fft2(full)) ** 2 / full.size).real
    got = {(r["di"], r["dj"]): r["gamma"] for r in grids.varmap_fim(grid, "v", 5, 4).collect()}
    assert len(got) == 20 and all(abs(g - (a.max() - a[di, dj])) < 1e-9 for (di, dj), g in got.items()) and abs(got[0, 0]) < 1e-9


def fill_by_walk(rows, chain, curves, first, seed, real, attempt):
    """The contract of imputation, one interval after another from the bottom of each hole."""
    out = []
    for hole in sorted({r["hole"] for r in rows}):
        last, top = None, None
        for r in sorted((r for r in rows if r["hole"] == hole), key=lambda r: (min(r["z0"], r["z1"]), r["row_id"])):
            a, b = [np.array([r[f"{c}{n}"] for c in "xyz"]) for n in ((0, 1) if r["z0"] <= r["z1"] else (1, 0))]
            if top is None or np.linalg.norm(a - top) > 1e-6:
                last = None
            top = b
            if r["cat"] is not None:
                last = r["cat"]
                out.append((real, r["row_id"], 0, last, 0, round(r["z0"], 9), round(r["z1"], 9)))
                continue
            u, z, piece = imputation.draws(seed, real, attempt, r["row_id"]), a[2], 0
            while True:
                codes, p = chain[last] if last is not None else first
                c = np.cumsum(np.array(p, float) / sum(p))
                last = codes[min(int(np.searchsorted(c, next(u), "right")), len(codes) - 1)]
                thick = float(np.interp(next(u), *curves[last]))
                end = min(b[2], z + thick)
                out.append((real, r["row_id"], piece, last, 1, round(float(z), 9), round(float(end), 9)))
                if z + thick > b[2]:
                    break
                z, piece = end, piece + 1
    return out


def test_imputation_equals_the_walk_and_rejects(spark):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for hole in range(6):
        z, x = 10.0, float(hole)
        for _ in range(25):
            length = float(np.round(rng.uniform(0.5, 3), 3))
            if rng.random() < 0.1:
                z -= 1.0  # a gap
            rows.append({"row_id": n, "hole": hole, "x0": x, "y0": 0.0, "z0": z, "x1": x + 0.5, "y1": 0.0, "z1": z - length, "cat": None if rng.random() < 0.4 else int(rng.integers(1, 4))})
            z, x, n = z - length, x + 0.5, n + 1
    seg = spark.createDataFrame(pd.DataFrame(rows).astype({"cat": "Int32"}).astype(object).where(lambda d: d.notna(), None).values.tolist(), f"row_id bigint, hole bigint, {ENDS}, cat int")
    ftm = [(1, 2, 3), (1, 3, 1), (2, 3, 2), (3, 1, 5), (3, 2, 5), (3, 3, 0)]
    thick = [(c, v, p) for c in (1, 2, 3) for p, v in ((0.0, 0.1 * c), (0.4, 0.3 * c), (1.0, 0.9 * c))]
    share = [(1, 0.2), (2, 0.3), (3, 0.5)]
    chain = {1: ([2, 3], [3, 1]), 2: ([3], [2]), 3: ([1, 2], [5, 5])}
    curves = {c: np.array([(p, v) for k, v, p in thick if k == c]).T for c in (1, 2, 3)}
    make = lambda **o: imputation.impute_categories(seg, spark.createDataFrame(ftm, "from int, to int, n bigint"), spark.createDataFrame(thick, "cat int, value double, cum double"), 2, 5, spark.createDataFrame(share, "cat int, p double"), **o)
    out = make().collect()
    got = sorted((r["real"], r["row_id"], r["piece"], r["cat"], r["imputed"], round(r["z0"], 9), round(r["z1"], 9)) for r in out)
    want = sorted(x for real in (1, 2) for x in fill_by_walk(rows, chain, curves, ([1, 2, 3], [0.2, 0.3, 0.5]), 5, real, 0))
    assert got == want and sum(r["imputed"] for r in out) > 60
    on = [r for r in out if r["imputed"]]
    source = {r["row_id"]: r for r in rows}
    assert all(abs((r["x1"] - source[r["row_id"]]["x0"]) - (source[r["row_id"]]["z0"] - r["z1"]) / (source[r["row_id"]]["z0"] - source[r["row_id"]]["z1"]) * 0.5) < 1e-9 for r in on)
    with pytest.raises(Exception, match="forbidden transitions after 2"):
        make(forbid=spark.createDataFrame([(1, 2, 1)], "from int, to int, n bigint"), most_attempts=2).count()
    every = spark.createDataFrame([(a, b, 1) for a in (1, 2, 3) for b in (1, 2, 3)], "from int, to int, n bigint")
    assert rows_of(make(forbid=every)) == rows_of(make())
    bad = imputation.forbidden(make(), spark.createDataFrame(ftm, "from int, to int, n bigint"), 0.9)
    assert bad.columns == ["real", "from", "to", "up"]
    with pytest.raises(Exception, match="no fallback"):
        imputation.impute_categories(seg.where("row_id < 25").withColumn("cat", F.lit(None).cast("int")), spark.createDataFrame(ftm, "from int, to int, n bigint"), spark.createDataFrame(thick, "cat int, value double, cum double"), 1, 5).count()


def test_variogram_maps_send_cells_once_and_cross_tiles(spark):
    rng = np.random.default_rng(3)
    cells = [(int(i), int(j), float(rng.integers(0, 9))) for i in range(250, 262) for j in range(-5, 9) if rng.random() < 0.7]
    df = spark.createDataFrame(cells, "i int, j int, v double")
    plan = mesh.varmap(df, "v", 3, 2)
    got = {(r.di, r.dj): (r.n, round(r.gamma, 9)) for r in plan.collect()}
    value, want = {(i, j): v for i, j, v in cells}, {}
    for a in range(-3, 4):
        for b in range(-2, 3):
            halves = [(v - value[i + a, j + b]) ** 2 / 2 for (i, j), v in value.items() if (i + a, j + b) in value]
            want[a, b] = (len(halves), round(sum(halves) / len(halves), 9))
    assert got == want
    assert "Join" not in plan._jdf.queryExecution().toString()  # a row for each cell and tile, none for each offset


def test_runs_of_lost_intervals_cross_batches(spark):
    """Many short runs share a task, and a run goes on where a batch ends."""
    types = "row_id bigint, hole bigint, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, cat int"
    rows = [{"row_id": 40 * h + n, "hole": h, "x0": 0.0, "y0": 0.0, "z0": float(n), "x1": 0.0, "y1": 0.0, "z1": n + 1.0, "cat": None if n % 13 else 1 + h % 2} for h in range(5) for n in range(40)]
    seg = spark.createDataFrame([tuple(r.values()) for r in rows], types)
    ftm, share = [(1, 2, 3), (1, 1, 1), (2, 1, 2)], [(1, 0.4), (2, 0.6)]
    thick = [(c, v, p) for c in (1, 2) for p, v in ((0.0, 0.2 * c), (1.0, 0.7 * c))]
    curves = {c: np.array([(p, v) for k, v, p in thick if k == c]).T for c in (1, 2)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = imputation.impute_categories(seg, spark.createDataFrame(ftm, "from int, to int, n bigint"), spark.createDataFrame(thick, "cat int, value double, cum double"), 2, 5, spark.createDataFrame(share, "cat int, p double"))
        out = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(x for real in (1, 2) for x in fill_by_walk(rows, {1: ([1, 2], [1, 3]), 2: ([1], [2])}, curves, ([1, 2], [0.4, 0.6]), 5, real, 0))
    got = sorted((r["real"], r["row_id"], r["piece"], r["cat"], r["imputed"], round(r["z0"], 9), round(r["z1"], 9)) for r in out)
    assert got == want
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()  # no group, and so no frame, for each run


def test_percentiles_in_ranges(spark):
    from lithospark.operators import frame

    rng = np.random.default_rng(4)
    rows = [(int(c), float(v)) for c in (1, 2, 3) for v in (rng.integers(0, 40, 301) if c < 3 else [2.5])] + [(1, None), (None, 4.0)]
    df, q = spark.createDataFrame(rows, "cat int, v double"), [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    plan = frame.percentiles_by(df, "cat", "v", q)
    want = {r[0]: r[1] for r in df.where("cat IS NOT NULL").groupBy("cat").agg(F.percentile("v", F.array(*map(F.lit, q)))).collect()}
    assert {r["cat"]: r["q"] for r in plan.collect()} == want
    assert "percentile" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no task holds all values of a category


def test_fast_variogram_maps_go_by_blocks_of_lines(spark, monkeypatch):
    rng = np.random.default_rng(9)
    cells = [(int(i), int(j), float(rng.integers(0, 50))) for i in range(6) for j in range(11) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "i int, j int, v double")
    plan = grids.varmap_fast(df, "v", 6, 11)
    whole = {(r.di, r.dj): (r.n, r.gamma) for r in plan.collect()}
    monkeypatch.setattr(grids, "BLOCK", 7)
    assert {k: n for k, (n, _) in whole.items()} == {(r.di, r.dj): r.n for r in grids.varmap_fast(df, "v", 6, 11).collect()}
    again = {(r.di, r.dj): r.gamma for r in grids.varmap_fast(df, "v", 6, 11).collect()}
    assert all(abs(again[k] - g) < 1e-8 for k, (_, g) in whole.items())
    value = {(i, j): v for i, j, v in cells}
    for (di, dj), (n, _) in whole.items():
        assert n == sum((i + di, j + dj) in value for i, j in value)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [di" not in text and "explode" not in text  # fields and products stay in one row, none is met again by its place


def test_ridges_across_tiles_equal_windows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(grids, "EDGE", 4, raising=False)
    size, half = (21, 35), 2
    v = np.where(rng.random(size) < 0.15, np.nan, rng.normal(size=size))
    df = spark.createDataFrame([(f"c{i}", i, j, None if np.isnan(v[i, j]) else float(v[i, j])) for i in range(size[0]) for j in range(size[1])], "name string, i int, j int, v double")

    def mean(i, j):
        w = [v[a, b] for a in range(i - half, i + half + 1) for b in range(j - half, j + half + 1) if 0 <= a < size[0] and 0 <= b < size[1] and not np.isnan(v[a, b])]
        return np.mean(w) if w else np.nan

    plan, s = grids.ridges_valleys(df, "v", half, size, 0.3), half + 1
    rows = plan.collect()
    assert len(rows) == size[0] * size[1] and plan.columns == ["name", "i", "j", "v", "ridge", "valley"]
    for r in rows:
        pairs = [(mean(r.i + a * s, r.j + b * s), mean(r.i - a * s, r.j - b * s)) for a, b in ((0, 1), (1, 1), (1, 0), (1, -1))]
        big = r.v is not None and abs(r.v) >= 0.3
        assert (r.ridge, r.valley) == tuple(sum(big and f(r.v, p) and f(r.v, q) for p, q in pairs) for f in (np.greater, np.less)) and r.name == f"c{r.i}"
    assert "Join" not in plan._jdf.queryExecution().toString()


def test_squares_across_tiles_send_vertices_about_once(spark):
    surface = spark.range(140 * 130).select((F.col("id") % 140 - 5).cast("int").alias("i"), F.floor(F.col("id") / 140).cast("int").alias("j"), F.when(F.col("id") != 0, F.col("id") * 1.0).alias("z"))
    plan = horizons.squares(surface)
    got = {(r.a, r.b): (r.z00, r.z10, r.z01, r.z11) for r in plan.collect()}
    at = lambda i, j: 140.0 * j + i + 5
    assert got == {(i, j): (at(i, j), at(i + 1, j), at(i, j + 1), at(i + 1, j + 1)) for i in range(-5, 134) for j in range(129) if (i, j) != (-5, 0)}
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.index("Generate") < text.index("Exchange")  # corners are made after the shuffle
    lines = spark.createDataFrame([(1, 3.2, 4.1, 500.0, 3.4, 4.2, 900.0)], "n int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    hits = horizons.intersect_horizon(lines, surface.where("i >= 0"), GridSpec(135, 130), ["n"])
    assert len(hits.collect()) == 1 and "lambda" not in hits._jdf.queryExecution().optimizedPlan().toString()  # no function of arrays for each line and square
    holes = spark.createDataFrame([(1, 0, *[0.0] * 3, *[1.0] * 3), (1, 1, *[1.0] * 3, *[2.0] * 3), (1, 2, *[3.0] * 3, *[4.0] * 3), (2, 0, *[9.0] * 3, *[8.0] * 3)], f"hole bigint, seq int, {ENDS}")
    pieces = horizons.connect_gaps(holes)
    assert sorted((r.hole, r.seq, r.gap, r.x0, r.z1) for r in pieces.collect()) == [(1, 0, False, 0.0, 1.0), (1, 1, False, 1.0, 2.0), (1, 2, False, 3.0, 4.0), (1, 2, True, 2.0, 3.0), (2, 0, False, 9.0, 8.0)]
    assert "Union" not in pieces._jdf.queryExecution().optimizedPlan().toString()  # pieces are dealt out by hole, not as the file has them


def test_only_tiles_near_points_are_meshed(spark, monkeypatch):
    monkeypatch.setattr(mesh, "TILE", 4)
    rng = np.random.default_rng(3)
    h = spark.createDataFrame([(i, j, i + float(u), j + float(v), 1.0, 0.0) for i in range(40) for j in range(40) for u, v in [rng.uniform(-0.2, 0.2, 2)]], "i int, j int, x double, y double, top double, base double")
    points = spark.createDataFrame([*((k, float(x), float(y), 0.5) for k, (x, y) in enumerate(rng.uniform(7, 17, (60, 2)))), (99, None, 5.0, 0.5), (98, float("nan"), 5.0, 0.5)], "row_id bigint, x double, y double, z double")
    some = mesh.near(h, points, 1.0)
    assert 100 < some.count() < 700  # of 1600
    for nearest in (False, True):
        want, got = (mesh.locate(points, mesh.cells(mesh.vertices(df, 2)), 1.0, nearest=nearest).select("row_id", "i", "j", "k").collect() for df in (h, some))
        assert sorted(want) == sorted(got) and len(got) > 30
    assert mesh.near(h, points.limit(0), 1.0).count() == 0
