"""Variogram fits, cokriging, wavelets and forests against dense or recursive versions."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithospark.operators import cokriging, fitting, forests, wavelets
from lithospark.spec import Structure, VariogramModel


def spherical(sill, r=50.0, nugget=0.0):
    return VariogramModel(nugget, (Structure("spherical", sill, (r, r, r)),))


def cov(h, sill, r=50.0, nugget=0.0):
    h = np.asarray(h, float)
    return np.where(h == 0, sill + nugget, np.where(h >= r, 0.0, sill * (1 - 1.5 * h / r + 0.5 * (h / r) ** 3)))


def surface(spark, p, n=12):
    rows = []
    for di in range(-n, n + 1):
        for dj in range(-n, n + 1):
            a, r, z, s = p
            z = math.radians(z)
            h = math.hypot((di * math.sin(z) + dj * math.cos(z)) / a, (di * math.cos(z) - dj * math.sin(z)) / (a * r))
            rows.append((di, dj, float(s if h >= 1 else s * (1.5 * h - 0.5 * h**3))))
    return spark.createDataFrame([*rows, (n + 1, 0, None)], "di int, dj int, gamma double"), rows


def test_misfits_equal_the_sum(spark):
    made, rows = surface(spark, (8.0, 0.5, 30.0, 4.0))
    _, other = surface(spark, (5.0, 1.0, 0.0, 3.0))
    got = {r["candidate"]: r["misfit"] for r in fitting.misfits(made, np.array([(8.0, 0.5, 30.0, 4.0), (5.0, 1.0, 0.0, 3.0)]), ["spherical"]).collect()}
    plain = sum((g - k) ** 2 / (math.hypot(i, j) ** 2 * 6.28) for (i, j, g), (_, _, k) in zip(rows, other) if (i, j) != (0, 0))
    assert got[0] < 1e-20 and math.isclose(got[1], plain)
    assert fitting.misfits(made.limit(0), np.array([(8.0, 0.5, 30.0, 4.0)]), ["spherical"]).collect()[0:1] in ([], [(0, 0.0)])


@pytest.mark.parametrize("method", sorted(fitting.METHODS))
def test_a_known_model_is_found(spark, method):
    made, _ = surface(spark, (8.0, 0.5, 30.0, 4.0), 9)
    made = made.coalesce(1)
    first = min(r["misfit"] for r in fitting.misfits(made, np.random.default_rng(1).random((40, 4)) * [8, 0.9, 180, 4.4] + [1, 0.1, 0, 0], ["spherical"]).collect())
    model, misfit = fitting.fit_variogram(made, ["spherical"], method, population=40, generations=40, seed=3)
    (s,) = model.structures
    assert misfit < 0.2 * first and abs(s.ranges[0] - 8) < 1.5 and abs(s.sill - 4) < 0.5 and min(abs(s.azimuth - 30), 180 - abs(s.azimuth - 30)) < 15


def test_cokriging_equals_a_dense_solve(spark):
    rng = np.random.default_rng(5)
    xy, uv, at = rng.uniform(0, 60, (5, 2)), rng.uniform(0, 60, (7, 2)), np.array([20.0, 30.0])
    v, u = rng.normal(3, 1, 5), rng.normal(9, 2, 7)
    table = lambda p, x, name: spark.createDataFrame(pd.DataFrame({"row_id": range(len(p)), "x": p[:, 0], "y": p[:, 1], name: x}))
    one, two = table(xy, v, "v"), table(uv, u, "u").withColumn("v", F.lit("clash"))
    target = spark.createDataFrame([(99, *map(float, at), 10.5), (100, 5000.0, 5000.0, 1.0)], "row_id long, x double, y double, s double")
    models = {(0, 0): spherical(1.0, nugget=0.1), (0, 1): spherical(0.7), (1, 1): spherical(2.0, nugget=0.2), (0, 2): spherical(0.5), (1, 2): spherical(0.6), (2, 2): spherical(1.5)}
    places, kind = np.r_[xy, uv], np.r_[np.zeros(5, int), np.ones(7, int)]
    sill, nug = {(0, 0): 1.0, (0, 1): 0.7, (1, 1): 2.0}, {(0, 0): 0.1, (0, 1): 0.0, (1, 1): 0.2}
    key = lambda i, j: (min(i, j), max(i, j))
    c = np.array([[cov(math.dist(p, q), sill[key(i, j)], nugget=nug[key(i, j)]) for q, j in zip(places, kind)] for p, i in zip(places, kind)])
    c0 = np.array([cov(math.dist(p, at), sill[key(0, i)], nugget=nug[key(0, i)]) for p, i in zip(places, kind)])
    f = np.c_[kind == 0, kind == 1].astype(float)
    w = np.linalg.solve(np.block([[c, f], [f.T, np.zeros((2, 2))]]), np.r_[c0, 1, 0])
    (got,) = cokriging.cokrige(target, [(one, "v", 9), (two, "u", 9)], models, 200.0).collect()
    assert np.isclose(got["estimate"], w[:12] @ np.r_[v, u]) and np.isclose(got["variance"], 1.1 - w @ np.r_[c0, 1, 0]) and got["n"] == 5
    w = np.linalg.solve(c, c0)
    (got,) = cokriging.cokrige(target, [(one, "v", 9), (two, "u", 9)], models, 200.0, [3.0, 9.0]).collect()
    assert np.isclose(got["estimate"], 3 + w @ np.r_[v - 3, u - 9])
    # a collocated third variable, three and two neighbors
    near = lambda p, n: sorted(range(len(p)), key=lambda i: math.dist(p[i], at))[:n]
    a, b = near(xy, 3), near(uv, 2)
    places, kind, values = np.r_[xy[a], uv[b], [at]], np.array([0, 0, 0, 1, 1, 2]), np.r_[v[a], u[b], 10.5]
    sill |= {(0, 2): 0.5, (1, 2): 0.6, (2, 2): 1.5}
    nug |= {(0, 2): 0.0, (1, 2): 0.0, (2, 2): 0.0}
    c = np.array([[cov(math.dist(p, q), sill[key(i, j)], nugget=nug[key(i, j)]) for q, j in zip(places, kind)] for p, i in zip(places, kind)])
    c0 = np.array([cov(math.dist(p, at), sill[key(0, i)], nugget=nug[key(0, i)]) for p, i in zip(places, kind)])
    f = np.stack([kind == k for k in range(3)], 1).astype(float)
    w = np.linalg.solve(np.block([[c, f], [f.T, np.zeros((3, 3))]]), np.r_[c0, 1, 0, 0])
    (got,) = cokriging.cokrige(target, [(one, "v", 3), (two, "u", 2)], models, 200.0, collocated="s").collect()
    assert np.isclose(got["estimate"], w[:6] @ values)
    (got,) = cokriging.cokrige(target.withColumn("s", F.lit(None).cast("double")), [(one, "v", 3), (two, "u", 2)], models, 200.0, collocated="s").collect()
    assert got["n"] == 3
    assert cokriging.cokrige(target, [(one, "v", 9), (two, "u", 9)], models, 200.0, n_min=6).count() == 0
    assert cokriging.cokrige(target, [(one.limit(0), "v", 9), (two, "u", 9)], models, 200.0).count() == 0


def test_samples_are_met_exactly(spark):
    xy = spark.createDataFrame([(i, 7.0 * i, 3.0 * i % 5, float(i)) for i in range(6)], "row_id int, x double, y double, v double")
    models = {(0, 0): spherical(1.0), (0, 1): cokriging.markov_model(spherical(1.0), 0.5, 2.0), (1, 1): spherical(2.0)}
    got = cokriging.cokrige(xy.drop("v"), [(xy, "v", 4), (xy.withColumn("w", F.col("v") * 2), "w", 1)], models, 100.0).collect()
    assert len(got) == 6 and all(np.isclose(r["estimate"], r["row_id"]) and abs(r["variance"]) < 1e-9 for r in got)


@pytest.mark.parametrize("taps", [2, 4, 8, 20])
def test_filters_are_orthonormal(taps):
    h = wavelets.daubechies(taps)
    assert math.isclose(h.sum(), math.sqrt(2), rel_tol=1e-6) and all(abs(h[: taps - 2 * k] @ h[2 * k :] - (k == 0)) < 1e-5 for k in range(taps // 2))
    x = np.random.default_rng(taps).normal(size=32)
    y = wavelets.step(x, h, False)
    assert np.allclose(wavelets.step(y, h, True), x, atol=1e-4) and np.isclose(y @ y, x @ x, rtol=1e-4)
    with pytest.raises(ValueError):
        wavelets.daubechies(3)


@pytest.mark.parametrize("interleaved", [False, True])
def test_wavelets_of_a_grid(spark, interleaved):
    rng = np.random.default_rng(2)
    z, h = rng.normal(size=(5, 6)), wavelets.daubechies(4)
    grid = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(5) for j in range(6)], "i int, j int, v double")
    square = wavelets.mirror_pad(grid, "v", (5, 6))
    full = np.zeros((8, 8))
    for r in square.collect():
        full[r["i"], r["j"]] = r["v"]
    assert np.array_equal(full[:5, 2:], z) and np.array_equal(full[5:, 2:], z[[4, 3, 2]]) and np.array_equal(full[:5, :2], z[:, [1, 0]])
    want = full.copy()
    if interleaved:
        for n in (8, 4, 2):
            want[:n, :n] = np.apply_along_axis(wavelets.step, 0, want[:n, :n], h, False)
            want[:n, :n] = np.apply_along_axis(wavelets.step, 1, want[:n, :n], h, False)
    else:
        for axis in (0, 1):
            for n in (8, 4, 2):
                part = (slice(n), slice(None)) if axis == 0 else (slice(None), slice(n))
                want[part] = np.apply_along_axis(wavelets.step, axis, want[part], h, False)
    made = wavelets.dwt(square, "v", 8, 4, interleaved=interleaved)
    assert all(abs(r["v"] - want[r["i"], r["j"]]) < 1e-9 for r in made.collect())
    back = wavelets.crop(wavelets.dwt(made, "v", 8, 4, inverse=True, interleaved=interleaved), "v", 8, (5, 6)).collect()
    assert len(back) == 30 and all(abs(r["v"] - z[r["i"], r["j"]]) < 1e-9 for r in back)


@pytest.mark.parametrize("size, taps, levels", [((5, 6), 4, None), ((3, 1), 2, 1), ((7, 600), 8, None), ((40, 3), 6, 2)])
def test_wavelets_by_lines_equal_those_of_the_square(spark, size, taps, levels):
    z = np.random.default_rng(4).normal(size=size)
    z[size[0] // 2, 0] = np.nan  # lost
    grid = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(size[0]) for j in range(size[1]) if (i, j) != (1, size[1] - 1)], "i int, j int, v double")
    edge = 1 << (max(size) - 1).bit_length()
    made = wavelets.dwt_grid(grid, "v", size, taps, levels)
    assert not {"Range", "Join"} & set(re.findall(r"Range|Join", made._jdf.queryExecution().toString()))  # no cells of the square before the last step
    got, want = (df.toPandas().sort_values(["i", "j"])["v"].to_numpy() for df in (made, wavelets.dwt(wavelets.mirror_pad(grid, "v", size), "v", edge, taps, levels)))
    assert len(got) == edge * edge and np.allclose(got, want, atol=1e-9)
    halved = wavelets.dwt_filter(grid, "v", size, lambda j, x: x / 2, taps, levels).collect()
    z[1, size[1] - 1] = 0
    assert len(halved) == z.size and all(abs(r["v"] - np.nan_to_num(z[r["i"], r["j"]]) / 2) < 1e-6 for r in halved)


def tree_by_recursion(x, y, classes, depth, least):
    """value of each row's leaf, by trying every value of every feature."""
    score = lambda v: sum(np.bincount(v.astype(int)) ** 2) / len(v) if classes else v.sum() ** 2 / len(v)
    value = lambda v: float(np.bincount(v.astype(int)).argmax()) if classes else v.mean()
    out = np.full(len(y), value(y))
    if depth == 0 or len(y) < 2 * least:
        return out
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            on = x[:, f] <= cut
            if min(on.sum(), (~on).sum()) >= least:
                gain = score(y[on]) + score(y[~on]) - score(y)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, on)
    if best[1] is not None:
        for on in (best[1], ~best[1]):
            out[on] = tree_by_recursion(x[on], y[on], classes, depth - 1, least)
    return out


@pytest.mark.parametrize("classes", [True, False])
def test_a_tree_equals_recursion(spark, classes):
    rng = np.random.default_rng(11)
    x = np.c_[rng.integers(0, 12, 300), rng.integers(0, 9, 300)].astype(float)
    y = ((x[:, 0] > 5) + (x[:, 1] > 3) + (rng.random(300) < 0.1)).astype(float) if classes else 3 * x[:, 0] - x[:, 1] ** 2 + rng.normal(size=300)
    table = spark.createDataFrame(pd.DataFrame({"row_id": range(300), "a": x[:, 0], "b": x[:, 1], "y": y, "node": "clash"}))
    forest = forests.grow(table.unionByName(table.limit(3).withColumn("y", F.lit(None).cast("double"))), ["a", "b"], "y", classes, depth=4, bins=64, least=5, bootstrap=False)
    got = {r["row_id"]: r[1] for r in forests.predict(table, forest).collect()}
    assert np.allclose([got[i] for i in range(300)], tree_by_recursion(x, y, classes, 4, 5))


def test_forests_vote(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (600, 3))
    table = spark.createDataFrame(pd.DataFrame({"row_id": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "k": (x[:, 0] > 0.5) * 2 + 1, "v": 10 * x[:, 1]}))
    forest = forests.grow(table, ["a", "b", "c"], "k", True, trees=5, depth=3)
    again = forests.grow(table.repartition(7), ["a", "b", "c"], "k", True, trees=5, depth=3)
    assert forest.splits == again.splits and forest.leaves == again.leaves and len({str(s) for s in forest.splits}) > 1  # samples differ by tree, not by task
    out = forests.predict(table, forest).toPandas().set_index("row_id").sort_index()
    assert (out["class"].to_numpy() == (x[:, 0] > 0.5) * 2 + 1).mean() > 0.97 and set(np.round(out["uncertainty"] * 5)) <= {0, 1, 2}
    numbers = forests.grow(table, ["a", "b", "c"], "v", False, trees=4, depth=5)
    out = forests.predict(table, numbers).toPandas().set_index("row_id").sort_index()
    assert np.abs(out["mean"] - 10 * x[:, 1]).mean() < 0.6 and (out["variance"] >= 0).all()
    leaf = lambda t, f, code: f.leaves[t][int(f.nodes(code, t, 5)[0])]
    code = np.array([[int(np.searchsorted(numbers.edges[n], x[7, n], "left")) for n in range(3)]])
    parts = [leaf(t, numbers, code) for t in range(4)]
    mean = sum(a * s for a, s in parts) / sum(s for _, s in parts)
    assert np.isclose(out["mean"][7], mean) and np.isclose(out["variance"][7], np.mean([(a - mean) ** 2 for a, _ in parts]))
    assert forests.predict(table, forests.grow(table.limit(0), ["a"], "k", True)).count() == 0 and forests.predict(table.limit(0), forest).count() == 0


def test_gabor_responses(spark):
    from lithospark.operators import filters

    z = np.random.default_rng(3).normal(size=(9, 7))
    z[2, 3] = np.nan
    grid = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(9) for j in range(7)], "i int, j int, v double")
    kernel = filters.gabor_kernel(0.3, 70.0, (1.5, 2.5), 2)
    assert len(kernel) == 25 and math.isclose(sum(math.hypot(re, im) for *_, re, im in kernel), 1)
    full = np.nan_to_num(z)
    for r in filters.gabor(grid, "v", 9, 7, 0.3, 70.0, (1.5, 2.5), 2).collect():
        want = sum(full[r["i"] - a, r["j"] - b] * complex(re, im) for a, b, re, im in kernel if 0 <= r["i"] - a < 9 and 0 <= r["j"] - b < 7)
        assert abs(complex(r["re"], r["im"]) - want) < 1e-9 and abs(r["amplitude"] - abs(want)) < 1e-9


def test_splines(spark):
    from lithospark.operators import filters

    rng = np.random.default_rng(7)
    z = rng.normal(size=(14, 11))
    known = rng.random(z.shape) < 0.6
    grid = spark.createDataFrame([(i, j, float(z[i, j]) if known[i, j] else None) for i in range(14) for j in range(11)], "i int, j int, v double")
    one = {(r["i"], r["j"]): r for r in filters.fill_nulls_spline(grid, "v", 0.0, 64, 0).collect()}  # one tile: the dense solution
    p = np.argwhere(known).astype(float)
    k = lambda a, b: np.array([[0.0 if (x == y).all() else ((x - y) ** 2).sum() * math.log(math.dist(x, y)) for y in b] for x in a])
    for stiffness in (0.0, 0.3):
        a = np.block([[k(p, p), np.c_[np.ones(len(p)), p]], [np.r_[np.ones((1, len(p))), p.T], np.zeros((3, 3))]])
        mean = sum(math.dist(x, y) for x in p for y in p) / len(p) ** 2
        a[: len(p), : len(p)] += stiffness * mean**2 * np.eye(len(p))
        w = np.linalg.solve(a, np.r_[z[known], 0, 0, 0])
        cells = np.array([(i, j) for i in range(14) for j in range(11)], float)
        want = k(cells, p) @ w[: len(p)] + np.c_[np.ones(len(cells)), cells] @ w[len(p) :]
        got = one if not stiffness else {(r["i"], r["j"]): r for r in filters.fill_nulls_spline(grid, "v", stiffness, 64, 0).collect()}
        assert np.allclose([got[int(i), int(j)]["spline"] for i, j in cells], want, atol=1e-6)
    tiles = filters.fill_nulls_spline(grid, "v", 0.0, 5, 3).collect()
    assert all(abs(r["spline"] - z[r["i"], r["j"]]) < 1e-6 for r in tiles if known[r["i"], r["j"]]) and all(r["filled"] is not None for r in tiles)
    flat = spark.createDataFrame([(i, j, 2.0 * i - j if (i + j) % 3 else None) for i in range(40) for j in range(30)], "i int, j int, v double")
    assert all(abs(r["filled"] - (2.0 * r["i"] - r["j"])) < 1e-6 for r in filters.fill_nulls_spline(flat, "v", 0.5, 10, 4).collect())  # a plane stays one
    lost = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (90, 90, None)], "i int, j int, v double")
    assert {r["i"]: r["filled"] for r in filters.fill_nulls_spline(lost, "v", 0.0, 8, 2).collect()}[90] is None


def test_leaving_a_sample_out(spark):
    """Cross-validation: each sample from the others, against kriging of a table without it."""
    from lithospark.operators import spatial

    rng = np.random.default_rng(8)
    xy, v = rng.uniform(0, 60, (9, 2)), rng.normal(size=9)
    samples = spark.createDataFrame(pd.DataFrame({"row_id": range(9), "x": xy[:, 0], "y": xy[:, 1], "v": v}))
    out = {r["row_id"]: r for r in spatial.krige(samples.drop("v"), samples, "v", spherical(1.0), 200.0, 5, leave_out_self=True).collect()}
    for n in range(9):
        near = sorted((i for i in range(9) if i != n), key=lambda i: math.dist(xy[i], xy[n]))[:5]
        a = np.ones((6, 6))
        a[5, 5] = 0
        a[:5, :5] = cov(np.linalg.norm(xy[near][:, None] - xy[near][None], axis=-1), 1.0)
        r = np.append(cov(np.linalg.norm(xy[near] - xy[n], axis=1), 1.0), 1)
        w = np.linalg.solve(a, r)
        assert np.isclose(out[n]["estimate"], w[:5] @ v[near]) and np.isclose(out[n]["variance"], 1 - w @ r) and out[n]["n"] == 5


def test_factors_and_the_local_mean_add_up(spark):
    from lithospark.operators import spatial

    rng = np.random.default_rng(4)
    samples = spark.createDataFrame(pd.DataFrame({"row_id": range(12), "x": rng.uniform(0, 40, 12), "y": rng.uniform(0, 40, 12), "v": rng.normal(5, 1, 12)}))
    targets = spark.createDataFrame([(100, 11.0, 9.0), (101, 30.0, 22.0)], "row_id long, x double, y double").unionByName(samples.where("row_id = 3").select("row_id", "x", "y"))
    model = VariogramModel(0.2, (Structure("spherical", 0.5, (15.0, 15.0, 15.0)), Structure("spherical", 0.8, (60.0, 60.0, 60.0))))
    whole = {r["row_id"]: r["estimate"] for r in spatial.krige(targets, samples, "v", model, 100.0, 8).collect()}
    parts = [{r["row_id"]: r["estimate"] for r in spatial.factorial_krige(targets, samples, "v", model, f, 100.0, 8).collect()} for f in (-1, 0, 1, 2)]
    assert all(np.isclose(sum(p[k] for p in parts), v) for k, v in whole.items()) and len(whole) == 3
    assert abs(parts[1][100]) < 1e-9 and abs(parts[1][3]) > 1e-6  # the nugget is at samples only


def test_sections_and_phases(spark):
    from lithospark.operators import sections

    path = spark.createDataFrame([(0.0, 0.0, 6.0, 0.0, 0), (4.0, 3.0, 6.0, 0.0, 2), (4.0, 9.0, 9.0, 3.0, 3)], "x double, y double, top double, base double, col int")
    got = {(r["i"], r["k"]): [round(r[c], 9) for c in ("x", "y", "z", "area")] for r in sections.section_cells(path, 2).collect()}
    assert len(got) == 8 and got[0, 0] == [1.0, 0.75, 1.0, 5.0] and got[1, 1] == [3.0, 2.25, 3.0, 5.0] and got[3, 0] == [4.0, 7.5, 3.25, 6.0]
    assert sections.section_cells(path.limit(1), 2).count() == 0
    two = sections.section_cells(path.withColumn("name", F.lit("a")).unionByName(path.withColumn("name", F.lit("b"))), 2, "name")
    assert two.count() == 16 and two.columns[0] == "name"
    a, b = sections.random_phase_field(spark, 6, 5, 1).collect(), sections.random_phase_field(spark.newSession(), 6, 5, 1).collect()
    assert sorted(a) == sorted(b) != sorted(sections.random_phase_field(spark, 6, 5, 2).collect())
    at = {(r["i"], r["j"]): r["phase"] for r in a}
    assert at[3, 2] == 0 and all(abs(v + at[6 - i, 4 - j]) < 1e-12 for (i, j), v in at.items() if i > 0) and len(set(at.values())) > 25


def test_rank_and_freedom(spark):
    from lithospark.operators import markov

    ftm = spark.createDataFrame([("a", "b", 2), ("b", "a", 4), ("a", "c", 1), ("b", "c", 0), ("c", "a", 2)], "from string, to string, n long")
    r = markov.independence_test(ftm).first()
    assert (r["categories"], r["freedom"]) == (3, 3) and markov.matrix_rank(ftm) == 2 and markov.matrix_rank(ftm.limit(0)) == 0
    bent = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0, 3.0, 4.0, 12.0)], "row_id int, hole int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    m = markov.segment_measures(bent).first()
    assert (m["length"], m["height"], m["mid"], m["mid_x"], m["mid_y"]) == (13.0, 12.0, 6.0, 1.5, 2.0)


def test_tiles_with_one_pattern_share_their_spline(spark):
    from lithospark.operators import filters

    z = np.random.default_rng(2).normal(size=32 * 32)
    i, j = np.divmod(np.arange(32 * 32), 32)
    known = (2 * j + i) % 7 != 0
    place = (i * 32 + j).astype(np.int32)
    filters.spline_weights.cache_clear()
    weights = [filters.spline_weights(place[known].tobytes(), 32, place.tobytes(), 0.0) for _ in range(3)]
    assert filters.spline_weights.cache_info().misses == 1 and np.abs((weights[2] @ z[known])[known] - z[known]).max() < 1e-9
    assert np.allclose(weights[0].sum(1), 1, atol=1e-9) and np.allclose(weights[0] @ (3.0 * i - j)[known], 3.0 * i - j, atol=1e-7)


@pytest.mark.parametrize("classes", [True, False])
def test_histograms_of_a_task_are_few_rows(spark, monkeypatch, classes):
    """A task sums its histograms up over its batches."""
    frame, made = type(spark.range(1)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: made.append((f, self)) or plain(self, f, *a, **k))
    table = spark.createDataFrame([(n, float(n % 7), float(n % 3)) for n in range(200)], "row_id bigint, a double, y double")
    forests.grow(table, ["a"], "y", classes, trees=2, depth=2, bins=8, bootstrap=False)
    run, rows = made[0]
    whole = rows.toArrow()
    out = [b.to_pandas() for b in run(iter(whole.to_batches(max_chunksize=10)))]
    assert sum(map(len, out)) == 2 * 7 * (3 if classes else 1)
    assert sum(o["n"].sum() for o in out) == 400 and np.isclose(sum(o["s"].sum() for o in out), 2 * sum(n % 3 for n in range(200)))
