"""Grids keyed by cell index: geometry, windows of cells, ensembles, transforms along grid lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lithospark.spec import GridSpec


def make_grid(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """cell, i, j, k and the centers x, y, z."""
    cells = spark.range(spec.cells).withColumnRenamed("id", "cell")
    i, j, k = F.col("cell") % spec.nx, F.floor(F.col("cell") / spec.nx) % spec.ny, F.floor(F.col("cell") / (spec.nx * spec.ny))
    cells = cells.select("cell", i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))
    return cells.withColumns({"x": spec.x0 + (F.col("i") + 0.5) * spec.dx, "y": spec.y0 + (F.col("j") + 0.5) * spec.dy, "z": spec.z0 + (F.col("k") + 0.5) * spec.dz if spec.nz > 1 else F.lit(0.0)})


def around(points: DataFrame, size: float) -> GridSpec:
    """Square cells of that size over the box around the points, from its lower left corner."""
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()  # one row
    return GridSpec(max(1, math.ceil((b[1] - b[0]) / size + 1e-9)), max(1, math.ceil((b[3] - b[2]) / size + 1e-9)), 1, b[0], b[2], 0.0, size, size, 1.0)


def resample(grid: DataFrame, ri: int, rj: int) -> DataFrame:
    return grid.where((F.col("i") % ri == 0) & (F.col("j") % rj == 0)).withColumns({"i": (F.col("i") / ri).cast("int"), "j": (F.col("j") / rj).cast("int")})


def subgrid(grid: DataFrame, i: tuple[int, int], j: tuple[int, int]) -> DataFrame:
    return grid.where(F.col("i").between(*i) & F.col("j").between(*j)).withColumns({"i": F.col("i") - i[0], "j": F.col("j") - j[0]})


def flip(grid: DataFrame, axis: str, n: int) -> DataFrame:
    return grid.withColumn(axis, F.lit(n - 1) - F.col(axis))


def neigh(grid: DataFrame, value: str, di: int, dj: int, name: str = "neigh") -> DataFrame:
    """Adds the value at a grid offset; null outside."""
    other = grid.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col(value).alias(name))
    return grid.join(other, ["i", "j"], "left")


#: Cells of a grid line in one tile.
TILE = 4096
#: Cells of the lines that a group of transforms holds, if a line is shorter.
BLOCK = 1 << 16
#: Cells of the edge of a square tile.
EDGE = 256


def _along(grid: DataFrame, axis: str, other: str, r: int, exprs: dict) -> DataFrame:
    """Adds aggregates over the cells at most r away along an axis: exprs has functions of the window.

    Lines are cut into tiles of TILE cells that also get the r cells beside them, so a long line is many groups."""
    at = F.col(axis)
    tiles = grid.withColumn("_t", F.explode(F.sequence(F.floor((at - r) / TILE), F.floor((at + r) / TILE))))
    w = Window.partitionBy(other, "_t").orderBy(axis).rangeBetween(-r, r)
    return tiles.withColumns({k: f(w) for k, f in exprs.items()}).where(F.floor(at / TILE) == F.col("_t")).drop("_t")


def window_mean(grid: DataFrame, value: str, r: int) -> DataFrame:
    """Mean of the cells at most r away along i and j, of those there are; sums first along i, then along j."""
    out = _along(grid, "i", "j", r, {"_s": F.sum(value).over, "_n": F.count(value).over})
    out = _along(out, "j", "i", r, {"_s2": F.sum("_s").over, "_n2": F.sum("_n").over})
    return out.withColumn("mean", F.when(F.col("_n2") > 0, F.col("_s2") / F.col("_n2"))).drop("_s", "_n", "_s2", "_n2")


def extrema(grid: DataFrame, value: str, r: int) -> DataFrame:
    """Adds is_max, is_min: the cell is at least (at most) every value in its window."""
    out = _along(grid, "i", "j", r, {"_h": F.max(value).over, "_l": F.min(value).over})
    out = _along(out, "j", "i", r, {"_h2": F.max("_h").over, "_l2": F.min("_l").over})
    return out.withColumns({"is_max": F.coalesce(F.col(value) >= F.col("_h2"), F.lit(False)), "is_min": F.coalesce(F.col(value) <= F.col("_l2"), F.lit(False))}).drop("_h", "_l", "_h2", "_l2")


def ridges_valleys(grid: DataFrame, value: str, half: int, size: tuple[int, int], least: float = 0.0) -> DataFrame:
    """Adds ridge, valley: in how many of four directions the cell is above (below) the means of both windows beside it.

    A window reaches half cells to each side and may lie partly outside the grid of `size` cells. Each cell goes once to its
    tile and to those it is in the halo of."""
    s, tiles = half + 1, grid
    reach, edge, kept = s + half, max(EDGE, 4 * (s + half)), grid.columns
    for c in "ij":
        at = F.col(c).cast("bigint")
        tiles = tiles.withColumn(f"_{c}", F.explode(F.sequence(F.floor((at - reach) / edge), F.floor((at + reach) / edge))))
    made_of = StructType([*grid.schema.fields, StructField("ridge", IntegerType()), StructField("valley", IntegerType())])

    def count(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        wide = edge + 2 * reach
        i, j = (cells.column(c).to_numpy().astype(np.int64) for c in "ij")
        a, b = (x - k.as_py() * edge + reach for x, k in zip((i, j), key))
        v = cells.column(value).to_numpy().astype(float)
        known, total, number = ~np.isnan(v), np.zeros((wide, wide)), np.zeros((wide, wide))
        np.add.at(total, (a[known], b[known]), v[known])
        np.add.at(number, (a[known], b[known]), 1.0)
        for axis in (0, 1):  # sums over the window, along i and then along j
            total, number = (sum(np.roll(x, -d, axis) for d in range(-half, half + 1)) for x in (total, number))
        mean = np.where(number > 0, total / np.maximum(number, 1), np.nan)
        own = np.flatnonzero((reach <= a) & (a < reach + edge) & (reach <= b) & (b < reach + edge))
        a, b, v = a[own], b[own], v[own]
        sides = [[mean[a + side * x * s, b + side * y * s] for side in (1, -1)] for x, y in ((0, 1), (1, 1), (1, 0), (1, -1))]
        big = np.abs(v) >= least
        counts = [sum((big & one(v, p) & one(v, q)).astype(np.int32) for p, q in sides) for one in (np.greater, np.less)]  # a lost mean is neither
        out = cells.select(kept).take(pa.array(own))
        for name, x in zip(("ridge", "valley"), counts):
            out = out.append_column(name, pa.array(x, pa.int32()))
        return out

    return tiles.groupBy("_i", "_j").applyInArrow(count, made_of)


def window_median(grid: DataFrame, value: str, r: int) -> DataFrame:
    """i, j, median of the values at most r away; each value is sent to the cells that see it."""
    offsets = F.sequence(F.lit(-r), F.lit(r))
    sent = grid.where(F.col(value).isNotNull()).select("i", "j", value, F.explode(offsets).alias("a")).select("i", "j", value, "a", F.explode(offsets).alias("b"))
    sent = sent.groupBy((F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return grid.select("i", "j").join(sent, ["i", "j"], "left")


def post_sim(ensemble: DataFrame, threshold: float) -> DataFrame:
    """By cell over the realizations: mean, variance, median, quartiles, probability and mean above the threshold."""
    v = F.col("v")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = ensemble.groupBy("cell").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), q.alias("q"), F.avg(F.when(v > threshold, 1.0).otherwise(0.0)).alias("above"), F.avg(F.when(v > threshold, v)).alias("mean_above"))
    return out.select("cell", "n", "mean", "variance", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "above", "mean_above")


def percentiles(ensemble: DataFrame, shares: list[float], interval: float = 0.5) -> DataFrame:
    """By cell over the realizations: the percentiles at these shares, and the bounds of the symmetric interval of that probability."""
    q = F.percentile("v", F.array(*[F.lit(s) for s in (*shares, (1 - interval) / 2, (1 + interval) / 2)]))
    out = ensemble.groupBy("cell").agg(q.alias("q"))
    return out.select("cell", *[F.col("q")[i].alias(f"q{i}") for i in range(len(shares))], F.col("q")[len(shares)].alias("low"), F.col("q")[len(shares) + 1].alias("high"))


def facies(probabilities: dict[int, Column]) -> Column:
    """Category of the largest probability; -1 if none is over -0.0001; the first wins ties."""
    top, out = F.greatest(*probabilities.values()), F.lit(-1)
    for code, p in reversed(probabilities.items()):
        out = F.when((p == top) & (p > -0.0001), code).otherwise(out)
    return out


def fft(grid: DataFrame, inverse: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """(real, i, j, re, im) -> the same, transformed along i and then along j: one shuffle and one grid line at a time each.

    With size, cells that are not there are zeros, and the result has all size[0] x size[1] cells."""
    def along(df: DataFrame, axis: str, key: str, n: int | None) -> DataFrame:
        def line(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(axis)
            at = g[axis].to_numpy() if n else np.arange(len(g))
            z = np.zeros(n or len(g), complex)
            z[at] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
            z = np.fft.ifft(z) if inverse else np.fft.fft(z)
            place = np.arange(n) if n else g[axis].to_numpy()
            return pd.DataFrame({"real": g["real"].iloc[0], axis: place, key: g[key].iloc[0], "re": z.real, "im": z.imag})[list(g.columns)]

        return df.groupBy("real", key).applyInPandas(line, df.schema)

    ni, nj = size or (None, None)
    return along(along(grid.select("real", "i", "j", "re", "im"), "i", "j", ni), "j", "i", nj)


def _centered(c: str, n: int, whole: int) -> F.Column:
    """Lag of a place in a periodic transform of `whole` cells; null outside a map of n cells around lag 0."""
    lag = F.when(F.col(c) < (whole + 1) // 2, F.col(c)).otherwise(F.col(c) - whole)
    return F.when(lag.between(-(n // 2), n - n // 2 - 1), lag)


def varmap_fast(grid: DataFrame, value: str, ni: int, nj: int) -> DataFrame:
    """di, dj, n, gamma on ni x nj lags around 0: largest covariance of the map less the lag's, by products of transforms.

    The covariance of a lag is the mean product of the n pairs of known cells at it less the product of the means of
    their tails and of their heads. The grid is padded to twice its size, so that no pair is formed across its borders.
    Lags without a pair have no row. Lost cells may be nulls or absent."""
    # real fields along i, so half of the frequencies; then a line along j forth, multiplied and back at once, cut to the lags
    rows = grid.where(F.col(value).isNotNull()).select("i", F.col("j").cast("bigint").alias("j"), F.col(value).cast("double").alias("v"))
    names = ["a_re", "a_im", "m_re", "m_im"]
    lags = [np.arange(n) - n // 2 for n in (ni, nj)]
    split = lambda z: [x.ravel() for c in z for x in (c.real, c.imag)]
    sums = ("c", "n", "tails", "heads")

    def lines(n: int, c: str) -> Column:
        return F.floor(F.col(c) / max(1, BLOCK // n)).cast("bigint").alias("_line")  # some lines of n cells

    def placed(t: pa.Table, columns: list[str], key: str, at: str, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, where = np.unique(t.column(key).to_numpy(), return_inverse=True)
        out = []
        for c in columns:
            z = np.zeros((len(keys), n))
            z[where, t.column(at).to_numpy()] = t.column(c).to_numpy()
            out.append(z)
        return keys, out

    def table(schema: str, *columns: np.ndarray) -> pa.Table:
        return pa.table(dict(zip([c.split()[0] for c in schema.split(", ")], columns)))

    def forth(t: pa.Table) -> pa.Table:
        j, (v, m) = placed(t.append_column("m", pa.array(np.ones(len(t)))), ["v", "m"], "j", "i", ni)
        z = [np.fft.rfft(x, 2 * ni, axis=1) for x in (v, m)]
        return table(first, np.tile(np.arange(ni + 1), len(j)), np.repeat(j, ni + 1), *split(z))

    def multiplied(t: pa.Table) -> pa.Table:
        i, (a_re, a_im, m_re, m_im) = placed(t, names, "i", "j", nj)
        a, m = (np.fft.fft(x, 2 * nj, axis=1) for x in (a_re + 1j * a_im, m_re + 1j * m_im))
        z = [np.fft.ifft(x, axis=1)[:, lags[1]] for x in (a * a.conj(), m * m.conj(), m.conj() * a, m * a.conj())]
        return table(second, np.repeat(i, nj), np.tile(lags[1], len(i)), *split(z))

    def back(t: pa.Table) -> pa.Table:
        j, parts = placed(t, [f"{c}_{p}" for c in sums for p in ("re", "im")], "dj", "i", ni + 1)
        c, n, tails, heads = (np.fft.irfft(re + 1j * im, 2 * ni, axis=1)[:, lags[0]].ravel() for re, im in zip(parts[::2], parts[1::2]))
        n = np.rint(n).astype(np.int64)
        on = n > 0
        d = np.where(on, n, 1)
        return table(third, *(x[on] for x in (np.tile(lags[0], len(j)), np.repeat(j, ni), n, c / d - tails / d * (heads / d))))

    first = "i bigint, j bigint, " + ", ".join(f"{c} double" for c in names)
    second = "i bigint, dj bigint, " + ", ".join(f"{c}_{p} double" for c in sums for p in ("re", "im"))
    third = "di bigint, dj bigint, n bigint, cov double"
    cov = rows.groupBy(lines(ni, "j")).applyInArrow(forth, first).groupBy(lines(nj, "i")).applyInArrow(multiplied, second).groupBy(lines(ni, "dj")).applyInArrow(back, third)
    return cov.join(F.broadcast(cov.agg(F.max("cov").alias("_top")))).select("di", "dj", "n", (F.col("_top") - F.col("cov")).alias("gamma"))  # one row


def varmap_fim(grid: DataFrame, value: str, ni: int, nj: int) -> DataFrame:
    """di, dj, gamma of a periodic grid: its squared amplitudes without phases, transformed back, taken from their largest value.

    Lost and absent cells count as 0."""
    rows = grid.where(F.col(value).isNotNull()).select(F.lit(0).alias("real"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    density = fft(rows, size=(ni, nj)).withColumns({"re": (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (ni * nj), "im": F.lit(0.0)})
    cov = fft(density, inverse=True, size=(ni, nj)).select(_centered("i", ni, ni).alias("di"), _centered("j", nj, nj).alias("dj"), F.col("re").alias("cov"))
    return cov.join(F.broadcast(cov.agg(F.max("cov").alias("_top")))).select("di", "dj", (F.col("_top") - F.col("cov")).alias("gamma"))  # one row
