"""Directional responses of grids by products of transforms, and splines through their known cells by blended tiles."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.operators.grids import fft


def gabor_kernel(frequency: float, azimuth: float, sigmas: tuple[float, float], half: int) -> list[tuple[int, int, float, float]]:
    """a, b, re, im of the offsets up to half cells: a wave along the azimuth under a Gaussian, which sums up to 1.

    sigmas: along and across the azimuth; frequency in waves a cell."""
    z = math.radians(azimuth)
    a, b = np.meshgrid(np.arange(-half, half + 1), np.arange(-half, half + 1), indexing="ij")
    u, w = a * math.sin(z) + b * math.cos(z), a * math.cos(z) - b * math.sin(z)
    k = np.exp(-0.5 * ((u / sigmas[0]) ** 2 + (w / sigmas[1]) ** 2))
    k = k / k.sum() * np.exp(2j * math.pi * frequency * u)
    return list(zip(a.ravel().tolist(), b.ravel().tolist(), k.real.ravel().tolist(), k.imag.ravel().tolist()))


def gabor(grid: DataFrame, value: str, ni: int, nj: int, frequency: float, azimuth: float, sigmas: tuple[float, float], half: int) -> DataFrame:
    """i, j, re, im, amplitude on ni x nj cells: the grid convolved with the kernel's real and imaginary part.

    Lost and absent cells are 0, as is all around the grid. The kernel's (2 half + 1)^2 numbers come from the driver; grid
    and kernel are transformed by lines, multiplied and transformed back."""
    size = ni + 2 * half, nj + 2 * half
    cells = grid.where(F.col(value).isNotNull()).select(F.lit(0).alias("real"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    kernel = [(1, a % size[0], b % size[1], re, im) for a, b, re, im in gabor_kernel(frequency, azimuth, sigmas, half)]
    both = fft(cells.unionByName(grid.sparkSession.createDataFrame(kernel, "real int, i int, j int, re double, im double")), size=size)
    part = lambda n: F.max(F.when(F.col("real") == n, F.struct("re", "im")))
    pair = both.groupBy("i", "j").agg(part(0).alias("g"), part(1).alias("k")).where("g IS NOT NULL AND k IS NOT NULL")
    product = pair.select(F.lit(0).alias("real"), "i", "j", (F.col("g.re") * F.col("k.re") - F.col("g.im") * F.col("k.im")).alias("re"), (F.col("g.re") * F.col("k.im") + F.col("g.im") * F.col("k.re")).alias("im"))
    out = fft(product, inverse=True, size=size).where((F.col("i") < ni) & (F.col("j") < nj))
    return out.select("i", "j", "re", "im", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude"))


@lru_cache(maxsize=16)
def spline_weights(known: bytes, wide: int, asked: bytes, stiffness: float) -> np.ndarray:
    """m x n: what the n known cells weigh in the values at the m asked ones, for the spline r^2 ln r with a plane.

    known and asked are the cells' places i * wide + j, as bytes of ascending int32, so that tiles with the same pattern
    of known cells share one solution. stiffness x (mean distance)^2 is on the diagonal."""
    at, on = (np.stack(np.divmod(np.frombuffer(x, np.int32), wide), 1) for x in (asked, known))
    n, middle = len(on), at.mean(0)
    r2 = np.arange(2 * wide * wide, dtype=float)
    radial = 0.5 * r2 * np.log(np.maximum(r2, 1.0))  # by the square of the distance, a whole number
    square = lambda p: ((p[:, :1] - on[:, 0]) ** 2 + (p[:, 1:] - on[:, 1]) ** 2)
    plane = lambda p: np.c_[np.ones(len(p)), p - middle]
    k = radial[square(on)]
    if stiffness:
        mean = np.sqrt(square(on)).sum() / (n * n)
        k = k + stiffness * mean * mean * np.eye(n)
    a, right = np.block([[k, plane(on)], [plane(on).T, np.zeros((3, 3))]]), np.c_[radial[square(at)], plane(at)]
    if n < 3 or np.linalg.matrix_rank(plane(on)) < 3:
        return right @ np.linalg.lstsq(a, np.eye(n + 3)[:, :n], rcond=None)[0]
    return np.ascontiguousarray(np.linalg.solve(a, right.T)[:n].T)  # a is symmetric


def fill_nulls_spline(grid: DataFrame, value: str, stiffness: float = 0.0, tile: int = 24, halo: int = 8) -> DataFrame:
    """i, j, spline, filled: thin-plate splines through the known cells, at all cells of grid; filled keeps the known ones.

    The splines of square tiles, each through the known cells of the tile and `halo` cells around it, are blended with
    weights that fall to nothing at the halo's border; a spline without stiffness meets the known cells exactly. A tile of
    the grid's size is one spline through all. A tile holds (tile + 2 halo)^2 cells at most, whatever the grid, and tiles
    with the same pattern of known cells are solved once in a worker. Cells that no tile with a known cell reaches stay null."""
    cell = grid.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col(value).cast("double").alias("v"))
    spans = {f"_{c}": F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)).cast("array<int>")) for c in "ij"}
    sent = cell
    for name, span in spans.items():
        sent = sent.withColumn(name, span)

    def solve(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        edge, corner = tile + 2 * halo, [k.as_py() * tile for k in key]
        at = np.stack([cells.column(c).to_numpy() - k + halo for c, k in zip("ij", corner)], 1)
        place = (at[:, 0] * edge + at[:, 1]).astype(np.int32)
        order = np.argsort(place, kind="stable")
        place, v = place[order], cells.column("v").to_numpy().astype(float)[order]
        known = ~np.isnan(v)
        if not known.any():
            return pa.table([[]] * 4, schema=made_of)
        h = spline_weights(place[known].tobytes(), edge, place.tobytes(), stiffness) @ v[known]
        w = np.prod(np.maximum(0.0, 1 - np.abs(at[order] - halo - (tile - 1) / 2) / (tile / 2 + halo + 0.5)), axis=1)
        return pa.table([*(at[order, n] + (k - halo) for n, k in enumerate(corner)), h, w], schema=made_of)

    made_of = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("h", pa.float64()), ("w", pa.float64())])
    parts = sent.groupBy("_i", "_j").applyInArrow(solve, "i int, j int, h double, w double")
    made = parts.groupBy("i", "j").agg((F.sum(F.col("h") * F.col("w")) / F.sum("w")).alias("spline"))
    return cell.join(made, ["i", "j"], "left").select("i", "j", "spline", F.coalesce("v", "spline").alias("filled"))
