"""Vertical sections along a path: cells, centers, areas; grid values at the centers of sections and meshes; phase fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithospark.operators.mesh import centers
from lithospark.operators.spatial import collocate_grid_to_points
from lithospark.spec import GridSpec


def section_cells(path: DataFrame, layers: int, hole: str | None = None) -> DataFrame:
    """i, k, x, y, z, area of a section's cells, and the section's name where path has a column of it.

    path(x, y, top, base, col): the points in the order of col, the first column of data from the point on; the last
    point's col is the last column. Columns divide a segment evenly. A layer is the height divided by layers + 1, from
    the base up, as the format has it. A path of one point has no cells."""
    names = [hole] if hole else []
    by = Window.partitionBy(*[F.col(c) for c in names] or [F.lit(0)]).orderBy("col")
    ends = {f"_{c}": F.lead(c).over(by) for c in ("x", "y", "top", "base", "col")}
    rows = path.withColumns({**ends, "_last": F.lead("col", 2).over(by).isNull()}).where("_col IS NOT NULL")
    rows = rows.withColumn("_end", F.when(F.col("_last"), F.col("_col")).otherwise(F.col("_col") - 1)).where(F.col("_end") >= F.col("col"))
    n = F.col("_end") - F.col("col") + 1
    rows = rows.withColumns({"_n": n, "i": F.explode(F.sequence("col", "_end"))}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    t0, t1 = (F.col("i") - F.col("col")) / F.col("_n"), (F.col("i") - F.col("col") + 1) / F.col("_n")
    level = lambda t, k: at("base", "_base", t) + (at("top", "_top", t) - at("base", "_base", t)) * k / (layers + 1)
    z = [level(t0, F.col("k")), level(t1, F.col("k")), level(t1, F.col("k") + 1), level(t0, F.col("k") + 1)]
    wide = F.sqrt((F.col("_x") - F.col("x")) ** 2 + (F.col("_y") - F.col("y")) ** 2) / F.col("_n")
    middle = (t0 + t1) / 2
    area = (F.abs(z[3] - z[0]) + F.abs(z[2] - z[1])) / 2 * wide
    return rows.select(*names, F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k"), at("x", "_x", middle).alias("x"), at("y", "_y", middle).alias("y"), ((z[0] + z[1] + z[2] + z[3]) / 4).alias("z"), area.alias("area"))


def collocate_grid_to_section(path: DataFrame, layers: int, grid: DataFrame, spec: GridSpec, value: str, hole: str | None = None) -> DataFrame:
    """section_cells with cell_value, the grid's value at the cell's center; null outside the grid."""
    cells = section_cells(path, layers, hole).withColumnsRenamed({"i": "_si", "k": "_sk"})
    return collocate_grid_to_points(cells, grid, spec, value).drop("i", "j", "k").withColumnsRenamed({"_si": "i", "_sk": "k"})


def collocate_grid_to_mesh(mesh: DataFrame, grid: DataFrame, spec: GridSpec, value: str) -> DataFrame:
    """i, j, k of a mesh's cells with cell_value, the grid's value at the cell's center; null outside the grid."""
    cells = centers(mesh).select(F.col("i").alias("_mi"), F.col("j").alias("_mj"), F.col("k").alias("_mk"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return collocate_grid_to_points(cells, grid, spec, value).select(F.col("_mi").alias("i"), F.col("_mj").alias("j"), F.col("_mk").alias("k"), "cell_value")


def random_phase_field(spark: SparkSession, ni: int, nj: int, seed: int) -> DataFrame:
    """i, j, phase from -pi to pi on ni x nj cells: 0 in the center (ni // 2, nj // 2), opposite at cells opposite to it.

    A cell's phase comes from a hash of the seed and its offset, so cells are made apart from each other."""
    cells = spark.range(ni * nj).select((F.col("id") % ni).cast("int").alias("i"), F.floor(F.col("id") / ni).cast("int").alias("j"))
    a, b = F.col("i") - ni // 2, F.col("j") - nj // 2
    side = F.when((a > 0) | ((a == 0) & (b > 0)), 1).when((a == 0) & (b == 0), 0).otherwise(-1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), (a * side).cast("int"), (b * side).cast("int")), 11).cast("double") / float(1 << 53)
    return cells.withColumn("phase", F.when(side == 0, 0.0).otherwise(side * (2 * u - 1) * math.pi))
