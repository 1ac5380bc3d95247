"""Meshes between horizons: vertices, cells of eight vertices, centers and volumes; grids put into other grids; factors of matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vertices(horizons: DataFrame, layers: int) -> DataFrame:
    """i, j, k, x, y, z from horizons(i, j, x, y, top, base): layers + 1 vertices, evenly from base to top."""
    z = F.col("base") + F.col("k") / layers * (F.col("top") - F.col("base"))
    return horizons.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(layers)))).select("i", "j", "k", "x", "y", z.alias("z"))


#: Offsets (i, j, k) of a cell's vertices (fixed values).
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


#: Cells of a tile's edge.
TILE = 64


def cells(points: DataFrame) -> DataFrame:
    """i, j, k, v0 to v7 (structs x, y, z) of the cells all of whose vertices are there.

    Each vertex is sent once, and at borders also to the tiles before; a cell gathers its eight in its tile."""
    tiles = points.select("i", "j", "k", "x", "y", "z")
    for c in "ijk":
        tiles = tiles.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / TILE), F.floor(F.col(c) / TILE)))))
    tile = ["_i", "_j", "_k"]
    corners = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, (a, b, c) in enumerate(CORNERS)])
    sent = tiles.repartition(*tile).withColumn("o", F.explode(corners))
    sent = sent.select(*tile, *[(F.col(c) - F.col(f"o.{o}")).alias(c) for c, o in zip("ijk", "abc")], "x", "y", "z", "o.n")
    sent = sent.where(" AND ".join(f"floor({c} / {TILE}) = _{c}" for c in "ijk"))
    one = {f"{c}{n}": F.max(F.when(F.col("n") == n, F.col(c))).alias(f"_{c}{n}") for n in range(8) for c in "xyz"}
    out = sent.groupBy(*tile, "i", "j", "k").agg(F.count(F.lit(1)).alias("_n"), *one.values()).where("_n = 8")
    return out.select("i", "j", "k", *[F.struct(*[F.col(f"_{c}{n}").alias(c) for c in "xyz"]).alias(f"v{n}") for n in range(8)])


def near(pillars: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """The rows of pillars or vertices(i, j, x, y, ...) in tiles of TILE x TILE cells whose box is within 2 `size` of the box around all points.

    Other rows are in no cell that locate, with this size, could find for a point. Some rows for each tile near the points are broadcast."""
    real = [F.when(F.abs(c) < math.inf, F.col(c)) for c in "xy"]
    box = points.agg(*[f(c) for c in real for f in (F.min, F.max)]).first()  # one row
    if None in tuple(box):
        return pillars.limit(0)
    tiles = pillars.select("i", "j", "x", "y")
    for c in "ij":
        tiles = tiles.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / TILE), F.floor(F.col(c) / TILE)))))
    sides = tiles.groupBy("_i", "_j").agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    kept = sides.where(reduce(Column.__and__, [(F.col(f"_low{c}") <= box[2 * n + 1] + 2 * size) & (F.col(f"_high{c}") >= box[2 * n] - 2 * size) for n, c in enumerate("xy")]))
    for c in "ij":  # a tile's last cells have vertices in the next tile, all of which stays
        kept = kept.withColumn(f"_{c}", F.explode(F.array(F.col(f"_{c}"), F.col(f"_{c}") + 1)))
    at = pillars.withColumns({f"_{c}": F.floor(F.col(c) / TILE) for c in "ij"})
    return at.join(F.broadcast(kept.select("_i", "_j").distinct()), ["_i", "_j"], "left_semi").select(*pillars.columns)


def vertex_ids(mesh: DataFrame, ni: int, nj: int) -> DataFrame:
    """Adds ids: the vertices' numbers, i fastest, then j, then k, on ni x nj vertices."""
    one = lambda o: (F.col("k") + o[2]) * (ni * nj) + (F.col("j") + o[1]) * ni + F.col("i") + o[0]
    return mesh.withColumn("ids", F.array(*[one(o).cast("bigint") for o in CORNERS]))


def centers(mesh: DataFrame) -> DataFrame:
    """Adds the means cx, cy, cz of a cell's vertices and its bounding box."""
    of = lambda c: [F.col(f"v{n}.{c}") for n in range(8)]
    out = {}
    for c in "xyz":
        out |= {f"c{c}": sum(of(c)[1:], of(c)[0]) / 8, f"min_{c}": F.least(*of(c)), f"max_{c}": F.greatest(*of(c))}
    return mesh.withColumns(out)


def _tetrahedron(a: int, b: int, c: int, d: int) -> Column:
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = [[F.col(f"v{n}.{t}") - F.col(f"v{a}.{t}") for t in "xyz"] for n in (b, c, d)]
    return F.abs(ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)) / 6


def volumes(mesh: DataFrame) -> DataFrame:
    """Adds volume: three pyramids from vertex 3 over the faces it is not on, each cut into two tetrahedra."""
    total = F.lit(0.0)
    for a, b, c, d in ((1, 2, 6, 5), (4, 5, 6, 7), (0, 1, 5, 4)):
        total = total + _tetrahedron(3, a, b, c) + _tetrahedron(3, a, c, d)
    return mesh.withColumn("volume", total)


def _side(p: list[Column], *corners: list[Column]) -> Column:
    """Six times the signed volume of p and a triangle."""
    u, v, w = [[c - x for c, x in zip(corner, p)] for corner in corners]
    return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])


def inside(p: list[Column], slack: float = 1e-12) -> Column:
    """Whether the point is in one of the tetrahedra of a cell (as in volumes): on the inner side of all of their faces.

    slack: how far outside, as a part of the tetrahedron's volume, still counts as on a face."""
    faces = [t for a, b, c, d in ((1, 2, 6, 5), (4, 5, 6, 7), (0, 1, 5, 4)) for t in ((a, b, c), (a, c, d))]
    tetrahedra = F.array(*[F.struct(*[F.col(f"v{n}").alias(x) for x, n in zip("abc", t)]) for t in faces])
    apex = [F.col(f"v3.{x}") for x in "xyz"]

    def holds(t: Column) -> Column:
        a, b, c = [[t[n][x] for x in "xyz"] for n in "abc"]
        whole = _side(apex, a, b, c)
        parts = [_side(p, a, b, c), -_side(p, apex, b, c), _side(p, apex, a, c), -_side(p, apex, a, b)]
        return reduce(Column.__and__, [x * F.signum(whole) >= -slack * F.abs(whole) for x in parts], whole != 0)

    return F.exists(tetrahedra, holds)


def locate(points: DataFrame, mesh: DataFrame, size: float, key: str = "row_id", nearest: bool = False) -> DataFrame:
    """The points(key, x, y, z) in a cell with its i, j, k and v0 to v7; the smallest (k, j, i) of several; others are dropped.

    Cells are copied to the squares of edge `size` under their boxes, which should be about a cell's width. nearest: only
    where the cell's center is also the nearest of all centers among the cells whose box is within `size` of the point's square."""
    boxes = centers(mesh)
    reach = 1 if nearest else 0
    for c in "xy":
        boxes = boxes.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.col(f"min_{c}") / size) - reach, F.floor(F.col(f"max_{c}") / size) + reach)))
    asked = points.select(key, "x", "y", "z", *[F.floor(F.col(c) / size).alias(f"_{c}") for c in "xy"])
    met = asked.join(boxes, ["_x", "_y"])
    at = [F.col(c) for c in "xyz"]
    held = reduce(Column.__and__, [F.col(c).between(F.col(f"min_{c}"), F.col(f"max_{c}")) for c in "xyz"]) & inside(at)
    cell = F.struct("k", "j", "i", *[f"v{n}" for n in range(8)])
    if nearest:
        far = sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        best = met.groupBy(key).agg(F.min_by(F.struct(held.alias("held"), cell.alias("cell")), F.struct(far, "k", "j", "i")).alias("_b")).where("_b.held").select(key, F.col("_b.cell").alias("_c"))
    else:
        best = met.where(held).groupBy(key).agg(F.min_by(cell, F.struct("k", "j", "i")).alias("_c"))
    return points.join(best.select(key, "_c.*"), key)


def _plane_distance(p: list[Column], corners: Column) -> Column:
    """Distance of p to the plane of the first three of these vertices."""
    a, b, c = [[corners[n][x] for x in "xyz"] for n in range(3)]
    u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    along = reduce(Column.__add__, [x * (q - r) for x, q, r in zip(n, p, a)])
    return F.abs(along) / F.sqrt(reduce(Column.__add__, [x * x for x in n]))


#: Faces of a cell by axis: three vertices of the lower and of the upper one (fixed values).
FACES = (((0, 3, 7), (1, 5, 6)), ((0, 4, 5), (3, 2, 6)), ((0, 1, 2), (4, 7, 6)))


def unfold(points: DataFrame, mesh: DataFrame, shape: tuple[int, int, int], size: float, key: str = "row_id", nearest: bool = False) -> DataFrame:
    """The points in a cell of the mesh of `shape` cells with u, v, w from 0 to 1: the place between opposite faces of the cell.

    A face's plane is that of its first three vertices; points outside, and of cells with flat faces, are dropped."""
    found = locate(points, mesh, size, key, nearest)
    at = [F.col(c) for c in "xyz"]
    axes = F.array(*[F.struct(F.col(axis).alias("cell"), F.lit(n).alias("n"), *[F.array(*[F.col(f"v{k}") for k in face]).alias(name) for name, face in zip(("low", "high"), faces)]) for axis, n, faces in zip("ijk", shape, FACES)])
    far = F.transform(axes, lambda t: F.struct(t["cell"].alias("cell"), t["n"].alias("n"), _plane_distance(at, t["low"]).alias("a"), _plane_distance(at, t["high"]).alias("b")))
    place = F.transform(far, lambda t: (t["cell"] + F.when(t["a"] + t["b"] > 0, t["a"] / (t["a"] + t["b"]))) / t["n"])
    out = found.withColumn("_uvw", place).where(F.forall("_uvw", lambda x: x.isNotNull() & ~F.isnan(x)))
    return out.withColumns({c: F.col("_uvw")[n] for n, c in enumerate("uvw")}).drop("_uvw", *[f"v{n}" for n in range(8)])


def unfold_lines(lines: DataFrame, mesh: DataFrame, shape: tuple[int, int, int], size: float, key: str = "row_id", nearest: bool = False) -> DataFrame:
    """lines(key, x0 to z1) of which both ends are in cells, with u0 to w1."""
    out = lines
    for n in (0, 1):
        ends = lines.select(key, *[F.col(f"{c}{n}").alias(c) for c in "xyz"])
        got = unfold(ends, mesh, shape, size, key, nearest).select(key, *[F.col(c).alias(f"{c}{n}") for c in "uvw"])
        out = out.join(got, key)
    return out


def stack_zones(zones: list[tuple[DataFrame, int]]) -> DataFrame:
    """Zones (mesh, layers) from the bottom up as one mesh: k goes on from zone to zone; adds zone."""
    out, base = None, 0
    for n, (mesh, layers) in enumerate(zones):
        one = mesh.withColumns({"k": F.col("k") + base, "zone": F.lit(n)})
        out, base = one if out is None else out.unionByName(one), base + layers
    return out


def stack_realizations(grids: list[DataFrame]) -> DataFrame:
    """Grids as one ensemble; adds real, from 1."""
    out = None
    for n, g in enumerate(grids, 1):
        out = g.withColumn("real", F.lit(n)) if out is None else out.unionByName(g.withColumn("real", F.lit(n)))
    return out


def project(grid: DataFrame, value: str, size: tuple[int, int], into: tuple[int, int]) -> DataFrame:
    """i, j, value on a grid of `into` cells with the grid of `size` cells in its middle, cut or with 0 around it."""
    di, dj = (into[0] - size[0]) // 2, (into[1] - size[1]) // 2
    moved = grid.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), value)
    target = grid.sparkSession.range(into[0] * into[1]).select((F.col("id") % into[0]).cast("int").alias("i"), F.floor(F.col("id") / into[0]).cast("int").alias("j"))
    return target.join(moved, ["i", "j"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def varmap(grid: DataFrame, value: str, hi: int, hj: int) -> DataFrame:
    """di, dj, n, gamma for all offsets up to hi, hj cells of a grid with one row a cell.

    Each cell goes once to its tile and to those it is in the halo of; a tile sums all offsets of its own cells."""
    edge = max(256, 4 * max(hi, hj))
    rows = grid.where(F.col(value).isNotNull()).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col(value).cast("double").alias("u"))
    tiles = lambda c, h: F.explode(F.sequence(F.floor((F.col(c) - h) / edge), F.floor((F.col(c) + h) / edge)))
    tiled = rows.withColumn("_ti", tiles("i", hi)).withColumn("_tj", tiles("j", hj))

    def sums(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        at = tuple(cells.column(c).to_numpy() - k.as_py() * edge + h for c, k, h in zip("ij", key, (hi, hj)))
        u, known = np.zeros((edge + 2 * hi, edge + 2 * hj)), np.zeros((edge + 2 * hi, edge + 2 * hj), bool)
        u[at], known[at] = cells.column("u").to_numpy(), True
        own, out = np.s_[hi : hi + edge, hj : hj + edge], []
        for di in range(-hi, hi + 1):
            for dj in range(-hj, hj + 1):
                there = np.s_[hi + di : hi + di + edge, hj + dj : hj + dj + edge]
                d = (u[own] - u[there])[known[own] & known[there]]
                if len(d):
                    out.append((di, dj, len(d), float((d * d / 2).sum())))
        return pa.table(list(zip(*out)) or [[]] * 4, schema=pa.schema([("di", pa.int32()), ("dj", pa.int32()), ("n", pa.int64()), ("s", pa.float64())]))

    part = tiled.groupBy("_ti", "_tj").applyInArrow(sums, "di int, dj int, n bigint, s double")
    return part.groupBy("di", "dj").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("di", "dj", "n", (F.col("s") / F.col("n")).alias("gamma"))


def singular_values(df: DataFrame, vector: str, width: int) -> DataFrame:
    """factor, value, weight of the matrix whose rows are df's vectors: from sums of outer products, width x width of them."""
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = np.array(b.column(vector).to_pylist(), float).reshape(-1, width)
            total += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["a", "b", "s"])

    whole = df.where(F.col(vector).isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda e: e.isNull())).select(vector)
    gram = np.zeros((width, width))
    for r in whole.mapInArrow(outer, "a bigint, b bigint, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():  # width * width rows
        gram[r["a"], r["b"]] = r["s"]
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0))
    share = s / s.sum() if s.sum() else s
    return df.sparkSession.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(zip(s, share))], "factor int, value double, weight double")
