"""Lines through surfaces: where drill holes cross horizons, and proportion curves between two horizons.

A surface has a z for each cell of a grid. Its vertices are the centers of the cells, and each square of four
neighboring centers is two triangles along the diagonal from (i, j) to (i + 1, j + 1); a square with a lost z has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithospark.spec import GridSpec

#: Two crossings of a line nearer than this part of its length are one: neighboring triangles share their edge.
SAME = 1e-9
ENDS = ("x0", "y0", "z0", "x1", "y1", "z1")


#: Squares of a tile's edge.
TILE = 128


def squares(surface: DataFrame) -> DataFrame:
    """a, b, z00, z10, z01, z11 of the squares of four centers, from surface(i, j, z).

    A vertex is sent once, and at borders also to the tiles before; its at most four squares are made there."""
    tiles = surface.where("z IS NOT NULL").select("i", "j", "z")
    for c in "ij":
        tiles = tiles.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / TILE), F.floor(F.col(c) / TILE)))))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    sent = tiles.repartition("_i", "_j").withColumn("o", F.explode(corners))
    sent = sent.select("_i", "_j", (F.col("i") - F.col("o.a")).alias("a"), (F.col("j") - F.col("o.b")).alias("b"), "o", "z").where(f"floor(a / {TILE}) = _i AND floor(b / {TILE}) = _j")
    at = lambda a, b: F.max(F.when((F.col("o.a") == a) & (F.col("o.b") == b), F.col("z"))).alias(f"z{a}{b}")
    out = sent.groupBy("_i", "_j", "a", "b").agg(at(0, 0), at(1, 0), at(0, 1), at(1, 1), F.count(F.lit(1)).alias("_n"))
    return out.where("_n = 4").drop("_n", "_i", "_j")


def crossed_squares(lines: DataFrame, spec: GridSpec) -> DataFrame:
    """lines, a row for each square below or above them: a, b, and the ends u0, v0, u1, v1 in units of cells from the first center.

    A line is cut at the squares' columns, and each piece covers the rows between its ends: as many rows as squares crossed."""
    place = {"u0": (F.col("x0") - spec.x0) / spec.dx - 0.5, "v0": (F.col("y0") - spec.y0) / spec.dy - 0.5, "u1": (F.col("x1") - spec.x0) / spec.dx - 0.5, "v1": (F.col("y1") - spec.y0) / spec.dy - 0.5}
    known = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in ENDS])
    rows = lines.withColumns(place).where(known)
    clip = lambda c, most: F.greatest(F.lit(0), F.least(c, F.lit(most)))
    first, last = F.floor(F.least("u0", "u1") - 1e-9), F.floor(F.greatest("u0", "u1") + 1e-9)
    rows = rows.where((last >= 0) & (first <= spec.nx - 1)).withColumn("a", F.explode(F.sequence(clip(first, spec.nx - 2), clip(last, spec.nx - 2))))
    du = F.col("u1") - F.col("u0")
    part = lambda u: F.when(du == 0, F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (u - F.col("u0")) / du)))
    v = lambda t: F.col("v0") + t * (F.col("v1") - F.col("v0"))
    p, q = v(F.coalesce(part(F.col("a")), F.lit(0.0))), v(F.coalesce(part(F.col("a") + 1), F.lit(1.0)))
    low, high = F.floor(F.least(p, q) - 1e-6), F.floor(F.greatest(p, q) + 1e-6)
    rows = rows.withColumns({"_low": low, "_high": high}).where((F.col("_high") >= 0) & (F.col("_low") <= spec.ny - 1))
    return rows.withColumn("b", F.explode(F.sequence(clip(F.col("_low"), spec.ny - 2), clip(F.col("_high"), spec.ny - 2)))).drop("_low", "_high")


def _plane(lower: bool, u: Column, v: Column) -> Column:
    z00, z10, z01, z11 = (F.col(f"z{a}{b}") for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)))
    return z00 + u * (z10 - z00) + v * (z11 - z10) if lower else z00 + v * (z01 - z00) + u * (z11 - z01)


def intersect_horizon(lines: DataFrame, surface: DataFrame, spec: GridSpec, key: list[str]) -> DataFrame:
    """key, t, x, y, z: where the lines (key, x0, y0, z0, x1, y1, z1; key unique) cross the surface(i, j, z).

    t is the place along the line, 0 to 1. A line in the plane of a triangle doesn't cross it; one along an edge, or
    through a vertex, crosses once. Lines with a lost end cross nothing."""
    if spec.nx < 2 or spec.ny < 2:
        return lines.select(*key, F.lit(0.0).alias("t"), *[F.lit(0.0).alias(c) for c in "xyz"]).where(F.lit(False))
    met = crossed_squares(lines.select(*key, *ENDS), spec).join(squares(surface), ["a", "b"])
    # step by step, so that each number is worked out once a row
    met = met.withColumns({f"_{c}": F.col(c) - F.col(s) for c, s in (("u0", "a"), ("v0", "b"), ("u1", "a"), ("v1", "b"))})
    sides = ((0, True), (1, False))
    met = met.withColumns({f"_f{n}{end}": F.col(f"z{end}") - _plane(lower, F.col(f"_u{end}"), F.col(f"_v{end}")) for n, lower in sides for end in (0, 1)})
    met = met.withColumns({f"_t{n}": F.when(F.col(f"_f{n}0") != F.col(f"_f{n}1"), F.col(f"_f{n}0") / (F.col(f"_f{n}0") - F.col(f"_f{n}1"))) for n, _ in sides})
    met = met.where("_t0 BETWEEN 0 AND 1 OR _t1 BETWEEN 0 AND 1")
    met = met.withColumns({f"_{c}{n}t": F.col(f"_{c}0") + F.col(f"_t{n}") * (F.col(f"_{c}1") - F.col(f"_{c}0")) for n, _ in sides for c in "uv"})
    tests = []
    for n, lower in sides:
        t, u, v = F.col(f"_t{n}"), F.col(f"_u{n}t"), F.col(f"_v{n}t")
        inside = (F.least(u, v) >= -SAME) & (F.greatest(u, v) <= 1 + SAME) & ((u - v >= -SAME) if lower else (v - u >= -SAME))
        tests.append(F.when(inside & (t >= 0) & (t <= 1), t))
    hits = met.select(*key, *ENDS, F.explode(F.array(*tests)).alias("t")).where("t IS NOT NULL")
    before = F.lag("t").over(Window.partitionBy(*key).orderBy("t"))
    hits = hits.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("t") - F.col("_before") > SAME))
    return hits.select(*key, "t", *[(F.col(f"{c}0") + F.col("t") * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in "xyz"])


def connect_gaps(segments: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """hole, seq, gap and the ends: the segments, and a line over each gap from the tail of one to the head of the next of its hole."""
    by = Window.partitionBy("hole").orderBy("seq")
    rows = segments.select("hole", "seq", *ENDS, *[F.lag(f"{c}1").over(by).alias(f"_{c}") for c in "xyz"])
    length = F.sqrt(sum(((F.col(f"{c}0") - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    piece = F.struct(F.lit(False).alias("gap"), *ENDS)
    over = F.struct(F.lit(True).alias("gap"), *[F.col(f"_{c}").alias(f"{c}0") for c in "xyz"], *[F.col(f"{c}0").alias(f"{c}1") for c in "xyz"])
    return rows.select("hole", "seq", F.explode(F.array(piece, F.when(length > tolerance, over))).alias("_p")).where("_p IS NOT NULL").select("hole", "seq", "_p.*")


def hole_crossings(segments: DataFrame, surface: DataFrame, spec: GridSpec) -> DataFrame:
    """hole, seq, gap, t, x, y, z: crossings of segments(hole, seq, ends), gaps between them included.

    A crossing at the end that two pieces share is one of the earlier piece."""
    hits = intersect_horizon(connect_gaps(segments), surface, spec, ["hole", "seq", "gap"])
    by = Window.partitionBy("hole").orderBy("seq", F.desc("gap"), "t")
    far = F.sqrt(sum(((F.col(c) - F.lag(c).over(by)) ** 2 for c in "xyz"), F.lit(0.0)))
    return hits.withColumn("_far", far).where(F.col("_far").isNull() | (F.col("_far") > SAME)).drop("_far")


def horizon_bounds(segments: DataFrame, top: DataFrame, base: DataFrame, spec: GridSpec) -> DataFrame:
    """hole, base, top of each hole that takes part: where it crosses the horizons, else its highest or lowest depth.

    Not those that cross one more than once, whose base is above the top, or that cross neither and have both ends over
    the top horizon's cells or under the base horizon's."""
    def crossing(surface: DataFrame, name: str) -> DataFrame:
        return hole_crossings(segments, surface, spec).groupBy("hole").agg(F.count(F.lit(1)).alias(f"_n_{name}"), F.max("z").alias(f"_z_{name}"))

    ends = segments.groupBy("hole").agg(
        F.max(F.greatest("z0", "z1")).alias("_high"), F.min(F.least("z0", "z1")).alias("_low"),
        F.min_by(F.struct("x0", "y0", "z0"), "seq").alias("_head"), F.max_by(F.struct("x1", "y1", "z1"), "seq").alias("_tail"),
    )
    out = ends.join(crossing(top, "top"), "hole", "left").join(crossing(base, "base"), "hole", "left").na.fill(0, ["_n_top", "_n_base"]).where("_n_top <= 1 AND _n_base <= 1")
    out = out.withColumns({"top": F.coalesce("_z_top", "_high"), "base": F.coalesce("_z_base", "_low")}).where("base <= top")
    for end, n in (("_head", 0), ("_tail", 1)):
        i, j = F.floor((F.col(f"{end}.x{n}") - spec.x0) / spec.dx), F.floor((F.col(f"{end}.y{n}") - spec.y0) / spec.dy)
        out = out.withColumns({"_i": i, "_j": j})
        for surface, name in ((top, "top"), (base, "base")):
            at = surface.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("z").alias(f"{end}_{name}"))
            out = out.join(at, ["_i", "_j"], "left")
        out = out.drop("_i", "_j")
    above = (F.col("_head.z0") > F.col("_head_top")) & (F.col("_tail.z1") > F.col("_tail_top"))
    under = (F.col("_head.z0") < F.col("_head_base")) & (F.col("_tail.z1") < F.col("_tail_base"))
    outside = (F.col("_n_top") == 0) & (F.col("_n_base") == 0) & F.coalesce(above | under, F.lit(False))
    return out.where(~outside).select("hole", "base", "top")


def vpc_between(segments: DataFrame, bounds: DataFrame, steps: int, window: float, fallback: DataFrame | None = None) -> DataFrame:
    """curve (the hole), d, cat, p: proportions by length in windows around steps + 1 depths from a hole's base to its top.

    window is a part of the distance of base and top, and is cut off at both; segments(hole, z0, z1, cat) in any
    direction. Depths in whose window nothing is known have the proportions fallback(cat, p), or no rows."""
    rows = segments.where("cat IS NOT NULL").select("hole", F.least("z0", "z1").alias("_lo"), F.greatest("z0", "z1").alias("_hi"), "cat").join(bounds.where("top > base"), "hole")
    part = lambda c: (F.col(c) - F.col("base")) / (F.col("top") - F.col("base"))
    rows = rows.withColumns({"_lo": part("_lo"), "_hi": part("_hi")})
    first, last = F.ceil((F.col("_lo") - window / 2) * steps), F.floor((F.col("_hi") + window / 2) * steps)
    rows = rows.withColumns({"_a": F.greatest(first, F.lit(0)), "_b": F.least(last, F.lit(steps))}).where("_a <= _b").withColumn("d", F.explode(F.sequence("_a", "_b")))
    z = F.col("d") / steps
    length = F.least(F.col("_hi"), z + window / 2, F.lit(1.0)) - F.greatest(F.col("_lo"), z - window / 2, F.lit(0.0))
    sums = rows.withColumn("len", length).where("len > 1e-12").groupBy(F.col("hole").alias("curve"), "d", "cat").agg(F.sum("len").alias("len"))
    out = sums.withColumn("p", F.col("len") / F.sum("len").over(Window.partitionBy("curve", "d"))).select("curve", "d", "cat", "p")
    if fallback is not None:
        depths = bounds.where("top > base").select(F.col("hole").alias("curve"), F.explode(F.sequence(F.lit(0), F.lit(steps)).cast("array<bigint>")).alias("d"))
        lost = depths.join(out.select("curve", "d").distinct(), ["curve", "d"], "left_anti")
        kinds = fallback.agg(F.collect_list(F.struct("cat", "p")).alias("_f"))  # one row: a code list
        out = out.unionByName(lost.join(F.broadcast(kinds)).select("curve", "d", F.explode("_f").alias("_f")).select("curve", "d", "_f.cat", "_f.p"))
    return out
