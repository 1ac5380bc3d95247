"""Drill holes as sequences: lengths, gaps, transitions between categories, entropies, proportion curves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hole() -> Window:
    return Window.partitionBy("hole").orderBy("z0", "row_id")


def distance_to_next(segments: DataFrame) -> DataFrame:
    return segments.withColumn("gap", F.coalesce(F.lead("z0").over(_hole()) - F.col("z1"), F.lit(0.0)))


def distance_along(segments: DataFrame) -> DataFrame:
    """Adds along: lengths and gaps before the interval, in its hole."""
    before = _hole().rowsBetween(Window.unboundedPreceding, -1)
    return distance_to_next(segments).withColumn("along", F.coalesce(F.sum(F.col("z1") - F.col("z0") + F.col("gap")).over(before), F.lit(0.0)))


def gap_breaks(segments: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Adds seq: a new one where neither end meets an end of the interval before."""
    p0, p1 = F.lag("z0").over(_hole()), F.lag("z1").over(_hole())
    near = F.least(F.abs(F.col("z0") - p1), F.abs(F.col("z1") - p0), F.abs(F.col("z0") - p0), F.abs(F.col("z1") - p1))
    return segments.withColumn("_new", F.when(near > tolerance, 1).otherwise(0)).withColumn("seq", F.sum("_new").over(_hole())).drop("_new")


def transition_counts(segments: DataFrame, ignore_gaps: bool = False) -> DataFrame:
    """from, to, n: upward transitions; null categories are skipped and do not break, gaps break."""
    rows = (segments.withColumn("seq", F.lit(0)) if ignore_gaps else gap_breaks(segments)).where("cat IS NOT NULL")
    after = F.lead("cat").over(Window.partitionBy("hole", "seq").orderBy("z0", "row_id"))
    return rows.withColumn("to", after).where("to IS NOT NULL").groupBy(F.col("cat").alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))


def _share(n: Column, *by: str) -> Column:
    return n / F.sum(n).over(Window.partitionBy(*by))


def full_matrix(ftm: DataFrame) -> DataFrame:
    """from, to, n of every pair of the categories in ftm, n = 0 where it has no row: as many rows as categories squared."""
    names = ftm.select(F.col("from").alias("c")).unionByName(ftm.select(F.col("to").alias("c"))).distinct()
    pairs = names.select(F.col("c").alias("from")).crossJoin(F.broadcast(names.select(F.col("c").alias("to"))))  # categories are few
    return pairs.join(ftm, ["from", "to"], "left").select("from", "to", F.coalesce("n", F.lit(0)).alias("n"))


def probabilities(ftm: DataFrame) -> DataFrame:
    return ftm.withColumns({"up": _share(F.col("n"), "from"), "down": _share(F.col("n"), "to")})


def entropies(ftm: DataFrame, categories: int) -> DataFrame:
    """cat, post, pre: entropies of the next and the previous category over log2(categories - 1).

    Probabilities are shares of the whole row (column); the transition to itself only adds no term."""
    p = probabilities(ftm)
    term = lambda c: -F.sum(F.when((F.col("from") != F.col("to")) & (F.col(c) > 0), F.col(c) * F.log2(c)).otherwise(0.0)) / math.log2(categories - 1)
    post = p.groupBy(F.col("from").alias("cat")).agg(term("up").alias("post"))
    return post.join(p.groupBy(F.col("to").alias("cat")).agg(term("down").alias("pre")), "cat", "full")


def mean_thickness(segments: DataFrame) -> DataFrame:
    return segments.where("cat IS NOT NULL").groupBy("cat").agg(F.avg(F.col("z1") - F.col("z0")).alias("thickness"))


def transition_rates(ftm: DataFrame, thickness: DataFrame) -> DataFrame:
    """-1 / L on the diagonal, else p / L with p the share of the whole row, 0 where there is no transition."""
    p = F.when(F.col("from") == F.col("to"), -1.0).otherwise(F.col("up"))
    rows = probabilities(full_matrix(ftm)).select("from", "to", p.alias("p"))
    return rows.join(thickness.withColumnRenamed("cat", "from"), "from").select("from", "to", (F.col("p") / F.col("thickness")).alias("rate"))


def expected(ftm: DataFrame) -> DataFrame:
    """Of every pair: independent trail (column sum over total - row sum), difference of p and trail, expected frequency; 0 on the diagonal."""
    row, column = F.sum("n").over(Window.partitionBy("from")), F.sum("n").over(Window.partitionBy("to"))
    total = ftm.agg(F.sum("n").alias("total"))
    out = full_matrix(ftm).withColumns({"row_sum": row, "column_sum": column}).crossJoin(F.broadcast(total))  # one row
    other = F.col("from") != F.col("to")
    out = out.withColumn("trail", F.when(other, F.try_divide(F.col("column_sum"), F.col("total") - F.col("row_sum"))).otherwise(0.0))
    out = out.withColumns({"difference": F.when(other, F.try_divide("n", "row_sum") - F.col("trail")).otherwise(0.0), "expected": F.col("trail") * F.col("row_sum")})
    return out.drop("row_sum", "column_sum", "total")


def chi_squared(ftm: DataFrame) -> DataFrame:
    """Over all pairs with an expected frequency, those that never occur too."""
    e = F.col("expected")
    return expected(ftm).agg(F.sum(F.when(e > 0, (F.col("n") - e) * (F.col("n") - e) / e)).alias("chi2"))


def independence_test(ftm: DataFrame) -> DataFrame:
    """chi2, categories, freedom (categories squared less twice their number) of transition counts, one row."""
    n = ftm.where("n > 0").select(F.explode(F.array("from", "to")).alias("cat")).agg(F.count_distinct("cat").alias("categories"))
    return chi_squared(ftm).join(F.broadcast(n)).withColumn("freedom", F.col("categories") * F.col("categories") - 2 * F.col("categories"))  # one row each


def matrix_rank(ftm: DataFrame, tolerance: float = 1e-9) -> int:
    """Rank of the matrix of counts: its singular values above tolerance times the largest; categories squared numbers reach the driver."""
    rows = ftm.groupBy("from", "to").agg(F.sum("n").alias("n")).collect()
    names = sorted({r[c] for r in rows for c in ("from", "to")})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names.index(r["from"]), names.index(r["to"])] = r["n"]
    s = np.linalg.svd(m, compute_uv=False) if names else np.zeros(1)
    return int((s > tolerance * max(s[0], 1e-300)).sum())


def stations(segments: DataFrame, steps: list[float]) -> DataFrame:
    """h, hole, s, cat: for each h of steps the category every h along each hole; the first interval that holds the station."""
    rows = distance_along(segments).withColumn("end", F.col("along") + F.col("z1") - F.col("z0")).withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in steps])))
    low = F.ceil(F.col("along") / F.col("h"))
    rows = rows.withColumn("s", F.explode(F.sequence(low, F.greatest(low, F.floor(F.col("end") / F.col("h"))))))
    inside = rows.where((F.col("s") * F.col("h") >= F.col("along")) & (F.col("s") * F.col("h") <= F.col("end")))
    return inside.groupBy("h", "hole", "s").agg(F.min_by("cat", F.struct("along", "row_id")).alias("cat"))


def transition_counts_at(segments: DataFrame, *steps: float) -> DataFrame:
    """h, from, to, n between stations h apart."""
    after = F.lead("cat").over(Window.partitionBy("h", "hole").orderBy("s"))
    return stations(segments, list(steps)).where("cat IS NOT NULL").withColumn("to", after).where("to IS NOT NULL").groupBy("h", F.col("cat").alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))


def transiogram(segments: DataFrame, steps: list[float]) -> DataFrame:
    """h, from, to, n, up for all steps in one pass over the holes, and sill: the category's share of all transitions' ends."""
    counts = transition_counts_at(segments, *steps)
    ends = counts.groupBy("to").agg(F.sum("n").alias("ends"))
    sill = ends.crossJoin(F.broadcast(ends.agg(F.sum("ends").alias("all")))).select("to", (F.col("ends") / F.col("all")).alias("sill"))  # one row
    return counts.withColumn("up", _share(F.col("n"), "h", "from")).join(sill, "to").select("h", "from", "to", "n", "up", "sill")


def vpc(segments: DataFrame, base: float, top: float, steps: int, window: float) -> DataFrame:
    """depth index, cat, p: length-weighted proportions in windows of that height around steps + 1 depths, clipped to [base, top]."""
    step = (top - base) / steps
    lo, hi = F.ceil((F.col("z0") - base - window / 2) / step), F.floor((F.col("z1") - base + window / 2) / step)
    rows = segments.where(F.col("cat").isNotNull() & (F.col("z1") >= base - window) & (F.col("z0") <= top + window)).withColumns({"lo": F.greatest(lo, F.lit(0)), "hi": F.least(hi, F.lit(steps))})
    rows = rows.where("lo <= hi").withColumn("d", F.explode(F.sequence("lo", "hi")))
    z = F.lit(base) + F.col("d") * step
    length = F.least("z1", z + window / 2, F.lit(top)) - F.greatest("z0", z - window / 2, F.lit(base))
    sums = rows.withColumn("len", length).where("len > 0").groupBy("d", "cat").agg(F.sum("len").alias("len"))
    return cumulative_proportions(sums.withColumn("p", _share(F.col("len"), "d")))


def proportion_by_length(segments: DataFrame) -> DataFrame:
    rows = segments.where("cat IS NOT NULL").groupBy("cat").agg(F.sum(F.col("z1") - F.col("z0")).alias("len"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("len").alias("all")))).select("cat", (F.col("len") / F.col("all")).alias("p"))  # one row


def to_points(segments: DataFrame, step: float) -> DataFrame:
    """Points at 0, step, 2 step ... up to the length of each interval."""
    n = F.floor((F.col("z1") - F.col("z0")) / step)
    return segments.select("row_id", "hole", "z0", F.explode(F.sequence(F.lit(0), n)).alias("n")).select("row_id", "hole", "n", (F.col("z0") + F.col("n") * step).alias("z"))


def in_z_interval(segments: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Pairs of segments and intervals(interval, low, high) that meet, ends included; both are dealt to slices of that width.

    A pair comes from one slice only, the first that both have."""
    def sliced(df: DataFrame, low: str, high: str, first: str) -> DataFrame:
        df = df.withColumn(first, F.floor(F.col(low) / width))
        return df.withColumn("_slice", F.explode(F.sequence(first, F.floor(F.col(high) / width))))

    pairs = sliced(segments, "z0", "z1", "_a").join(sliced(intervals, "low", "high", "_b"), "_slice")
    met = pairs.where((F.col("z0") <= F.col("high")) & (F.col("z1") >= F.col("low")) & (F.col("_slice") == F.greatest("_a", "_b")))
    return met.drop("_slice", "_a", "_b")


def sums_in_z_interval(segments: DataFrame, intervals: DataFrame, width: float, key: str = "row_id") -> DataFrame:
    """key, n, intervals: how many of in_z_interval's pairs a segment has, and the sum of their intervals; none for segments without one.

    Equal intervals meet a segment once, with their number and sum, so pairs grow with the different intervals only."""
    kinds = intervals.groupBy("low", "high").agg(F.count(F.lit(1)).alias("_n"), F.sum("interval").alias("_s"))
    return in_z_interval(segments, kinds, width).groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_s").alias("intervals"))


def cumulative_proportions(curve: DataFrame) -> DataFrame:
    """curve(d, cat, p) with cum, the sum of p up to each category of a depth."""
    return curve.withColumn("cum", F.sum("p").over(Window.partitionBy("d").orderBy("cat")))


def sum_counts(matrices: list[DataFrame]) -> DataFrame:
    """Transition counts of several files or sets of holes, added up."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy("from", "to").agg(F.sum("n").alias("n"))


def drop_empty(matrices: DataFrame) -> DataFrame:
    """matrices(h, from, to, n) less the rows (from) and the columns (to) that have no transition in any h."""
    seen = matrices.where("n > 0")
    return matrices.join(seen.select("from").distinct(), "from", "left_semi").join(seen.select("to").distinct(), "to", "left_semi").select(*matrices.columns)


def inexistent_transitions(reference: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """from, to, up: transitions that reference never has and asked has with a probability above the threshold."""
    return probabilities(asked).where(F.col("up") > threshold).join(reference.where("n > 0"), ["from", "to"], "left_anti").select("from", "to", "up")


def is_embedded(ftm: DataFrame) -> DataFrame:
    """One row: are there no transitions from a category to itself?"""
    return ftm.agg(F.coalesce(F.sum(F.when(F.col("from") == F.col("to"), F.col("n"))), F.lit(0)).alias("n_self")).select((F.col("n_self") == 0).alias("embedded"))


def next_category(ftm: DataFrame, draws: DataFrame) -> DataFrame:
    """draws(cat, u, ...) with next: the first category whose cumulative upward probability from cat reaches u.

    The matrix has a row for each category; a category's row is one array."""
    up = F.sum("n").over(Window.partitionBy("from").orderBy("to")) / F.sum("n").over(Window.partitionBy("from"))
    rows = ftm.withColumn("_cum", up).groupBy(F.col("from").alias("cat")).agg(F.sort_array(F.collect_list(F.struct("_cum", "to"))).alias("_row"))
    hit = F.get(F.filter("_row", lambda s: s["_cum"] >= F.col("u")), F.lit(0))["to"]
    return draws.join(rows, "cat", "left").withColumn("next", hit).drop("_row")


def relationship_edges(ftm: DataFrame, cutoff: float) -> DataFrame:
    """from, to, difference: transitions that are more frequent than in independent trails by more than cutoff."""
    return expected(ftm).where(F.col("difference") > cutoff).select("from", "to", "difference")


def _axes(segments: DataFrame) -> list[str]:
    """The axes along which intervals have two ends; z always."""
    return [c for c in "xyz" if {f"{c}0", f"{c}1"} <= set(segments.columns)]


def hole_ends(segments: DataFrame) -> DataFrame:
    """hole, head, tail: where the first and the last interval of a hole begin and end; with x and y too, head_x to tail_z."""
    order, axes = F.struct("z0", "row_id"), _axes(segments)
    if axes == ["z"]:
        return segments.groupBy("hole").agg(F.min_by("z0", order).alias("head"), F.max_by("z1", order).alias("tail"))
    return segments.groupBy("hole").agg(*[F.min_by(f"{c}0", F.col("row_id")).alias(f"head_{c}") for c in axes], *[F.max_by(f"{c}1", F.col("row_id")).alias(f"tail_{c}") for c in axes])


def segment_measures(segments: DataFrame) -> DataFrame:
    """Adds length, height and the mid-point: mid along z, and mid_x and mid_y where intervals have ends in x and y.

    Intervals with ends in z alone are vertical."""
    axes = _axes(segments)
    squares = [(F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in axes]
    height = F.abs(F.col("z1") - F.col("z0"))
    length = F.sqrt(sum(squares[1:], squares[0])) if len(axes) > 1 else height
    middle = {"mid" if c == "z" else f"mid_{c}": (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in axes}
    return segments.withColumns({"length": length, "height": height, **middle})


def to_midpoints(segments: DataFrame) -> DataFrame:
    """One point for each interval: its mid-point, with the interval's length as its weight."""
    axes = _axes(segments)
    names = {"mid" if c == "z" else f"mid_{c}": c for c in axes}
    return segment_measures(segments).drop("height", *[f"{c}{n}" for c in axes for n in (0, 1)]).withColumnsRenamed({**names, "length": "weight"})


def vpc_mean(curves: DataFrame) -> DataFrame:
    """d, cat, p: mean of curves(curve, d, cat, p) with equal depths, scaled to sum 1 at each depth."""
    sums = curves.groupBy("d", "cat").agg(F.sum("p").alias("p"))
    return sums.withColumn("p", _share(F.col("p"), "d"))


def _dense(curve: DataFrame, steps: int) -> DataFrame:
    """Each category of curve(d, cat, p) at all depths 0 to steps, 0 where it has no entry, with the next depth's p as q."""
    full = curve.select("cat").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(steps)).cast("array<bigint>")))
    full = full.join(curve.select("d", "cat", "p"), ["d", "cat"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return full.withColumn("q", F.lead("p").over(Window.partitionBy("cat").orderBy("d"))).where("q IS NOT NULL")


def vpc_at(curve: DataFrame, depths: DataFrame, steps: int) -> DataFrame:
    """depths(depth, ...) with cat, p: linear between the curve's entries; no rows for depths outside 0 to 1."""
    rows = depths.where(F.col("depth").between(0, 1)).withColumn("d", F.least(F.floor(F.col("depth") * steps), F.lit(steps - 1)))
    at = F.col("depth") * steps - F.col("d")
    return rows.join(_dense(curve, steps), "d").withColumn("p", F.col("p") + at * (F.col("q") - F.col("p"))).drop("d", "q")


def fill_with_proportions(grid: DataFrame, curve: DataFrame, steps: int, k0: int, k1: int) -> DataFrame:
    """grid cells of layers k0 to k1, a row for each cat, with the curve's p at the layer's center."""
    layers = grid.sparkSession.range(k0, k1 + 1).withColumnRenamed("id", "k").withColumn("depth", (F.col("k") - k0 + 0.5) / (k1 - k0 + 1))
    return grid.where(F.col("k").between(k0, k1)).join(vpc_at(curve, layers, steps).drop("depth"), "k")
