"""Piecewise linear tables: draws from distributions, quantile tables, soft indicators, local distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithospark.operators.frame import cdf_table


def interpolate(df: DataFrame, column: str, knots: DataFrame, x: str, y: str, name: str, bins: int = 1000) -> DataFrame:
    """df with name: y at df's column, linear between knots with distinct x, the end values outside.

    Both sides meet in equal bins of x; the next knot after a bin comes from a table of one row a bin."""
    lo, hi = knots.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    if lo == hi:
        return df.withColumn(name, F.when(F.col(column).isNotNull(), F.lit(float(knots.agg(F.max(y)).first()[0]))))
    place = lambda c: F.least(F.floor((c - lo) / (hi - lo) * bins), F.lit(bins - 1))
    own = knots.select(F.col(x).cast("double").alias("_x0"), F.col(y).cast("double").alias("_y0")).withColumn("_bin", place(F.col("_x0")))
    firsts = own.groupBy("_bin").agg(F.min(F.struct("_x0", "_y0")).alias("_first"))
    after = firsts.select("_bin", F.lead("_first").over(Window.orderBy("_bin")).alias("_after"))  # bins rows at most
    next_ = F.coalesce(F.lead(F.struct("_x0", "_y0")).over(Window.partitionBy("_bin").orderBy("_x0")), F.col("_after"))
    own = own.join(F.broadcast(after), "_bin").withColumn("_next", next_).where("_next IS NOT NULL")
    own = own.select("_x0", "_y0", F.col("_next._x0").alias("_x1"), F.col("_next._y0").alias("_y1"), F.explode(F.sequence("_bin", place(F.col("_next._x0")))).alias("_bin"))
    rows = df.withColumn("_q", F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi)))).withColumn("_bin", place(F.col("_q"))).alias("a")
    inside = (F.col("a._bin") == F.col("b._bin")) & (F.col("_q") >= F.col("_x0")) & ((F.col("_q") < F.col("_x1")) | ((F.col("_q") == hi) & (F.col("_x1") == hi)))
    out = rows.join(own.alias("b"), inside, "left")
    value = F.col("_y0") + (F.col("_q") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    return out.select(*[F.col(f"a.{c}") for c in df.columns], value.alias(name))


def draw_value(df: DataFrame, u: str, distribution: DataFrame, name: str = "drawn") -> DataFrame:
    """df with the value at which distribution(value, p) reaches u."""
    return interpolate(df, u, distribution, "p", "value", name)


def back_transform(df: DataFrame, score: str, transform: DataFrame, name: str = "value") -> DataFrame:
    """df with the value of a normal score by transform(score, value); scores beyond the table get its end values."""
    return interpolate(df, score, transform, "score", "value", name)


def qq_table(a: DataFrame, b: DataFrame, column_a: str, column_b: str, n: int) -> DataFrame:
    """q, a, b: quantiles of both columns at (q + 0.5) / n."""
    rows = a.sparkSession.range(n).select(F.col("id").alias("q"), ((F.col("id") + 0.5) / n).alias("u"))
    rows = draw_value(rows, "u", cdf_table(a, column_a), "a")
    return draw_value(rows, "u", cdf_table(b, column_b), "b").select("q", "a", "b")


def soft_indicator(v: Column, curve: list[tuple[float, float]]) -> Column:
    """A calibration curve at v, rounded half up to 4 digits; the outer pieces go on outside the knots."""
    out = None
    for k in reversed(range(len(curve) - 1)):
        (x0, y0), (x1, y1) = curve[k], curve[k + 1]
        piece = y0 + (v - x0) * (y1 - y0) / (x1 - x0)
        out = piece if out is None else F.when(v <= x1, piece).otherwise(out)
    return F.floor(out * 1e4 + 0.5) / 1e4


def post_ik(df: DataFrame, thresholds: list[float], columns: list[str], low: float, high: float, cut: float) -> DataFrame:
    """df with mean, variance, above, mean_above of the distribution that columns (cumulative probabilities at the
    thresholds) give with uniform classes between low and high; order relations are mended by running maxima first."""
    ends = [low, *thresholds, high]
    cum, top = [F.lit(0.0)], F.lit(0.0)
    for c in columns:
        top = F.least(F.greatest(top, F.col(c)), F.lit(1.0))
        cum.append(top)
    cum.append(F.lit(1.0))
    first = second = above = above_sum = F.lit(0.0)
    for a, b, p, q in zip(ends, ends[1:], cum, cum[1:]):
        w = q - p
        first, second = first + w * ((a + b) / 2), second + w * ((a * a + a * b + b * b) / 3)
        s = min(max(cut, a), b)
        if b > s:
            part = w * ((b - s) / (b - a))
            above, above_sum = above + part, above_sum + part * ((s + b) / 2)
    out = df.withColumns({"mean": first, "_second": second, "above": above, "_sum": above_sum})
    out = out.withColumns({"variance": F.col("_second") - F.col("mean") * F.col("mean"), "mean_above": F.when(F.col("above") > 0, F.col("_sum") / F.col("above"))})
    return out.drop("_second", "_sum")


def bootstrap(df: DataFrame, seed: int) -> DataFrame:
    """As many rows as df has, drawn with replacement; row_id runs from 0 without gaps. Adds draw."""
    n = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("row_id"))
    return draws.join(df, "row_id")


def band(amplitude: DataFrame, spec_center: tuple[float, float], azimuth: float, half_width: float, value: str = "v") -> DataFrame:
    """distance, db of the cells whose direction from the center lies within half_width degrees of the azimuth, either way."""
    dx, dy = F.col("i") - spec_center[0], F.col("j") - spec_center[1]
    a = math.radians(azimuth)
    along = F.abs(dx * math.sin(a) + dy * math.cos(a))
    d = F.sqrt(dx * dx + dy * dy)
    rows = amplitude.where(F.col(value).isNotNull()).withColumns({"distance": d, "_along": along})
    return rows.where(F.col("_along") >= F.col("distance") * math.cos(math.radians(half_width))).drop("_along")
