"""Tables that keep growing: figures of event-time windows, late rows included up to a delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, time: str, value: str, window: str, delay: str, *by: str | Column) -> DataFrame:
    """start, by, min, max, mean, n of each window of a stream (or a table); a window is done once rows are later than its end by delay."""
    v = F.col(value)
    out = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("_w"), *by)
    out = out.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("n"))
    return out.withColumn("start", F.col("_w.start")).drop("_w")
