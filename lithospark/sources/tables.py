"""Points, drill holes, grids and ensembles derived from the given tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Hours between two events of a user after which nothing is known.
GAP = 24.0
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(column: str, names: tuple[str, ...]) -> Column:
    """1-based place of a name in a list, null if it is none of them."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return F.when(place > 0, place.cast("int"))


def _xyz(k: Column) -> list[Column]:
    m, n = k % 1009, k % 997  # of remainders: cubes of large keys overflow
    x = (m * m * 31 + m * 7919) % 1009
    y = (n * n * n * 17 + n * 104729) % 997
    return [x.cast("double").alias("x"), y.cast("double").alias("y"), (k % 50).cast("double").alias("z")]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, x, y, z, v, dom of the customers."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), *_xyz(F.col("c_custkey")), F.col("c_acctbal").alias("v"), code_of("c_mktsegment", SEGMENTS).alias("dom"))


def few_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), *_xyz(F.col("s_suppkey")), F.col("s_acctbal").alias("v"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 40).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("p_retailprice").alias("v"))


def segments(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """row_id, hole, z0, z1, cat, grade: intervals between events of a user; cat null at each 17th; with gaps nothing was logged in intervals of over GAP hours."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200) / 3600
    by = Window.partitionBy("hole").orderBy("z0")
    out = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("hole"), hours.alias("z0"), code_of("event_type", EVENT_TYPES).alias("cat"), F.col("value").alias("grade"))
    out = out.withColumn("z1", F.lead("z0").over(by)).where("z1 IS NOT NULL").withColumn("cat", F.when(F.col("row_id") % 17 != 0, F.col("cat")))
    return out.where(F.col("z1") - F.col("z0") <= GAP) if gaps else out


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, i, j, v, cat on a grid of 100 columns; v is null at each seventh cell."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("cell"), (k % 100).cast("int").alias("i"), F.floor(k / 100).cast("int").alias("j"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("v"), F.col("o_orderpriority").alias("cat"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """real, cell, v: mean price by line number (realization) and order (cell)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("real"), F.col("l_orderkey").alias("cell")).agg(F.avg("l_extendedprice").alias("v"))
