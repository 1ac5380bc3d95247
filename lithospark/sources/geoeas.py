"""Text tables with a header (comment, column count, names) and ASCII grids; a lost value becomes null.

The no-data value is a number; values equal to it are null inside, and are written back as that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithospark.spec import GridSpec


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """row, line of text files, rows numbered from 0 in file order: places in a split plus the rows of the splits before."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    splits = lines.groupBy("_f", "_s").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1))  # one row a split
    splits = splits.select("_f", "_s", "_first", F.coalesce(before, F.lit(0)).alias("_base"))
    return lines.join(F.broadcast(splits), ["_f", "_s"]).select((F.col("_m") - F.col("_first") + F.col("_base")).alias("row"), "line")


def read_geoeas(spark: SparkSession, path: str, ndv: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, rejects): row_id and a double column for each name; rows with another number of tokens are rejects."""
    rows = _numbered(spark, path)
    head = {r["row"]: r["line"] for r in rows.where(F.col("row") < 2).collect()}
    n = int(head[1].split()[0])
    names = [r["line"].strip() for r in rows.where((F.col("row") >= 2) & (F.col("row") < 2 + n)).orderBy("row").collect()]
    tokens = F.regexp_extract_all("line", F.lit(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"), 1)
    body = rows.where((F.col("row") >= 2 + n) & (F.trim("line") != "")).withColumn("tokens", tokens)
    good = body.where(F.size("tokens") == n)
    values = [F.expr(f"try_cast(tokens[{i}] AS double)") for i in range(n)]
    values = [(v if ndv is None else F.when(v != ndv, v)).alias(c) for v, c in zip(values, names)]
    return good.select((F.col("row") - 2 - n).alias("row_id"), *values), body.where(F.size("tokens") != n).select("row", "line")


def number_text(c: F.Column) -> F.Column:
    """A number with 12 significant digits, without zeros at the end."""
    x = F.regexp_replace(F.format_string("%.12g", c), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(x, r"\.(e|$)", "$1")


def write_geoeas(df: DataFrame, path: str, order: str = "row_id", ndv: float = -999.0, comment: str = "table") -> None:
    """One sorted set of part files; the header is the first lines of the first part."""
    names = [c for c in df.columns if c != order]
    line = F.concat_ws(" ", *[number_text(F.coalesce(F.col(c).cast("double"), F.lit(ndv))) for c in names])
    body = df.select(F.col(order).cast("double").alias("_o"), line.alias("value"))
    header = [comment, str(len(names)), *names]
    first = df.sparkSession.createDataFrame([(float("-inf"), "\n".join(header))], "_o double, value string")
    first.unionByName(body).repartitionByRange("_o").sortWithinPartitions("_o").select("value").write.text(path)


def read_grid(spark: SparkSession, path: str, spec: GridSpec, ndv: float | None = None, realizations: list[int] | None = None) -> DataFrame:
    """real, i, j, k and the values: realizations are stacked blocks of rows, numbered from 0; all of them or those asked for."""
    table, _ = read_geoeas(spark, path, ndv)
    if realizations is not None:
        block = F.floor(F.col("row_id") / spec.cells)
        table = table.where(block.isin(realizations))
    return index_rows(table, spec)


def index_rows(table: DataFrame, spec: GridSpec) -> DataFrame:
    r = F.col("row_id") % spec.cells
    place = {"real": F.floor(F.col("row_id") / spec.cells), "i": r % spec.nx, "j": F.floor(r / spec.nx) % spec.ny, "k": F.floor(r / (spec.nx * spec.ny))}
    return table.withColumns({k: v.cast("int") for k, v in place.items()})


def grd_rows(df: DataFrame, spec: GridSpec) -> DataFrame:
    """j and the line of an ASCII DSAA grid for it, bottom row first."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: number_text(s["v"]))
    return df.groupBy("j").agg(F.array_join(cells, " ").alias("line")).orderBy("j")


def matrix_to_long(df: DataFrame, row: str = "from") -> DataFrame:
    names = [c for c in df.columns if c != row]
    return df.unpivot(row, names, "to", "n")


def long_to_matrix(df: DataFrame, categories: list, row: str = "from") -> DataFrame:
    return df.groupBy(row).pivot("to", categories).agg(F.sum("n")).na.fill(0)


def range_bucket(df: DataFrame, order: list[str], rows: int = 20) -> F.Column:
    """Number of the range that holds a row, in the order of these columns; about as many ranges as there are shuffle partitions.

    The bounds are literals, found from the rows of the lowest hashes (`rows` a range), so that every job and
    every attempt puts a row into the same range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, h = df.select(*order), F.xxhash64(*order)
    different = keys.agg(F.approx_count_distinct(h)).first()[0]
    if different > 4 * rows * n:  # hashes above a bound go before anything is sent
        keys = keys.where(h < int(-(1 << 63) + 2 * rows * n / different * (1 << 64)))
    sample = keys.distinct().orderBy(h, *order).limit(rows * n).orderBy(*order).collect()  # rows * n at most
    bounds = [F.struct(*[F.lit(r[c]).cast(df.schema[c].dataType).alias(c) for c in order]) for r in sample[rows::rows]]
    if not bounds:
        return F.lit(0)
    table, key = F.array(*bounds), F.struct(*order)
    # bounds at most the key, by halving: lo of them are, from the hi-th on none is
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: F.Column, _: F.Column) -> F.Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = (s["lo"] < s["hi"]) & (F.element_at(table, F.least(mid + 1, F.lit(len(bounds)))) <= key)
        return F.struct(F.when(under, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(F.when(s["lo"] < s["hi"], mid).otherwise(s["hi"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve)["lo"]


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers from 0 by a unique order, without one task for all: numbers in ranges plus the counts before."""
    local = df.withColumn("_p", range_bucket(df, order)).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    counts = sorted((r["_p"], r["count"]) for r in local.groupBy("_p").count().collect())  # one row a range
    base, total = [], 0
    for p, n in counts:
        base += [F.lit(p), F.lit(total).cast("bigint")]
        total += n
    return local.withColumn("row_id", F.col("_r") + F.create_map(*base)[F.col("_p")] if base else F.lit(0).cast("bigint")).drop("_p", "_r")
