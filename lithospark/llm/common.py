"""Helpers the corpus operators share: tables, intermediate results, sorted groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set in local mode (tests), one is made for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lithospark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends at files all executors see."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by keep() that no pending plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key() -> Column:
    """Tells apart rows that share a doc_id; equal rows share it and so share their result."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as remainder 0 of everything."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys: tables of whole groups, with the row at which each group starts and the row count."""
    held: list[pa.RecordBatch] = []
    count = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, s[-1]), s
            held, count = t.slice(s[-1]).to_batches(), t.num_rows - int(s[-1])
    if count:
        t = pa.Table.from_batches(held)
        yield t, np.append(starts(t), t.num_rows)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(edges: DataFrame, tag: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges(src, dst), root the smallest node of its component.

    Alternating large-star and small-star steps; each round's edges become a table in the shared
    folder, so a lost executor costs one round at most. Stops when a round changes nothing; an error if none of
    most_rounds is that one."""
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    e = keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), tag)
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        near = both(e)
        low = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = near.join(low.hint("merge"), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low.hint("merge"), "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small = small.unionByName(low.select("src", F.col("low").alias("dst")))
        after = keep(small.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), tag)
        discard(e)
        e = after
    else:
        raise RuntimeError(f"components of {tag} still change after {most_rounds} rounds")
    return e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root")).unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def bounded_sample(df: DataFrame, rows: int, order: list[Column]) -> DataFrame:
    """The first `rows` rows of df in that order, whose first column is a 64-bit hash.

    Hashes above a bound under which 2 * rows + 200 rows are expected go before the sort, so all tasks
    together send on about that many, however many tasks and rows there are."""
    n, some = df.count(), 2 * rows + 200
    if n > 2 * some:
        df = df.where(order[0] < int(-(1 << 63) + some / n * (1 << 64)))
    return df.orderBy(*order).limit(rows)


#: Most rows of 64 bits that likely() broadcasts.
BITMAP_ROWS = 1 << 18


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(11)), F.lit(64 * BITMAP_ROWS))


def _bitmap(wanted: DataFrame, key: str) -> DataFrame:
    bits = wanted.select(_bit(key).alias("_at")).select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, int(_at % 64))").alias("_bits"))
    return keep(bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).coalesce(1), "bitmap")


def split_likely(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key (64 bits) may be among those of wanted, and the rows whose key is not for sure.

    A join with wanted then shuffles few other rows. A bitmap of the keys' hashes is broadcast: at most
    BITMAP_ROWS numbers, however many keys there are; where they fill it, more rows may be met, never fewer."""
    met = df.withColumn("_at", _bit(key)).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(_bitmap(wanted, key)), "_word", "left")
    hit = F.coalesce(F.expr("shiftright(_bits, int(_at % 64)) & 1 = 1"), F.lit(False))
    return met.where(hit).select(*df.columns), met.where(~hit).select(*df.columns)


def low_bits(wanted: DataFrame, key: str) -> np.ndarray:
    """Such a bitmap for tasks in Python, by the low bits of keys that are hashes themselves: 64 * BITMAP_ROWS flags as bytes, packed."""
    bit = F.pmod(F.col(key), F.lit(64 * BITMAP_ROWS))
    rows = wanted.select(F.shiftright(bit, 3).alias("byte"), F.expr(f"shiftleft(1, int(pmod({key}, 8)))").alias("bits")).groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()  # 8 * BITMAP_ROWS rows at most
    out = np.zeros(8 * BITMAP_ROWS, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return out


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    return split_likely(df, key, wanted)[0]


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
