"""Quality rules: figures of each text, and lines that many documents of a host share.

Cross-document line frequency: normalised lines (lower case, white space collapsed) are hashed once per
document; for each host the documents with a line are counted, copies of a text under other ids too.
Lines in more documents than the limit are removed, and documents with too little left are
rejected. The limit is the same for every host and size of input.

Counts are made per host and line with map-side sums, so a host or a line with a third of all rows is
no single task. Nulls: a null text has no words and fails the base rules; a null host is a host of its
own. Repeated rows count as one document and get the same verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import keep, table, text_key

_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_FIGURES = [c.split()[0] for c in _BASE.split(", ")]
_SYMBOLS = "#*$%&|<>"


def figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in "\x20\x09\x0a\x0b\x0c\x0d")
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= twice
            repeated = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Signed 64-bit hash and number of words of each normalised line with a word."""
    hashes, sizes = [], []
    for line in text.lower().encode().split(b"\n"):
        if words := line.split():
            h = xxhash.xxh3_64_intdigest(b" ".join(words))
            hashes.append(h - (1 << 64) if h >> 63 else h)
            sizes.append(len(words))
    return hashes, sizes


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            texts = [x or "" for x in part.column("text").to_pylist()]
            found, lines = [figures(x) for x in texts], [line_hashes(x) for x in texts]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("key"), *columns, pa.array([x[0] for x in lines], pa.list_(pa.int64())), pa.array([x[1] for x in lines], pa.list_(pa.int32()))], ["doc_id", "host", "key", *_FIGURES, "lines", "sizes"])


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, line_documents: int = 20, depleted: float = 0.5) -> DataFrame:
    """Adds to each document its figures, n_removed_words (in lines of more than line_documents documents of the host), base_failed and kept.

    kept is false where the base rules fail, or where the lines above the limit hold more than the share
    depleted of the words or leave fewer than min_words."""
    rows = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), text_key().alias("key"), "text")
    base = keep(rows.mapInArrow(_measure, f"doc_id bigint, host string, key bigint, {_BASE}, lines array<bigint>, sizes array<int>"), "rules")
    distinct = base.groupBy("host", "key", "doc_id").agg(F.first("lines").alias("lines"))  # repeated rows count once
    counts = distinct.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").count().where(F.col("count") > line_documents)
    common = keep(counts.select("host", "line"), "common")
    seen = base.select("host", "key", "lines", "sizes").select("host", "key", F.explode(F.arrays_zip("lines", "sizes")).alias("x"))
    seen = seen.select("host", "key", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    copies = base.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies"))
    removed = seen.join(common, ["host", "line"], "left_semi").groupBy("host", "key").agg(F.sum("size").alias("lost"))
    removed = removed.join(copies, ["host", "key"]).select("host", "key", (F.col("lost") / F.col("copies")).cast("bigint").alias("n_removed_words"))
    out = base.drop("lines", "sizes").join(removed, ["host", "key"], "left").na.fill(0, ["n_removed_words"])
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("base_failed", (n < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * n))
    lacking = (F.col("n_removed_words") > 0) & ((F.col("n_removed_words") > n * depleted) | (left < min_words))
    return out.withColumn("kept", ~F.col("base_failed") & ~lacking)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's base figures and verdict, hosts being sources."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_FIGURES, "base_failed", "kept", "n_removed_words")
