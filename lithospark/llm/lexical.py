"""Ranked lexical search: the documents of the highest scores for each item, by norm buckets.

A document is a sparse vector of integer impacts, one for each of its terms that some item holds; an item has the
terms' integer weights. With both multiplied by the root of the weight, the score is the inner product of two vectors.
Documents are range-sorted by the length of theirs, longest first, and cut into buckets: the ranges, and in them
blocks of BLOCK documents. The buckets are searched in rounds. The k-th score found so far for an item is its limit:

* a bucket is skipped where the item's length times its longest document is under the limit (Cauchy-Schwarz); the
  shortest length that can matter to any item is a filter of the scan;
* inside a bucket the item's rarer coordinates are summed up exactly by an index of the block, and what the others
  can add is bounded by Cauchy-Schwarz again, on the lengths that are left of item and document;
* survivors get their exact score in 64-bit integers, and the best k of each task go on to the next round.

Bounds are compared with a margin for rounding, so no document is lost. Items are searched in blocks of about
ITEM_BYTES of text (one item at least), each with one reading of the documents; counts and lengths are those of all.

Nulls: a null text has no terms; it and texts without terms are in no result and in no count. Documents without id
come first among equal scores. Repeated documents are documents of their own; items that are equal in id and text count once,
others of one id are ranked by themselves. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import first_by, keep, partitions, table

#: Documents of a block in a task; bytes of item texts searched together.
BLOCK = 1024
ITEM_BYTES = 4 << 20
_TERMS = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256)).lower()
_PIECE = 1 << 22


def terms(text: str | None) -> Counter:
    """Terms of a text and their occurrences: runs of ASCII letters, digits and anything beyond ASCII, A-Z in lower case."""
    data, out, at = (text or "").encode().translate(_TERMS), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and the offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs of the vocabulary's terms, of each document with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, ids, tfs = [], [], []
                for text in part.column("text").to_pylist():
                    has = terms(text)
                    hit = has.keys() & known
                    i = np.fromiter((vocabulary[t] for t in hit), np.int64, len(hit))
                    f = np.fromiter((has[t] for t in hit), np.int64, len(hit))
                    order = np.argsort(i)
                    n.append(has.total())
                    ids.append(i[order])
                    tfs.append(f[order])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), _lists(ids, pa.int32()), _lists(tfs, pa.int64())], ["doc_id", "n", "ids", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>").where("n > 0")


class Items:
    """Items of a block: their terms and weights, and the limits found so far."""

    def __init__(self, held: list[list[int]], weight: np.ndarray, common: np.ndarray):
        self.weight = weight
        self.root = np.sqrt(weight)
        self.held = [np.array([t for t in h if weight[t] > 0], np.int64) for h in held]
        self.length = np.array([math.sqrt(weight[h].sum()) for h in self.held])
        self.focus = [h[~common[h]] if (~common[h]).any() else h for h in self.held]
        self.rest = np.array([math.sqrt(max(0, int(weight[h].sum() - weight[f].sum()))) for h, f in zip(self.held, self.focus)])
        self.limit = np.zeros(len(held), np.int64)

    def shortest(self) -> float:
        """Documents with shorter vectors are in no result."""
        asked = self.length > 0
        return float(((self.limit[asked] - 1) / self.length[asked] * (1 - 1e-9)).min(initial=np.inf))


def _search(items: Items, k: int):
    """Best k documents of each item in a task: item, doc_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = items.limit.copy()
        best: dict[int, tuple[np.ndarray, pa.Array, np.ndarray]] = {}
        flags = np.zeros(len(items.weight), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                norm = b.column("norm").to_numpy()
                ids, offsets = _flat(b.column("ids"))
                impact = _flat(b.column("impacts"))[0]
                row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                order = np.argsort(ids, kind="stable")
                sorted_ids = ids[order]
                id_order = b.column("doc_id").fill_null(-(1 << 63)).to_numpy()
                for q in np.flatnonzero((items.length > 0) & (items.length * norm.max(initial=0) * (1 + 1e-9) + 1 >= limit)):
                    focus = items.focus[q]
                    a, z = np.searchsorted(sorted_ids, focus, "left"), np.searchsorted(sorted_ids, focus, "right")
                    n = z - a
                    at_entry = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                    r, d = row[at_entry], impact[at_entry] * items.root[ids[at_entry]]
                    some = np.bincount(r, d * items.root[ids[at_entry]], b.num_rows)
                    left = np.sqrt(np.maximum(norm * norm * (1 + 1e-9) - np.bincount(r, d * d, b.num_rows), 0))
                    over = np.flatnonzero((some + items.rest[q] * left) * (1 + 1e-9) + 1 >= limit[q])
                    if not len(over):
                        continue
                    flags[items.held[q]] = items.weight[items.held[q]]
                    n = np.diff(offsets)[over]
                    first = np.concatenate([[0], np.cumsum(n)[:-1]])
                    entry = np.repeat(offsets[over] - first, n) + np.arange(n.sum())
                    score = np.add.reduceat(flags[ids[entry]] * impact[entry], first)
                    flags[items.held[q]] = 0
                    good = (score > 0) & (score >= limit[q])
                    if not good.any():
                        continue
                    over, score = over[good], score[good]
                    s, i, d = score, id_order[over], b.column("doc_id").take(pa.array(over))
                    if q in best:
                        s, i, d = np.concatenate([best[q][0], s]), np.concatenate([best[q][2], i]), pa.concat_arrays([best[q][1], d])
                    top = np.lexsort((i, -s))[:k]
                    best[q] = (s[top], d.take(pa.array(top)), i[top])
                    if len(top) == k:
                        limit[q] = max(limit[q], s[top[-1]])
        for q, (s, d, _) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), d, pa.array(s)], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame | None:
    """item (place in texts), rank, doc_id, score."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    held = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms(x)] for x in texts]
    if not vocabulary:
        return None
    found = keep(vectors(docs, vocabulary), "vectors")
    n, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # at most a row for each term of the block
        df[r["id"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    items = Items(held, weight, df > n / 8)

    def weigh(batches: Iterator[pa.RecordBatch], weight=weight) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offsets = _flat(b.column("ids"))
            tf = _flat(b.column("tfs"))[0]
            m = 100 - 50 + 50 * b.column("n").to_numpy() * n // total
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
            norm = np.sqrt(np.bincount(row, weight[ids] * impact.astype(float) ** 2, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(norm), b.column("ids"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(impact))], ["doc_id", "norm", "ids", "impacts"])

    weighed = found.where(F.size("ids") > 0).mapInArrow(weigh, "doc_id bigint, norm double, ids array<int>, impacts array<bigint>").where("norm > 0")
    ranges = partitions(spark)
    order = [F.desc("norm"), F.xxhash64("doc_id", "norm"), F.monotonically_increasing_id()]  # so copies don't share a range
    dealt = weighed.withColumns({"_h": order[1], "_u": order[2]}).repartitionByRange(ranges, F.desc("norm"), "_h", "_u").sortWithinPartitions(F.desc("norm"))
    dealt = keep(dealt.select("doc_id", "norm", "ids", "impacts", F.spark_partition_id().alias("bucket")), "buckets")
    best, low = None, 0
    for high in sorted({max(1, ranges // 16), max(1, ranges // 4), 1 << 30}):
        some = dealt.where((F.col("bucket") >= low) & (F.col("bucket") < high) & (F.col("norm") >= items.shortest()))
        got = some.select("doc_id", "norm", "ids", "impacts").mapInArrow(_search(items, k), "item int, doc_id bigint, score bigint")
        best = keep(first_by(got if best is None else best.unionByName(got), ["item"], [F.desc("score"), F.col("doc_id")], k).select("item", "doc_id", "score", F.col("_rank").alias("rank")).drop("rank"), "best")
        for r in best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect():  # a row an item of the block
            items.limit[r["item"]] = r["least"]
        low = high
    return first_by(best, ["item"], [F.desc("score"), F.col("doc_id")], k).withColumnRenamed("_rank", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest positive scores for each item(item_id, text)."""
    asked = keep(items.select("item_id", "text").where("text IS NOT NULL").distinct(), "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)
    parts = []
    for block in range(blocks):
        rows = sorted(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect(), key=str)  # about item_bytes of text
        part = _block(docs, [r["text"] for r in rows], k) if rows else None
        if part is not None:
            names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id bigint")
            parts.append(part.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    empty = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 50 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op11_lexical": r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
has AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
size AS (SELECT r, doc_id, count(*) AS n FROM has GROUP BY ALL),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
item AS (SELECT row_number() OVER () AS q, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item),
tf AS (SELECT r, term, count(*) AS tf FROM has WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
score AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
WINDOW w AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) QUALIFY row_number() OVER w <= 50"""
}
