"""Suffix-array dedup: removal of bytes in long strings that occur more than once.

In place of distributed prefix doubling (its method is in the next lines; the code has no rounds at growing
offsets and no reranking: it names 208 bytes at an anchor, then whole spans, then 400 bytes at single starts).
In the doubling a position's rank at length n names the string of n bytes that starts there;
Spark groups and sorts the positions by the pair of ranks (of the first n bytes, and of the n bytes at the
growing offset n), gives each distinct pair a new rank, and drops positions whose rank is unique, until
the length is past the threshold. Ranks are 64-bit names of strings rather than places in one global
order, so every position finds its rank at a bigger offset in its own text and no lookup by position is needed.

Doubling over every byte would move about 20 bytes for each byte of text in each round. So a start stands
for its neighbours: its anchor is the place of the least 16-byte hash among its first `window` places, and
starts with the same anchor are one run. Equal strings have their anchor at the same place, so a start can
only repeat if the `length - window` bytes from its anchor, named by the pair of its halves, do; other runs
drop out. A run whose whole span (from its first start to the end of its last string) repeats is settled
at once. For the runs left over (about two at each border of a repeat) the starts are ranked one by one at
the full length, together with one run of each settled span they may match.

The same is done in words: passages of so many words that start anywhere else, whatever white space is between
the words, are removed from the start of their first word to the end of their last.

Texts are UTF-8 bytes and never joined. A null text is an empty one. Repeated rows are repeats of each
other. A text shorter than `length` loses nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import discard, keep, likely, row_chunks, split_likely, table, utf8
from lithospark.llm.hashing import mix, prefix_hash, prefix_sums, range_hash, word_spans

#: Of bytes and of words: how many are hashed together at an anchor.
GRAM = {"bytes": 16, "words": 4}
#: Words of a passage, and starts among which its anchor is.
PASSAGE, PASSAGE_WINDOW = 50, 24


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == w else np.minimum(out[: len(out) - (w - span)], out[w - span :])


def units(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the units of these rows, and the n + 1 offsets of the rows in units."""
    if unit == "bytes":
        return prefix_hash(data), offsets
    start, end = word_spans(data, offsets)
    return prefix_sums(range_hash(prefix_hash(data), start, end)), np.searchsorted(start, offsets)


def anchor_runs(prefix: np.ndarray, offsets: np.ndarray, length: int, window: int, grams: int = 16) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor) for each run of starts of one row that have the same anchor.

    A start's anchor is the place, the first of equals, of the least gram hash among its first `window` places."""
    n = len(prefix) - 1
    none = (np.zeros(0, np.int64),) * 4
    if n < length:
        return none
    at = np.arange(n - grams + 1)
    gram = (range_hash(prefix, at, at + grams) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = window_min(gram, window)
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= row_end)
    if not len(start):
        return none
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    tail = np.append(head[1:], len(start)) - 1
    first = start[head]
    return np.searchsorted(offsets, first, "right") - 1, first, start[tail], anchor[head]


def _anchor_rows(length: int, window: int, unit: str):
    """Per run of starts: rid, first, last, the names of the head (length - window units from the anchor) and of the whole span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (length - window) // 2
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in row_chunks(offsets, 1 << 18):
                prefix, off = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                row, first, last, a = anchor_runs(prefix, off, length, window, GRAM[unit])
                if not len(a):
                    continue
                # the rank at length - window is the pair of the ranks of its halves
                head = mix(range_hash(prefix, a, a + half) * np.uint64(3) + range_hash(prefix, a + half, a + length - window))
                span = mix(range_hash(prefix, first, last + length) + (a - first).astype(np.uint64))
                columns = [(first - off[row]).astype(np.int32), (last - off[row]).astype(np.int32), head.view(np.int64), span.view(np.int64)]
                yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(i + row)), *map(pa.array, columns)], ["rid", "first", "last", "head", "span"])

    return run


def row_id() -> Column:
    """Names a row by its id and text: repeated rows share it, and so their result."""
    doc_id, text = F.col("doc_id"), F.col("text")
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.coalesce(text, F.lit("")), doc_id.isNull(), text.isNull())


def _names(length: int, unit: str):
    """The name of the string at each start of the gaps asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            gaps = b.column("gaps")
            flat, to = gaps.flatten(), gaps.offsets.to_numpy() - gaps.offsets[0].as_py()
            first, last, open_ = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            for i, j in row_chunks(offsets, 1 << 18):
                prefix, off = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                g = np.arange(to[i], to[j])
                of = np.repeat(np.arange(i, j), np.diff(to[i : j + 1]))
                n = last[g] - first[g] + 1
                pick = np.repeat(np.arange(len(g)), n)
                p = first[g][pick] + np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)
                at = p + off[of - i][pick]
                name = range_hash(prefix, at, at + length)
                yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(of[pick])), pa.array(p.astype(np.int32)), pa.array(open_[g][pick].astype(bool)), pa.array(name.view(np.int64))], ["rid", "start", "open", "name"])

    return run


def repeated_starts(docs: DataFrame, length: int = 400, window: int = 192, unit: str = "bytes") -> DataFrame:
    """(rid, first, last): runs of starts whose string of `length` units also starts anywhere else."""
    rows = docs.select(row_id().alias("rid"), "text").where(F.octet_length("text") >= (length if unit == "bytes" else 2 * length - 1))
    anchor = keep(rows.mapInArrow(_anchor_rows(length, window, unit), "rid bigint, first int, last int, head bigint, span bigint"), "anchors")
    again = keep(anchor.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), "heads")
    alive = keep(likely(anchor, "head", again).join(again.hint("merge"), "head", "left_semi"), "alive")
    discard(anchor)
    discard(again)
    ranks = keep(alive.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first")).alias("one")), "ranks")
    spans = keep(alive.join(ranks.hint("merge"), "span"), "spans")
    discard(alive)
    discard(ranks)
    settled = spans.where("n > 1").select("rid", "first", "last")
    open_heads = keep(spans.where("n = 1").select("head").distinct(), "open")
    asked = spans.where((F.col("n") == 1) | (F.struct("rid", "first") == F.col("one"))).join(open_heads.hint("merge"), "head", "left_semi")
    asked = keep(asked.groupBy("rid").agg(F.collect_set(F.struct("first", "last", (F.col("n") == 1).alias("open"))).alias("gaps")), "asked")  # bounded by one text
    single = likely(rows, "rid", asked).join(asked.hint("merge"), "rid").mapInArrow(_names(length, unit), "rid bigint, start int, open boolean, name bigint")
    single = keep(single, "starts")
    twice = keep(single.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open")).where("n > 1 AND open").select("name"), "twice")
    found = single.where("open").join(twice.hint("merge"), "name", "left_semi").select("rid", F.col("start").alias("first"), F.col("start").alias("last"))
    out = keep(settled.unionByName(found).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("starts")), "runs")  # bounded by one text
    for x in (spans, open_heads, asked, single, twice):
        discard(x)
    return out


def removed_runs(starts: list, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs of units covered by strings at the given (first, last) runs of starts."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        end = min(last + length, n)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def word_bytes(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes from the first to the last word of each run of words."""
    if not runs:
        return []
    start, end = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [(int(start[a]), int(end[b - 1])) for a, b in runs]


def remove_repeats(docs: DataFrame, length: int = 400, window: int = 192, as_text: bool = False, unit: str = "bytes") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (binary: the bytes left) to docs(doc_id, text, ...).

    With as_text, text itself becomes what is left instead, without characters that lost some of their bytes.
    Length and window count units: bytes or words."""
    runs = repeated_starts(docs, length, window, unit).withColumnRenamed("rid", "__rid")
    names = [c for c in docs.columns if c != "text"]
    maybe, clean = split_likely(docs.withColumn("__rid", row_id()), "__rid", runs)
    new = ["text" if as_text else "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, out = b.slice(at, 500), []
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_pylist()):
                    data = (text or "").encode()
                    gone = removed_runs([(s["first"], s["last"]) for s in starts or ()], length, 1 << 62)
                    gone = gone if unit == "bytes" else word_bytes(data, gone)
                    ends = [0, *(e for _, e in gone)]
                    left = [data[p:s] for p, s in zip(ends, [*(s for s, _ in gone), len(data)])]
                    whole = b"".join(left) if not as_text else text if not gone else "".join(x.decode(errors="ignore") for x in left)
                    out.append((whole, len(data), sum(e - s for s, e in gone), len(gone)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    kinds = ["text string" if as_text else "kept binary", "n_bytes bigint", "n_removed bigint", "n_spans bigint"]
    met = maybe.join(runs.hint("merge"), "__rid", "left").select(*names, "text", "starts").mapInArrow(run, ", ".join(fields + kinds))
    size, none = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")
    whole = F.col("text") if as_text else F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return met.unionByName(clean.select(*names, whole.alias(new[0]), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans")))


def passage_words(docs: DataFrame, words: int = PASSAGE, window: int = PASSAGE_WINDOW) -> DataFrame:
    """(rid, n_passage_words): rows with passages of so many words that start anywhere else, and the words in these."""
    runs = repeated_starts(docs, words, window, "words")
    covered = f"""aggregate(array_sort(starts), named_struct('n', 0L, 'end', 0L), (a, x) -> named_struct(
        'n', a.n + greatest(0L, x.last + {words}L - greatest(a.end, bigint(x.first))), 'end', greatest(a.end, x.last + {words}L)), a -> a.n)"""
    return runs.select("rid", F.expr(covered).alias("n_passage_words"))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 400-byte strings that start anywhere else; also the words in passages of 50 words or more
    that start anywhere else, many of which are shorter than 400 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = keep(passage_words(docs), "passages").withColumnRenamed("rid", "_rid")
    out = remove_repeats(docs.withColumn("_rid", row_id())).select("_rid", "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    out = out.join(passages.hint("merge"), "_rid", "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0).cast("bigint")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", (F.col("n_passage_words") > 0).alias("has_passage"))
