"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text, ASCII letters in lower case and anything but letters and digits one space, is its runs of 3 to 6 bytes, hashed
to 2 ** 18 buckets. A bucket has two figures: its share of the text's runs, and whether it is there at all; the one
finds habits, the other single words in long texts. From the training texts every figure gets the logarithm of how much
larger it is on the whole under label 1 than under label 0, drawn towards zero by `sure` standard errors, so that what
is not known to tell the labels apart stays zero. A text's features are its figures times these ratios; logistic
regression with AdaGrad steps and a quadratic penalty fits their weights in shards, one task each, whose states are
averaged after each pass.

The model is fitted on at most `train_rows` labelled documents (lowest hashes of their id), whole texts; where rows of
one doc_id differ, the least text and the larger label stand for it. Scoring covers every whole text, in pieces of a
bounded size. A null text counts as an empty one, which has a score like any other. Without both labels the score is
the share of label 1 (0.5 without labels). Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import bounded_sample, id_crc, keep, table

BITS = 18
DIM = 1 << BITS
SIZES = (3, 4, 5, 6)
#: Runs that a training text counts for; scale of shares and of presence.
RUNS, SCALE, PRESENT = 1000.0, 2000.0, 0.5
SHARDS = 8
_FOLD = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256)).lower()
_PIECE = 1 << 20


def _hashes(c: np.ndarray) -> Iterator[np.ndarray]:
    h = c
    for n in range(2, SIZES[-1] + 1):
        if len(c) < n:
            return
        h = (h[:-1] * np.uint32(0x01000193) + c[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in SIZES:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS)


def gram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all runs of a text, repeats included, in pieces."""
    data = b" %s " % b" ".join((text or "").encode().translate(_FOLD).split())
    for at in range(0, len(data), _PIECE):
        yield from _hashes(np.frombuffer(data, np.uint8)[at : at + _PIECE + SIZES[-1] - 1].astype(np.uint32))


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its runs."""
    n = np.zeros(DIM, np.int64)
    held: list[np.ndarray] = []
    for x in gram_buckets(text):
        held.append(x)
        if len(held) == 4 * len(SIZES):
            n, held = n + np.bincount(np.concatenate(held), minlength=DIM), []
    if held:
        n = n + np.bincount(np.concatenate(held), minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at] / max(1, n.sum())


class Model:
    """score = sigmoid(bias + mean of table[0] over a text's runs + sum of table[1] over its distinct buckets)."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = np.ascontiguousarray(table.reshape(2, DIM)), bias

    def scores(self, texts: list[str | None]) -> list[float]:
        out, seen = [], np.zeros(DIM, bool)
        for text in texts:
            s, n = 0.0, 0
            for x in gram_buckets(text):
                s += float(self.table[0][x].sum(dtype=np.float64))
                n += len(x)
                seen[x] = True
            at = np.flatnonzero(seen)
            seen[at] = False
            s = self.bias + s / max(1, n) + float(self.table[1][at].sum(dtype=np.float64))
            out.append(float(1 / (1 + np.exp(-np.clip(s, -700, 700)))))
        return out


def log_count_ratios(n1: np.ndarray, n0: np.ndarray, sure: float, alpha: float = 1.0) -> np.ndarray:
    """log((n1 + alpha) / sum) - log((n0 + alpha) / sum), shrunk towards zero by `sure` standard errors."""
    p, q = n1 + alpha, n0 + alpha
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.sign(r) * np.maximum(np.abs(r) - sure * np.sqrt(1 / p + 1 / q), 0)


def _descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: np.ndarray, n: np.ndarray, rate: float, l2: float) -> None:
    """One pass of AdaGrad over these documents' (places, features), in place; the last weight is the bias."""
    for (at, v), label in zip(x, y):
        at, v = np.append(at, len(w) - 1), np.append(v, 1.0)
        p = 1 / (1 + np.exp(-np.clip(v @ w[at], -700, 700)))
        g = (p - label) * v + l2 * w[at]
        n[at] += g * g
        w[at] -= rate * g / (1e-8 + np.sqrt(n[at]))


def fit(labelled: DataFrame, sure: float = 3.5, passes: int = 8, rate: float = 0.2, l2: float = 1e-4) -> Model:
    """labelled(doc_id, text, toxic), a bounded table: the model of it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros((2, 2 * DIM)), np.zeros(2)
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                at, share = shares(text)
                n[y, at] += share * RUNS
                n[y, DIM + at] += 1
                rows[y] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 2 * DIM)), pa.array(np.append(n[0, at], rows[0])), pa.array(np.append(n[1, at], rows[1]))], ["bucket", "n0", "n1"])

    totals = labelled.select("text", "toxic").mapInArrow(count, "bucket bigint, n0 double, n1 double").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = totals.toArrow()  # 2 * DIM + 1 rows at most
    n = np.zeros((2, 2 * DIM + 1))
    n[:, got.column("bucket").to_numpy()] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    rows = n[:, 2 * DIM]
    if not rows.all():
        share = rows[1] / rows.sum() if rows.any() else 0.5
        return Model(np.zeros(2 * DIM, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    r = [log_count_ratios(n[1, part], n[0, part], sure) for part in (slice(0, DIM), slice(DIM, 2 * DIM))]
    r = np.concatenate([r[0] * SCALE, r[1] * PRESENT])

    def project(batches: Iterator[pa.RecordBatch], r=r.astype(np.float32)) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, x, v = b.slice(at, 256), [], []
                for g, share in map(shares, part.column("text").to_pylist()):
                    places, figures = np.concatenate([g, g + DIM]), np.concatenate([share, np.ones(len(g))])
                    known = r[places] != 0
                    x.append(places[known].astype(np.int32))
                    v.append((figures[known] * r[places[known]]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(x, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32()))], ["doc_id", "toxic", "x", "v"])

    # one task a shard, as labelled has them; nothing moves between the passes
    features = keep(labelled.select("doc_id", "toxic", "text").mapInArrow(project, "doc_id bigint, toxic int, x array<int>, v array<float>"), "features")
    w, g2 = np.full(2 * DIM + 1, 0.1), np.full(2 * DIM + 1, 1e-3)
    w[-1] = np.log(rows[1] / rows[0])
    for _ in range(passes):
        start = w.astype(np.float32), g2.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w1, n1, rows = start[0].astype(float), start[1].astype(float), 0
            for b in batches:
                order = np.random.default_rng(b.num_rows).permutation(b.num_rows)
                x = [(np.asarray(g, np.int64), np.asarray(v, float)) for g, v in zip(b.column("x").to_pylist(), b.column("v").to_pylist())]
                _descend([x[i] for i in order], b.column("toxic").to_numpy()[order], w1, n1, rate, l2)
                rows += b.num_rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([w1.astype("<f4").tobytes()]), pa.array([n1.astype("<f4").tobytes()])], ["rows", "w", "n"])

        states = features.select("toxic", "x", "v").coalesce(SHARDS).mapInArrow(run, "rows bigint, w binary, n binary").collect()  # one row a task, SHARDS at most
        total = sum(s["rows"] for s in states)
        w = sum(np.frombuffer(s["w"], "<f4").astype(float) * (s["rows"] / total) for s in states)
        g2 = sum(np.frombuffer(s["n"], "<f4").astype(float) * (s["rows"] / total) for s in states)
    return Model((w[:-1] * r).astype(np.float32), float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = 10_000) -> DataFrame:
    """doc_id, text, toxic of at most train_rows labelled documents outside the held-out fold, dealt to SHARDS tasks."""
    marks = labels.where((id_crc() % 5 != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = bounded_sample(marks, train_rows, [F.xxhash64("doc_id"), F.col("doc_id")])
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # bounded by train_rows
    return keep(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(SHARDS, "doc_id"), "train")


def score(docs: DataFrame, model: Model, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds score (double) to docs, in place of a column of that name; the columns named by without don't come back from the tasks."""
    names = [c for c in docs.columns if c not in (*without, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                s = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s, pa.float64())], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(run, f"{fields}, score double")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: remainder 0 of crc32(doc_id) mod 5 is held out; 1 from a score of 0.5 on."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(docs.select("doc_id", "text").withColumn("held_out", id_crc() % 5 == 0), model, ("text",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
