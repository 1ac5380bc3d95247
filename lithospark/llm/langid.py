"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 4-grams of the lower-cased text's code points, weighted by relative frequency
times inverse document frequency (counted over all learning documents). Training is follow-the-regularised-
leader (per-coordinate, with L1 and L2 penalties, so that weights stay sparse) on a sample of at most
`train_rows` learning documents; each pass runs over the sample's partitions in parallel from the same
state, and the states are averaged. A temperature, fitted on at most `calibrate_rows` learning documents
that were kept out of training, calibrates the probabilities. Scoring covers every whole text.

`und` with score 0.0 where text is null or has no letter, or where nothing could be learnt. A null id is
never held out. Repeated rows get equal results; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import bounded_sample, id_crc, keep, table

BITS, ORDERS = 16, 4
DIM = 1 << BITS
#: Tasks of a training pass at most: as many states reach the driver.
TASKS = 6
_LETTER = regex.compile(r"\p{L}")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of every 1- to 4-gram of the lower-cased text, white space as one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    c = np.where(c <= 32, np.uint32(32), c)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(min(ORDERS, len(c))):
        h = (h[: len(c) - n] * np.uint32(0x01000193) + c[n:]) * np.uint32(0x9E3779B1)
        x = (h ^ (h >> np.uint32(15))) * _MULT[n]
        out.append(x >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    x = ngram_buckets(text)
    n = np.bincount(x, minlength=DIM) if len(x) > 4000 else None
    if n is not None:
        at = np.flatnonzero(n)
        return at, n[at] / len(x)
    at, n = np.unique(x, return_counts=True)
    return at.astype(np.int64), n / max(1, len(x))


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each bucket, over all of docs, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        seen = np.zeros(DIM, bool)
        for b in batches:
            for t in b.column("text").to_pylist():
                x = ngram_buckets(t)
                if len(x) < 400:
                    total[np.unique(x)] += 1
                else:
                    seen[:] = False
                    seen[x] = True
                    total += seen
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, n = np.zeros(DIM, np.int64), 0
    for r in rows.collect():  # at most DIM + 1 rows
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, n


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.bias, self.temperature = langs, bias, temperature
        self.table = np.ascontiguousarray((weights * idf[:, None]).astype(np.float32))

    def logits(self, text: str) -> np.ndarray:
        x = ngram_buckets(text)
        s = np.zeros(len(self.langs))
        for at in range(0, len(x), 1 << 16):
            s += self.table[x[at : at + (1 << 16)]].sum(0, dtype=np.float32)
        return s / max(1, len(x)) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def _leader(z: np.ndarray, n: np.ndarray, l1: float, l2: float, alpha: float, beta: float = 1.0) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(learn: DataFrame, train: DataFrame, calibrate: DataFrame, passes: int = 3, train_rows: int = 6000, calibrate_rows: int = 2000, l1: float = 1e-4, l2: float = 1e-4, alpha: float = 2.0, most_langs: int = 200) -> Model | None:
    """learn, train, calibrate: (doc_id, text, lang) rows; frequencies come from all of learn, the rest from bounded samples.

    Languages beyond the most_langs most frequent ones are not learnt."""
    langs = sorted(r[0] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect())
    train, calibrate = train.where(F.col("lang").isin(langs)), calibrate.where(F.col("lang").isin(langs))
    if not langs:
        return None
    df, total = _document_frequencies(learn)
    idf = np.log((1 + total) / (1 + df)) + 1
    scale = 100.0  # relative frequencies are small; the penalties act on this scale
    k = len(langs)
    index = {x: i for i, x in enumerate(langs)}
    order = [F.xxhash64("doc_id"), F.xxhash64("text")]
    sample = keep(bounded_sample(train, train_rows, order).repartition(TASKS, F.xxhash64("doc_id", "text")), "train")
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    for _ in range(passes):
        def run(batches: Iterator[pa.RecordBatch], z0=z.astype(np.float32), n0=n.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            z1, n1, rows = z0.astype(float), n0.astype(float), 0
            for b in batches:
                for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                    at, x = _counts(text)
                    at, x = np.append(at, DIM), np.append(x * idf[at] * scale, 1.0)
                    w = _leader(z1[at], n1[at], l1, l2, alpha)
                    s = x @ w
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    p[index[lang]] -= 1
                    g = x[:, None] * p
                    sigma = (np.sqrt(n1[at] + g * g) - np.sqrt(n1[at])) / alpha
                    z1[at] += g - sigma * w
                    n1[at] += g * g
                    rows += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([z1.astype("<f4").tobytes()]), pa.array([n1.astype("<f4").tobytes()])], ["rows", "z", "n"])

        states = sample.select("text", "lang").coalesce(TASKS).mapInArrow(run, "rows bigint, z binary, n binary").collect()  # one per task, TASKS at most
        weight = sum(r["rows"] for r in states) or 1
        z = sum((np.frombuffer(r["z"], "<f4").reshape(z.shape) * (r["rows"] / weight) for r in states), np.zeros_like(z))
        n = sum((np.frombuffer(r["n"], "<f4").reshape(n.shape) * (r["rows"] / weight) for r in states), np.zeros_like(n))
    w = _leader(z, n, l1, l2, alpha)
    model = Model(langs, w[:DIM] * scale, idf, w[DIM])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 81))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if lang in index:
                    s = model.logits(text)[None] / grid[:, None]
                    s -= s.max(1, keepdims=True)
                    total += np.log(np.exp(s).sum(1)) - s[:, index[lang]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(total)], ["t", "loss"])

    held = bounded_sample(calibrate, calibrate_rows, order).select("text", "lang")
    loss = {r["t"]: r["loss"] for r in held.mapInArrow(losses, "t bigint, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()}
    if loss and max(loss.values()) > 0:
        model.temperature = float(grid[min(loss, key=lambda t: (loss[t], t))])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to docs(doc_id, held_out, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for t in b.column("text").to_pylist():
                if model is None or t is None or not _LETTER.search(t):
                    lang.append("und")
                    score.append(0.0)
                else:
                    p = model.probabilities(model.logits(t))
                    lang.append(model.langs[int(p.argmax())])
                    score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """Contract query: remainder 2 of crc32(doc_id) mod 4 is held out; 0 and 3 train, 1 calibrates."""
    docs = table(spark, sf_dir, "documents")
    fold = id_crc() % 4
    learn = docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    model = fit(learn, learn.where(fold != 1), learn.where(fold == 1))
    return predict(docs.withColumn("held_out", fold == 2), model)
