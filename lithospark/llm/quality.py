"""Quality classifier: a generalised additive model with pairwise interactions.

Figures of each text (shares of character kinds, repetition, word and line lengths) are cut into bins at
quantiles. Boosted shallow trees are fitted cyclically, one feature at a time with a small step, to the
gradient of the logistic loss; the trees of a feature add up to a lookup table over its bins. Then the
pairs of features that explain most of what is left get tables over their joint bins in the same way.
A score is the sigmoid of the sum of the tables' entries: vectorised additions of bin lookups.

The model is fitted on at most `train_rows` labelled documents (lowest hashes of their id); only their
figures, train_rows x 16 numbers, reach the driver. Scoring covers every whole text. A null text counts
as an empty one, which has a score like any other. Without both labels the score is the share of label 1
(0.5 without labels). Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import bounded_sample, id_crc, table

FEATURES = ("chars", "words", "word_length", "distinct_words", "top_word", "repeated_neighbours", "upper", "digits", "punctuation", "symbols", "other_marks", "lines", "line_length", "dup_lines", "short_lines", "end_marks")
_KIND = np.zeros(256, np.int64)
_KIND[[0x20, *range(9, 14)]] = 1
_KIND[range(ord("A"), ord("Z") + 1)] = 2
_KIND[range(ord("0"), ord("9") + 1)] = 3
_KIND[[ord(c) for c in ".,;:'\"?-"]] = 4
_KIND[[ord(c) for c in "#*$%&|<>{}[]\\^~=+_@/"]] = 5
_KIND[[ord(c) for c in "!()`"]] = 6


def figures(text: str) -> list[float]:
    """The 16 figures of a whole text, in the order of FEATURES."""
    data = text.encode()
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_KIND, kinds, 7) / max(1, len(data))
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = len(lines)
    counts = Counter(words)
    return [
        np.log1p(len(data)), np.log1p(n), sum(map(len, words)) / max(1, n), len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1), share[2], share[3], share[4], share[5], share[6],
        np.log1p(m), np.log1p(len(data) / max(1, m)), 1 - len(set(lines)) / max(1, m), sum(len(x) < 30 for x in lines) / max(1, m), sum(x.rstrip()[-1:] in b".?!\"'" for x in lines) / max(1, m),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([figures(t or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


def _best_splits(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Values per bin of a tree with at most that many leaves, grown by the best gain of its leaves."""
    gain = lambda a, b: a * a / (b + ridge)
    ranges, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(ranges) < leaves:
        best = (1e-9, None, None)
        for r, (a, b) in enumerate(ranges):
            if b - a > 1:
                at = np.arange(a + 1, b)
                lg, lh = cg[at] - cg[a], ch[at] - ch[a]
                rg, rh = cg[b] - cg[at], ch[b] - ch[at]
                v = np.where((lh >= least) & (rh >= least), gain(lg, lh) + gain(rg, rh) - gain(cg[b] - cg[a], ch[b] - ch[a]), 0)
                if v.max() > best[0]:
                    best = (v.max(), r, at[v.argmax()])
        if best[1] is None:
            break
        a, b = ranges[best[1]]
        ranges[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    for a, b in ranges:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, bins: int = 48, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.15, leaves: int = 4, least: float = 2.0, ridge: float = 1.0):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.n_pairs = bins, pair_bins, rounds, pair_rounds, pairs
        self.rate, self.leaves, self.least, self.ridge = rate, leaves, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.pair_edges = [e[np.unique(np.linspace(0, len(e) - 1, self.pair_bins - 1).astype(int))] if len(e) else e for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = y.mean() if len(y) else 0.5
        if share in (0.0, 1.0) or len(y) < 2:
            self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return self
        self.bias = float(np.log(share / (1 - share)))
        b = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        s = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            for f, bf in enumerate(b):
                if len(self.tables[f]) > 1:
                    p = 1 / (1 + np.exp(-s))
                    step = self.rate * _best_splits(np.bincount(bf, y - p, len(self.tables[f])), np.bincount(bf, p * (1 - p), len(self.tables[f])), self.leaves, self.least, self.ridge)
                    self.tables[f] += step
                    s += step[bf]
        c = [np.searchsorted(e, v, "right") for e, v in zip(self.pair_edges, x.T)]
        size = [len(e) + 1 for e in self.pair_edges]
        p = 1 / (1 + np.exp(-s))
        gains = []
        for i in range(len(c)):
            for j in range(i):
                code = c[i] * size[j] + c[j]
                g, h = np.bincount(code, y - p, size[i] * size[j]), np.bincount(code, p * (1 - p), size[i] * size[j])
                gains.append(((g * g / (h + 10 * self.ridge)).sum(), i, j))
        self.pairs = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-s))
                code = c[i] * size[j] + c[j]
                g, h = np.bincount(code, y - p, t.size).reshape(t.shape), np.bincount(code, p * (1 - p), t.size).reshape(t.shape)
                step = np.zeros(t.shape)
                cut = _best_splits(g.sum(1), h.sum(1), 2, self.least, self.ridge)  # a tree of depth two: first by i, then by j in each part
                for part in np.unique(cut):
                    rows = cut == part
                    step[rows] = self.rate * _best_splits(g[rows].sum(0), h[rows].sum(0), 2, self.least, self.ridge)
                t += step
                s += step[c[i], c[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            s += t[np.searchsorted(e, x[:, f], "right")]
        for i, j, t in self.pairs:
            s += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-s))


def fit(labelled: DataFrame, train_rows: int = 20_000, **parameters) -> AdditiveModel:
    """labelled(doc_id, text, quality): the model of at most train_rows of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(list(x), pa.list_(pa.float64())), b.column("quality")], ["doc_id", "hash", "x", "quality"])

    chosen = labelled.where(F.col("quality").isin(0, 1)).select("doc_id", F.xxhash64("text").alias("hash"), "text", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.mapInArrow(run, "doc_id bigint, hash bigint, x array<double>, quality int")  # figures move on, texts don't
    rows = chosen.orderBy(F.xxhash64("doc_id"), "hash", "quality").limit(train_rows).select("x", "quality").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    y = np.array([r["quality"] for r in rows], np.float64)
    order = np.lexsort((*x.T, y))
    return AdditiveModel(**parameters).fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds score (double) to docs, in place of a column of that name; the columns named by without don't come back from the tasks."""
    names = [c for c in docs.columns if c not in (*without, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                s = model.score(_matrix(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s)], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(run, f"{fields}, score double")


def chosen_labels(labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """At most that many labels outside the held-out fold, by lowest hash: a bounded side to join with."""
    marks = labels.where((id_crc() % 5 != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    return bounded_sample(marks, rows, [F.xxhash64("doc_id"), F.col("doc_id")])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> AdditiveModel:
    marks = chosen_labels(labels, train_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"), train_rows)  # bounded by train_rows


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: remainder 0 of crc32(doc_id) mod 5 is held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text").withColumn("held_out", id_crc() % 5 == 0), learn(docs, table(spark, sf_dir, "labels")), ("text",))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
