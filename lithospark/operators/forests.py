"""Trees and forests grown level by level: one pass a level sums histograms of all nodes of all trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chances of 0, 1, 2, ... copies of a row in a sample of as many rows with replacement, summed up: Poisson(1).
_COPIES = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


@dataclass
class Forest:
    """splits[t][node] = (feature, bin): rows whose bin is at most that go to node 2n, others to 2n + 1; the root is 1.

    leaves[t][node] = (value, share of the tree's rows)."""

    features: list[str]
    edges: list[np.ndarray]
    classes: bool
    splits: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    leaves: list[dict[int, tuple[float, float]]] = field(default_factory=list)

    def bins(self, b: pa.RecordBatch) -> np.ndarray:
        """Numbers of the values' bins; a value equal to an edge is in the bin below it, lost values are in the first one."""
        x = [np.nan_to_num(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-np.inf) for c in self.features]
        return np.stack([np.searchsorted(e, v, "left") for e, v in zip(self.edges, x)], 1) if x else np.zeros((b.num_rows, 0), np.int64)

    def nodes(self, bins: np.ndarray, t: int, depth: int) -> np.ndarray:
        node, inner = np.ones(len(bins), np.int64), np.array(sorted(self.splits[t]), np.int64)
        if not len(inner):
            return node
        feature, top = np.array([self.splits[t][int(n)] for n in inner], np.int64).T
        for _ in range(depth):
            at = np.minimum(np.searchsorted(inner, node), len(inner) - 1)
            on = np.flatnonzero(inner[at] == node)
            node[on] = 2 * node[on] + (bins[on, feature[at[on]]] > top[at[on]])
        return node


def _copies(keys: np.ndarray, t: int, seed: int) -> np.ndarray:
    """How often each row is in tree t's sample, by its key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(t + 1) * np.uint64(0x94D049BB133111EB)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.searchsorted(_COPIES, (x >> np.uint64(11)).astype(float) / 2**53, "right")


def grow(train: DataFrame, features: list[str], label: str, classes: bool, trees: int = 1, depth: int = 5, bins: int = 32, least: int = 1, seed: int = 1, bootstrap: bool = True, key: str = "row_id") -> Forest:
    """A forest from train(key, features, label); classes: labels are small whole numbers, else a number to be averaged.

    Splits lie at up to `bins` - 1 quantiles of each feature and are those with the largest gain in Gini impurity or squared
    error, the first feature and lowest edge of ties; a node without gain, at `depth` or below 2 x `least` rows is a leaf.
    With bootstrap a tree's sample is drawn by hashes of the key. Rows without label take no part. What reaches the driver
    is one row for each node."""
    rows = train.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("_key"), *features, F.col(label).cast("double").alias("_y"))
    q = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(c, q, 100_000).alias(f"e{n}") for n, c in enumerate(features)]).first()
    forest = Forest(features, [np.unique(np.array(found[f"e{n}"] or [], float)) for n in range(len(features))], classes, [{} for _ in range(trees)], [{} for _ in range(trees)])

    def histograms(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = max(map(len, forest.edges), default=0) + 1
            sums: dict = {}  # by tree, feature, node and label: n, s and q of the bins

            def rows_of() -> pa.RecordBatch:
                keys, table = np.array([(t, node, f) for t, f, node, _ in sums]), np.stack(list(sums.values()))
                g, bin_ = np.nonzero(table[:, 0])
                columns = [keys[g, 0].astype(np.int32), keys[g, 1], keys[g, 2].astype(np.int32), bin_, np.array([y for *_, y in sums], float)[g], table[g, 0, bin_].astype(np.int64), table[g, 1, bin_], table[g, 2, bin_]]
                return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["tree", "node", "feature", "bin", "y", "n", "s", "q"])

            for b in batches:
                code, y, keys = forest.bins(b), b.column("_y").to_numpy(), b.column("_key").to_numpy()
                kinds, kind = np.unique(y, return_inverse=True) if classes else (np.zeros(1), np.zeros(len(y), np.int64))
                for t in range(trees):
                    n = _copies(keys, t, seed) if bootstrap else np.ones(len(y), np.int64)
                    node = forest.nodes(code, t, level)
                    on = np.flatnonzero((n > 0) & (node >= 1 << level))
                    groups, group = np.unique(node[on] * len(kinds) + kind[on], return_inverse=True)
                    weights = [n[on] * y[on] ** p for p in range(3)]
                    for f in range(len(features)):
                        table = np.stack([np.bincount(group * most + code[on, f], w, len(groups) * most).reshape(-1, most) for w in weights], 1)
                        for g, x in zip(groups.tolist(), table):
                            k = t, f, g // len(kinds), float(kinds[g % len(kinds)])
                            sums[k] = sums[k] + x if k in sums else x
                if len(sums) > 50_000:  # deep trees: what a task holds is bounded
                    yield rows_of()
                    sums.clear()
            if sums:
                yield rows_of()

        return rows.mapInArrow(run, "tree int, node long, feature int, bin long, y double, n long, s double, q double").groupBy("tree", "node", "feature", "bin", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))

    def best(g: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(g["tree"].iloc[0]), int(g["node"].iloc[0])
        one = g[g["feature"] == g["feature"].min()]
        n = int(one["n"].sum())
        value = float(one.groupby("y")["n"].sum().idxmax()) if classes else float(one["s"].sum() / n)
        top = (1e-9 * max(1.0, float(one["q"].sum())), -1, 0)
        for f, part in g.groupby("feature"):
            at = np.unique(part["bin"])
            if classes:
                table = part.pivot_table(index="bin", columns="y", values="n", aggfunc="sum", fill_value=0).to_numpy(float).cumsum(0)
                score = lambda c: (c * c).sum(-1) / np.maximum(c.sum(-1), 1)
                left, right, whole = score(table), score(table[-1] - table), score(table[-1])
                count = table.sum(1)
            else:
                sums = part.groupby("bin")[["n", "s"]].sum().to_numpy(float).cumsum(0)
                score = lambda c: c[..., 1] ** 2 / np.maximum(c[..., 0], 1)
                left, right, whole = score(sums), score(sums[-1] - sums), score(sums[-1])
                count = sums[:, 0]
            gain = np.where((count >= least) & (count[-1] - count >= max(least, 1)), left + right - whole, 0.0)
            if gain.max(initial=0.0) > top[0] * (1 + 1e-12):
                top = (float(gain.max()), int(f), int(at[gain.argmax()]))
        return pd.DataFrame([(tree, node, n, value, top[1], top[2])], columns=["tree", "node", "n", "value", "feature", "bin"])

    total = [0] * trees
    for level in range(depth + 1):
        nodes = histograms(level).groupBy("tree", "node").applyInPandas(best, "tree int, node long, n long, value double, feature int, bin long").collect()  # a row a node
        grown = False
        for r in nodes:
            if level == 0:
                total[r["tree"]] = r["n"]
            if level < depth and r["feature"] >= 0 and r["n"] >= 2 * least:
                forest.splits[r["tree"]][r["node"]] = (r["feature"], r["bin"])
                grown = True
            else:
                forest.leaves[r["tree"]][r["node"]] = (r["value"], r["n"] / total[r["tree"]])
        if not grown:
            break
    return forest


def predict(rows: DataFrame, forest: Forest, key: str = "row_id") -> DataFrame:
    """key with class and uncertainty (1 - share of the votes; the smallest class of ties), or mean and variance.

    mean weighs each tree's estimate by the share of its rows in the leaf; variance is that of the estimates around it."""
    names = ["class", "uncertainty"] if forest.classes else ["mean", "variance"]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = forest.bins(b)
            found = []
            for t, leaves in enumerate(forest.leaves):
                node, where = np.unique(forest.nodes(code, t, max([n.bit_length() for n in leaves], default=1) - 1), return_inverse=True)
                if leaves:
                    found.append(np.array([leaves[int(n)] for n in node]).reshape(-1, 2)[where])
            if not found:
                continue
            value, share = np.stack([f[:, 0] for f in found]), np.stack([f[:, 1] for f in found])
            if forest.classes:
                kinds = np.unique(value)
                votes = np.stack([(value == k).sum(0) for k in kinds])
                a, c = kinds[votes.argmax(0)], 1 - votes.max(0) / len(value)
            else:
                a = (value * share).sum(0) / share.sum(0)
                c = ((value - a) ** 2).mean(0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(a.astype(np.int32) if forest.classes else a), pa.array(c)], [key, *names])

    return rows.select(key, *forest.features).mapInArrow(run, f"{key} {kind}, {names[0]} {'int' if forest.classes else 'double'}, {names[1]} double")
