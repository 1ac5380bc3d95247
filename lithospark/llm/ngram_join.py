"""N-gram Jaccard join: documents whose sets of word 5-grams are alike, by chosen paths.

Documents with equal sets are one class from the start; a class is one row with its number of documents.
Each set is embedded in `TOKENS` MinHash tokens. A run splits the classes recursively: a node of the tree,
named by the path to it, samples 1 / threshold of the token places on average, the same for all its sets,
and a set goes to the child named by each sampled place and its token there. Two sets at the threshold share
one child of a common node on average, so the runs are repeated until the recall at the deepest level
reaches the target. Nodes of at most `BUCKET` sets are solved by brute force: all their sketches are
compared. What is still larger at the deepest level is solved by brute force too, in blocks of that size
paired with each other, so that no group is one task and no row is dropped.

Sketches that agree in more than threshold - 0.2 of the places (four standard deviations) connect two
classes; connected components of these are small groups that hold every link found. Inside a group all
pairs of sets are compared exactly by products of incidence matrices, in blocks for large groups; links are
counted there, never listed: a group of g sets gives g rows for each block it meets. Only the texts of such
sets are read again; a bounded bitmap of their row ids is broadcast before the join, so that few other texts
are shuffled. The joins are sort-merge joins at every size.

Words are runs of anything but ASCII white space; a text of 1 to 4 words has one shingle of all of them.
Null texts and those without words are alone in their class and have no links. Repeated rows are documents
of their own, linked to each other. Ties in class ids can't happen: the id is the class's least doc_id. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import components, discard, keep, likely, local_components, partitions, row_chunks, table, utf8, whole_groups
from lithospark.llm.hashing import mix, shingles, words
from lithospark.llm.repeats import row_id

TOKENS, BUCKET, DEPTH, SIZE = 64, 1000, 3, 5
#: Shingles in one block of an exact comparison.
BLOCK_SHINGLES = 400_000
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which two sets at the threshold have met at the deepest level with that probability.

    One run's probability by depth: a common node has one sampled place surely and another with probability
    1 / threshold - 1; the sets agree at a place with probability threshold."""
    q, extra = 1.0, 1 / threshold - 1
    for _ in range(DEPTH):
        miss = 1 - threshold * q
        q = 1 - miss * (1 - extra + extra * miss)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def doc_shingles(batch_text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts of distinct shingles of its rows, their sorted hashes) for ranges of rows."""
    data, offsets = utf8(batch_text)
    for i, j in row_chunks(offsets, 1 << 19):
        off = offsets[i : j + 1] - offsets[i]
        w, row = words(data[offsets[i] : offsets[j]], off)
        h, of = shingles(w, row, j - i, SIZE)
        yield i, np.bincount(of, minlength=j - i), h


def sketches(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """TOKENS 32-bit minima for each row with shingles."""
    n = counts[counts > 0]
    out = np.empty((len(n), TOKENS), np.uint32)
    if len(n):
        at = np.cumsum(n) - n
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat(((h * _MULTIPLIERS[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, counts, h in doc_shingles(b.column("text")):
            some = np.flatnonzero(counts)
            n, sig = counts[some], sketches(counts, h)
            at = np.cumsum(n) - n
            name = mix(np.add.reduceat(mix(h), at)) if len(n) else np.zeros(0, np.uint64)
            fp, raw = np.zeros(len(counts), np.int64), [None] * len(counts)
            fp[some] = name.view(np.int64)
            for k, r in enumerate(some):
                raw[r] = sig[k].tobytes()
            size = len(counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, size), b.column("rid").slice(i, size), pa.array(fp, mask=counts == 0), pa.array(counts), pa.array(raw, pa.binary())], ["doc_id", "rid", "fp", "n", "sketch"])


def _children(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): one sampled place for each node and a second one for some nodes."""
    p = path.view(np.uint64)
    one = (mix(p ^ np.uint64(0x51)) % np.uint64(TOKENS)).astype(np.int64)
    two = (one + 1 + (mix(p ^ np.uint64(0x52)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    has_two = mix(p ^ np.uint64(0x53)) < np.uint64(int((1 / threshold - 1) * (1 << 64)))
    row = np.concatenate([np.arange(len(p)), np.flatnonzero(has_two)])
    place = np.concatenate([one, two[has_two]])
    child = mix(p[row] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) + mix(place.astype(np.uint64) << np.uint64(32) | sig[row, place].astype(np.uint64)))
    return row, child.view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _split(threshold: float, runs: int = 0):
    """Children of each row's node; with runs, of the roots of all runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig, fp = _signatures(b.column("sketch")), b.column("fp").to_numpy()
                paths = [np.full(len(fp), int(r), np.int64) for r in range(runs)] if runs else [b.column("path").to_numpy()]
                for p in paths:
                    row, child = _children(p, sig, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(fp[row])], ["path", "fp"])

    return run


def _similar(least: int):
    """Edges inside each bucket (block pair) between sketches that agree in at least `least` places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, ["path", "lo", "hi"]):
            fp, side = t.column("fp").to_numpy(), t.column("block").to_numpy() == t.column("lo").to_numpy()
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            sig, size = _signatures(t.column("sketch")), np.diff(start)
            group = np.repeat(np.arange(len(size)), size)
            small = (size <= 24)[group]
            left, right = [], []
            for lag in range(1, 24):
                i = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:])) if len(group) > lag else []
                if not len(i):
                    break
                i = i[(sig[i] == sig[i + lag]).sum(1) >= least]
                left.append(fp[i])
                right.append(fp[i + lag])
            for g in np.flatnonzero(size > 24):
                s = slice(start[g], start[g + 1])
                x, ids, on = sig[s], fp[s], side[s]
                agree = np.zeros((len(x), len(x)), np.uint8)
                for k in range(TOKENS):
                    agree += x[:, k, None] == x[None, :, k]
                hit = agree >= least
                if cross[start[g]]:
                    hit &= on[:, None] != on[None]
                a, b = np.nonzero(np.triu(hit, 1))
                low = local_components(len(x), a, b)
                own = np.flatnonzero(low != np.arange(len(x)))
                left.append(ids[own])
                right.append(ids[low[own]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["src", "dst"])

    return run


def _shared(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of the sets that h holds one after another."""
    m = len(n)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    token = np.empty(len(h), np.int64)
    token[order] = np.cumsum(new) - 1
    frequent = np.bincount(token) > 1
    on = frequent[token]
    column = (np.cumsum(frequent) - 1)[token[on]]
    owner, width = owner[on], int(frequent.sum())
    out = np.zeros((m, m), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((m, min(4096, width - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _links(threshold: Fraction):
    """In each block pair: for each class the documents it links to in the other block, and its least linked class."""
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, ["root", "lo", "hi"], 200):
            t = t.combine_chunks()
            fp, weight = t.column("fp").to_numpy(), t.column("weight").to_numpy()
            lo, hi, block = (t.column(c).to_numpy() for c in ("lo", "hi", "block"))
            sets = t.column("shingles").chunk(0)
            flat, off = sets.flatten().to_numpy().view(np.uint64), sets.offsets.to_numpy() - sets.offsets[0].as_py()
            out: list[list] = [[], [], []]
            for g in range(len(start) - 1):
                s = np.arange(start[g], start[g + 1])
                s = s[np.unique(fp[s], return_index=True)[1]]  # repeated rows have one class
                n = np.diff(off)[s]
                shared = _shared(np.concatenate([flat[off[i] : off[i + 1]] for i in s]), n)
                hit = shared * (p + q) >= p * (n[:, None] + n[None])
                np.fill_diagonal(hit, False)
                if lo[s[0]] != hi[s[0]]:
                    hit &= block[s][:, None] != block[s][None]
                low = local_components(len(s), *np.nonzero(hit))
                out[0].append(fp[s])
                out[1].append(hit @ weight[s])
                out[2].append(fp[s][low])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["fp", "links", "low"])

    return run


def _blocked(df: DataFrame, blocks: str) -> DataFrame:
    """Copies of each row for every pair of its block with a block of its group."""
    df = df.withColumn("block", F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return df.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): doc_id, rid, fp of each row; fp, class_id, class_rid, copies, links of each set of shingles."""
    exact = Fraction(str(threshold))
    spark = docs.sparkSession
    shuffles = partitions(spark)
    texts = docs.select("doc_id", row_id().alias("rid"), "text")
    rows = keep(texts.mapInArrow(_sketch_rows, "doc_id bigint, rid bigint, fp bigint, n bigint, sketch binary"), "sketches")
    known = rows.where("fp IS NOT NULL")
    reps = keep(known.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "rid")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    members = keep(rows.select("doc_id", "rid", "fp"), "members")
    discard(rows)
    signed = reps.select("fp", "sketch")
    nodes = signed.mapInArrow(_split(threshold, runs_for(recall, threshold)), "path bigint, fp bigint")
    solved = None
    for depth in range(1, DEPTH + 1):
        nodes = keep(nodes, "nodes")
        sizes = keep(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        alive = nodes.join(sizes.hint("merge"), "path")
        done = keep(alive.where((F.col("size") <= BUCKET) | F.lit(depth == DEPTH)).withColumn("blocks", F.ceil(F.col("size") / BUCKET)).select("path", "fp", "blocks"), "buckets")
        solved = done if solved is None else solved.unionByName(done)
        if depth == DEPTH or sizes.where(F.col("size") > BUCKET).isEmpty():
            break
        nodes = alive.where(F.col("size") > BUCKET).select("path", "fp").join(signed.hint("merge"), "fp").mapInArrow(_split(threshold), "path bigint, fp bigint")
    keys = ["path", "lo", "hi"]
    buckets = _blocked(solved.join(signed.hint("merge"), "fp"), "blocks").select(*keys, "block", "fp", "sketch")
    least = math.ceil((threshold - 0.2) * TOKENS)
    loose = buckets.repartition(shuffles, *keys).sortWithinPartitions(*keys).mapInArrow(_similar(least), "src bigint, dst bigint")
    groups = keep(components(loose, "loose").withColumnRenamed("node", "fp"), "groups").join(reps.select("fp", "n", "copies", "one").hint("merge"), "fp")
    groups = keep(groups, "grouped")
    blocks = groups.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BUCKET)).alias("blocks"))
    active = keep(groups.join(keep(blocks, "blocks").hint("merge"), "root").select(F.col("one.rid").alias("rid"), "fp", "root", F.col("copies").alias("weight"), "blocks"), "active")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "root", "weight", "blocks"]
        for b in batches:
            for i, counts, h in doc_shingles(b.column("text")):
                of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, len(counts)) for c in names), of], [*names, "shingles"])

    keys = ["root", "lo", "hi"]
    full = likely(texts.select("rid", "text"), "rid", active.select("rid")).join(active.hint("merge"), ["rid"]).mapInArrow(sets, "fp bigint, root bigint, weight bigint, blocks bigint, shingles array<bigint>")
    full = _blocked(full, "blocks").select(*keys, "block", "fp", "weight", "shingles")
    found = keep(full.repartition(shuffles, *keys).sortWithinPartitions(*keys).mapInArrow(_links(exact), "fp bigint, links bigint, low bigint"), "links")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("fp").alias("src"), F.col("low").alias("dst")), "classes").withColumnRenamed("node", "fp")
    linked = keep(groups.select("fp", "copies", "one").join(links.hint("merge"), "fp").join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    heads = linked.groupBy("root").agg(F.min("one").alias("head"))
    linked = linked.join(keep(heads, "heads").hint("merge"), "root").select("fp", F.col("head.doc_id").alias("class_id"), F.col("head.rid").alias("class_rid"), "copies", "links")
    alone = reps.select("fp", F.col("one.doc_id").alias("class_id"), F.col("one.rid").alias("class_rid"), "copies", F.lit(0).cast("bigint").alias("links"))
    classes = alone.join(linked.select("fp").hint("merge"), "fp", "left_anti").unionByName(linked)
    return members, keep(classes, "sets")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, rid, class_id, class_rid (the row that stands for the class), n_links of every document."""
    members, classes = jaccard_classes(docs, threshold, recall)
    many = classes.where((F.col("copies") > 1) | (F.col("links") > 0))
    many = keep(many, "many")
    # rows without words have no class: they don't meet in the null key's task
    out = members.where("fp IS NOT NULL").join(many.hint("merge"), ["fp"], "left")
    out = out.unionByName(members.where("fp IS NULL"), allowMissingColumns=True)
    return out.select("doc_id", "rid", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_rid", "rid").alias("class_rid"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the least doc_id of its class and its number of links at Jaccard 0.8 on 5-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
