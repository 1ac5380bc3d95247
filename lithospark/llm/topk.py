"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become integers floor(256 * x). With M the largest length of any vector, a data vector x gets
one more coordinate sqrt(M^2 - |x|^2) and a query a zero, so that the largest inner product is the
smallest Euclidean distance and the triangle inequality holds. Data rows are grouped by their nearest
pivot; each cell is summed up by its size, its radius, its least distance and the k + 1 smallest distances of
different ids to its pivot. From these summaries every query gets an upper bound of its k-th distance, and goes
to those cells only whose lower bound does not exceed it. Cells and queries are dealt in blocks, so a cell with a
third of all rows is many tasks, and a block of a cell is copied to those blocks of queries only that visit it.

Nulls: vectors that are null, empty, or that hold null or non-finite components take no part; neither do rows
without id. A vector meets those of its own length only; each length is searched by itself. Ties go to the
smaller id. Repeated ids stay apart as candidates and never match their own id; as queries, equal rows count
once, and other vectors under one id have ranks of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithospark.llm.common import bounded_sample, first_by, keep

#: Rows of a block of data or of queries in one task.
BLOCK = 8192


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    x = F.col(vector)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(whole)
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lift(v: np.ndarray, longest: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where every sum stays under 2 ** 53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if top < 2**53 else q @ x.T


def top_k(df: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", most_pivots: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): the k candidates of each query with the largest inner product."""
    rows = keep(integer_vectors(df, id_col, vector), "vectors")
    parts = [_top_k(rows.where(F.size("v") == r["n"]), is_query, k, id_col, most_pivots) for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # lengths are few
    schema = "query_id bigint, id bigint, score bigint, rank int"
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def _top_k(rows: DataFrame, is_query: F.Column, k: int, id_col: str, most_pivots: int) -> DataFrame:
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    schema = "query_id bigint, query bigint, id bigint, score bigint"
    longest *= 1 + 1e-12
    size = int(min(most_pivots, max(4, n**0.5)))
    chosen = np.array([r["v"] for r in bounded_sample(rows, size, [F.xxhash64("id"), F.col("id")]).collect()], np.int64)  # at most most_pivots rows
    pivots = _lift(np.unique(chosen, axis=0), longest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_lift(_matrix(b.column("v")), longest), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "distance"])

    cells = keep(rows.mapInArrow(assign, "id bigint, v array<bigint>, cell int, distance double"), "cells")
    sizes = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.min("distance").alias("least")).collect()}
    near = np.full((len(pivots), k + 1), np.inf)
    ids = cells.groupBy("id").agg(F.min(F.struct("distance", "cell")).alias("_m")).select("_m.*")  # repeated ids count once
    for r in first_by(ids, ["cell"], [F.col("distance")], k + 1).collect():
        near[r["cell"], r["_rank"] - 1] = r["distance"]
    count = np.array([sizes[c]["n"] if c in sizes else 0 for c in range(len(pivots))])
    radius = np.array([sizes[c]["radius"] if c in sizes else 0 for c in range(len(pivots))])
    least = np.array([sizes[c]["least"] if c in sizes else 0 for c in range(len(pivots))])
    blocks = -(-count // BLOCK)
    queries = cells.where(is_query_of(is_query, id_col)).select("id", "v", F.xxhash64("id", "v").alias("query")).dropDuplicates(["query"])
    n_queries = queries.count()
    query_blocks = max(1, -(-n_queries // BLOCK))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                q = _matrix(part.column("v")).astype(np.float64)
                d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                upper = (d[:, :, None] + near[None]).reshape(len(q), -1)
                upper = np.partition(upper, min(k, upper.shape[1] - 1), axis=1)[:, min(k, upper.shape[1] - 1)]
                lower = np.maximum(d - radius, least - d)
                who, cell = np.nonzero((lower <= upper[:, None] * (1 + 1e-9) + 1e-6) & (count > 0))
                times = blocks[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(who)) for c in ("id", "query", "v")), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], ["id", "query", "v", "cell", "block"])

    keys = ["cell", "block", "part"]
    by = F.pmod("query", F.lit(query_blocks)).cast("int")
    asked = keep(queries.mapInArrow(visits, "id bigint, query bigint, v array<bigint>, cell int, block int").withColumn("part", by), "asked")
    held = cells.withColumn("blocks", F.element_at(F.array(*[F.lit(int(max(1, x))) for x in blocks]), F.col("cell") + 1))
    held = held.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    held = held.join(asked.select(F.col("cell").alias("_c"), F.col("block").alias("_b"), F.col("part").alias("_p")).distinct(), F.expr("cell = _c AND block = _b")).select("id", "v", "cell", "block", F.col("_p").alias("part"))

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        if queries.num_rows and data.num_rows:
            ids = data.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(data.column("v"))[order]
            own, name, q = queries.column("id").to_numpy(), queries.column("query").to_numpy(), _matrix(queries.column("v"))
            for at in range(0, len(own), 256):
                s = _products(q[at : at + 256], x)
                for i, row in enumerate(s):
                    other = ids != own[at + i]
                    pick = np.flatnonzero(other)
                    if len(pick) > k:
                        kth = np.partition(row[pick], len(pick) - k)[len(pick) - k]
                        over = pick[row[pick] > kth]
                        pick = np.concatenate([over, pick[row[pick] == kth][: k - len(over)]])
                    out.append((np.full(len(pick), own[at + i]), np.full(len(pick), name[at + i]), ids[pick], row[pick]))
        return pa.table({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "query", "id", "score"))})

    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(solve, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).drop("query")


def is_query_of(is_query: F.Column, id_col: str) -> F.Column:
    return F.expr(is_query.replace(id_col, "id")) if isinstance(is_query, str) else is_query


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: ids divisible by 50 against every other row, the 5 highest scores."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = top_k(df, "vec_id % 50 = 0", 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = {
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT vec_id, v, CAST(v AS DOUBLE[]) AS x FROM v),
q AS (SELECT vec_id AS query_id, CAST(v AS DOUBLE[]) AS x, row_number() OVER () AS q FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0)),
s AS (SELECT q, query_id, vec_id, CAST(list_dot_product(q.x, d.x) AS BIGINT) AS score FROM q JOIN d ON len(q.x) = len(d.x) AND query_id <> vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY q ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
}
