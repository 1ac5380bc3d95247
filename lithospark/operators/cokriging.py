"""Cokriging: an estimate of one variable from samples of several, each with neighbors of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.operators.spatial import _gamma_np, nearest_lists
from lithospark.spec import VariogramModel


def markov_model(primary: VariogramModel, correlation: float, secondary_sill: float) -> VariogramModel:
    """The cross model that is the primary's in another scale: sill = correlation x root of both sills."""
    c = correlation * (secondary_sill / primary.sill) ** 0.5
    return VariogramModel(primary.nugget * c, tuple(replace(s, sill=s.sill * c) for s in primary.structures))


def cokrige(
    targets: DataFrame, samples: list[tuple[DataFrame, str, int]], models: dict[tuple[int, int], VariogramModel], radius: float,
    means: list[float] | None = None, n_min: int = 1, axes: str = "xy", collocated: str | None = None,
) -> DataFrame:
    """row_id, estimate, variance, n: from samples[0] (the primary) and the others, each (table, value column, most neighbors).

    models[(i, j)], i <= j, are the variograms and cross variograms. Without means, weights of the primary add up to 1
    and those of each other variable to 0 (ordinary cokriging); with a mean for each variable, simple cokriging.
    collocated names a column of targets: the value there of one more variable, the last one of models; where it is
    null the variable is left out. Targets with fewer than n_min primary samples in the radius get no row.

    Neighbors come from nearest_lists for each variable; a target's few neighbors are one row, and rows with the
    same numbers of neighbors are solved together."""
    cols = [c for c in "xyz" if c in targets.columns]
    zero, parts = F.lit(0.0), []

    def sample(n: int, value: str) -> Callable[[Column, Column], Column]:
        move = lambda e: [((e[c] - F.col(c)) if c in cols else zero).cast("double").alias(f"d{c}") for c in "xyz"]
        return lambda e, place: F.struct(F.lit(n).alias("var"), (place + 1).cast("int").alias("rank"), *move(e), e[value].cast("double").alias("v"))

    for n, (table, value, most) in enumerate(samples):
        lists = nearest_lists(targets.select("row_id", *cols), table.where(F.col(value).isNotNull()).select("row_id", *cols, value), most, radius, axes)
        parts.append(lists.where(F.size("near") >= (n_min if n == 0 else 0)).select("row_id", F.transform("near", sample(n, value)).alias("s")))
    n_vars = len(samples) + bool(collocated)
    if collocated:
        here = targets.where(F.col(collocated).isNotNull())
        parts.append(here.select("row_id", F.array(F.struct(F.lit(len(samples)).alias("var"), F.lit(1).alias("rank"), *[zero.alias(f"d{c}") for c in "xyz"], F.col(collocated).cast("double").alias("v"))).alias("s")))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.groupBy("row_id").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s")).where(F.exists("s", lambda s: s["var"] == 0))  # a list of each variable
    model = lambda i, j: models[min(i, j), max(i, j)]

    def covariance(i: int, j: int, d: np.ndarray) -> np.ndarray:
        m = model(i, j)
        return m.sill - _gamma_np(d[..., 0], d[..., 1], d[..., 2], m)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("s")
            flat, to = s.flatten(), s.offsets.to_numpy() - s.offsets[0].as_py()
            var, v = flat.field("var").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False)
            d = np.stack([flat.field(f"d{c}").to_numpy(zero_copy_only=False) for c in "xyz"], -1)
            row = np.repeat(np.arange(len(to) - 1), np.diff(to))
            count = np.zeros((len(to) - 1, n_vars), np.int64)
            np.add.at(count, (row, var), 1)
            estimate, variance = np.empty(len(count)), np.empty(len(count))
            for pattern in np.unique(count, axis=0):
                t = np.flatnonzero((count == pattern).all(1))
                m, kind = int(pattern.sum()), np.repeat(np.arange(n_vars), pattern)
                at = to[t][:, None] + np.arange(m)
                p, u = d[at], v[at]
                known = np.flatnonzero(pattern) if means is None else np.zeros(0, np.int64)
                a, r = np.zeros((len(t), m + len(known), m + len(known))), np.zeros((len(t), m + len(known)))
                for i in np.flatnonzero(pattern):
                    on = np.flatnonzero(kind == i)
                    r[:, on] = covariance(0, i, p[:, on])
                    for j in np.flatnonzero(pattern):
                        to_j = np.flatnonzero(kind == j)
                        a[:, on[:, None], to_j] = covariance(i, j, p[:, on][:, :, None] - p[:, to_j][:, None])
                for c, i in enumerate(known):
                    a[:, m + c, :m] = a[:, :m, m + c] = kind == i
                    r[:, m + c] = i == 0
                try:
                    w = np.linalg.solve(a, r[..., None])[..., 0]
                except np.linalg.LinAlgError:  # coincident samples
                    w = np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, r)])
                centre = np.zeros(m) if means is None else np.asarray(means, float)[kind]
                estimate[t] = (w[:, :m] * (u - centre)).sum(1) + (0.0 if means is None else means[0])
                variance[t] = model(0, 0).sill - (w * r).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(estimate), pa.array(variance), pa.array(count[:, 0].astype(np.int32))], ["row_id", "estimate", "variance", "n"])

    return rows.mapInArrow(solve, f"row_id {rows.schema['row_id'].dataType.simpleString()}, estimate double, variance double, n int")
