"""Lost intervals of drill holes filled with drawn categories and thicknesses, several times over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("x0", "y0", "z0", "x1", "y1", "z1")


def draws(seed: int, real: int, attempt: int, row_id: int) -> Iterator[float]:
    """Numbers in [0, 1) for an interval of a realization, whatever task asks for them."""
    rng = np.random.default_rng([seed, real, attempt, row_id])
    while True:
        yield from rng.random(16)


def _pick(codes: np.ndarray, cumulative: np.ndarray, u: float) -> int:
    return int(codes[min(int(np.searchsorted(cumulative, u, "right")), len(codes) - 1)])


def _runs(segments: DataFrame, tolerance: float) -> DataFrame:
    """Intervals from the bottom up with run and before: lost ones in a row share a run, before is the category under the run.

    An interval that doesn't touch the one below it starts a run with nothing before; so does the lowest of a hole."""
    low = segments.withColumns({"_lo": F.least("z0", "z1"), "_up": F.col("z0") <= F.col("z1")})
    base = F.when(F.col("_up"), F.struct("x0", "y0", "z0")).otherwise(F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("z1").alias("z0")))
    top = F.when(F.col("_up"), F.struct("x1", "y1", "z1")).otherwise(F.struct(F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("z0").alias("z1")))
    low = low.withColumns({"_base": base, "_top": top})
    by = Window.partitionBy("hole").orderBy("_lo", "row_id")
    last = F.lag("_top").over(by)
    far = F.sqrt(sum(((F.col(f"_base.{c}0") - last[f"{c}1"]) ** 2 for c in "xyz"), F.lit(0.0)))
    low = low.withColumns({"_apart": F.coalesce(far > tolerance, F.lit(True)), "_last": F.lag("cat").over(by), "_first": F.lag("row_id").over(by).isNull()})
    new = F.col("_apart") | F.col("_last").isNotNull() | F.col("cat").isNotNull()
    return low.withColumn("run", F.sum(new.cast("int")).over(by)).withColumn("before", F.when(~F.col("_apart"), F.col("_last"))).drop("_lo", "_up", "_last", "_first", "_apart")


def impute_categories(
    segments: DataFrame, ftm: DataFrame, thickness: DataFrame, realizations: int, seed: int, fallback: DataFrame | None = None,
    forbid: DataFrame | None = None, threshold: float = 0.0, most_attempts: int = 20, tolerance: float = 1e-6,
) -> DataFrame:
    """real, row_id, piece, hole, x0 to z1, cat, imputed: each realization's intervals, known ones as they are (imputed 0).

    segments(row_id, hole, x0 to z1, cat); the end with the smaller z is the base. A lost interval is filled from its base
    on: a category by the transitions ftm(from, to, n) from the one below, or by fallback(cat, p) where there is none; its
    thickness along z by thickness(cat, value, cum), linear between entries; the last piece is cut off at the top, and ends
    lie on the interval's line. Lost intervals in a row go on from each other.
    forbid(from, to, n): a realization that has transitions with a probability above threshold that are not in it is drawn
    again, in rounds of all that were rejected; an error after most_attempts. Numbers depend on seed, realization, attempt
    and row only. Runs of lost intervals are drawn independently of each other and are not split over tasks; a task has many
    of them, one after another.
    A category without thickness or transitions, or no fallback where it is needed, is an error."""
    spark = segments.sparkSession
    chain: dict = {}
    for r in ftm.where("n > 0").orderBy("from", "to").collect():  # categories squared
        chain.setdefault(r["from"], []).append((r["to"], r["n"]))
    chain = {k: (np.array([t for t, _ in v]), np.cumsum([n for _, n in v]) / sum(n for _, n in v)) for k, v in chain.items()}
    curves: dict = {}
    for r in thickness.orderBy("cat", "cum", "value").collect():  # a table of a few entries for each category
        curves.setdefault(r["cat"], []).append((r["cum"], r["value"]))
    curves = {k: np.array(v, float).T for k, v in curves.items()}
    first = None
    if fallback is not None:
        rows = fallback.orderBy("cat").collect()  # a row a category
        p = np.array([r["p"] for r in rows], float)
        first = np.array([r["cat"] for r in rows]), np.cumsum(p) / p.sum()
    schema = "real int, row_id bigint, piece int, hole bigint, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, cat int, imputed int"
    names, types = zip(*[(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])
    asked = ["real", "attempt", "hole", "run", "row_id", "before", *[f"{e}_{c}" for e in ("base", "top") for c in "xyz"]]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = last = None
        for b in batches:
            out = []
            for real, attempt, hole, number, row_id, before, *ends in zip(*(b.column(c).to_pylist() for c in asked)):
                if run != (real, hole, number):  # a run goes on over batches
                    run, last = (real, hole, number), before
                u = draws(seed, real, attempt, row_id)
                a, top = np.array(ends[:3]), np.array(ends[3:])
                at, left, piece = a, top[2] - a[2], 0
                while True:
                    if last is not None and last not in chain:
                        raise ValueError(f"no transition from category {last}")
                    if last is None and first is None:
                        raise ValueError(f"nothing is known below interval {row_id} and there is no fallback")
                    last = _pick(*(chain[last] if last is not None else first), next(u))
                    thick = float(np.interp(next(u), *curves[last])) if last in curves else np.nan
                    if not thick > 0 and left > 0:
                        raise ValueError(f"no thickness above 0 for category {last}")
                    end = top if thick > left or left <= 0 else a + (top - a) * ((at[2] + thick - a[2]) / (top[2] - a[2]))
                    out.append((real, row_id, piece, hole, *at.tolist(), *end.tolist(), last, 1))
                    if thick > left or left <= 0:
                        break
                    at, left, piece = end, left - thick, piece + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    runs = _runs(segments, tolerance)
    known = segments.where("cat IS NOT NULL")
    lost = runs.where("cat IS NULL").select("row_id", "hole", "run", "before", *[F.col(f"_{e}.{c}{n}").cast("double").alias(f"{e}_{c}") for e, n in (("base", 0), ("top", 1)) for c in "xyz"])
    reals, attempt, parts = list(range(1, realizations + 1)), 0, []
    while reals:
        if attempt == most_attempts:
            raise RuntimeError(f"realizations {reals} still have forbidden transitions after {most_attempts} attempts")
        numbers = F.array(*[F.lit(r) for r in reals])
        each = lost.withColumns({"real": F.explode(numbers), "attempt": F.lit(attempt)}).select(asked)
        drawn = each.repartition("real", "hole", "run").sortWithinPartitions("real", "hole", "run", "base_z", "row_id").mapInArrow(fill, schema)
        same = known.select(F.explode(numbers).alias("real"), "row_id", F.lit(0).alias("piece"), F.col("hole").cast("bigint").alias("hole"), *[F.col(c).cast("double").alias(c) for c in ENDS], F.col("cat").cast("int").alias("cat"), F.lit(0).alias("imputed"))
        done = drawn.unionByName(same)
        if forbid is None:
            return done
        if spark.conf.get("spark.checkpoint.dir", None):
            done = done.checkpoint()
        bad = {r["real"] for r in forbidden(done, forbid, threshold).select("real").distinct().collect()}  # at most a row a realization
        parts.append(done.where(~F.col("real").isin(sorted(bad))) if bad else done)
        reals, attempt = sorted(bad), attempt + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forbidden(realizations: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """real, from, to, up: upward transitions of a realization that reference(from, to, n) never has, with a probability above threshold."""
    by = Window.partitionBy("real", "hole").orderBy(F.least("z0", "z1"), "row_id", "piece")
    pairs = realizations.withColumn("to", F.lead("cat").over(by)).where("to IS NOT NULL AND cat IS NOT NULL AND to <> cat")
    counts = pairs.groupBy("real", F.col("cat").alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("up", F.col("n") / F.sum("n").over(Window.partitionBy("real", "from")))
    return share.where(F.col("up") > threshold).join(reference.where("n > 0").select("from", "to"), ["from", "to"], "left_anti").select("real", "from", "to", "up")
