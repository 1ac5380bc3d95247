"""Tables with nulls for lost values: recoding, classes, summaries, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithospark.functions.scalar import quadratic_trend
from lithospark.sources.geoeas import range_bucket, with_row_id


def ndv_to_null(df: DataFrame, columns: list[str], ndv: float) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != ndv, F.col(c)) for c in columns})


def null_to_ndv(df: DataFrame, columns: list[str], ndv: float) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), ndv).otherwise(F.col(c)) for c in columns})


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def classify(column: str, intervals: list[tuple[float, float, int]], none: int | None = None) -> Column:
    """Code of the first closed interval that holds the value."""
    out = F.lit(none).cast("int")
    for low, high, code in reversed(intervals):
        out = F.when(F.col(column).between(low, high), code).otherwise(out)
    return out


def to_categorical(column: str, codes: list[int], fallback: int) -> Column:
    r = F.round(F.col(column)).cast("int")
    return F.when(F.col(column).isNull(), None).when(r.isin(codes), r).otherwise(fallback)


def names_to_codes(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Adds code: that of the name in names(name, code), else null, and token: the code as text, or else the name as it is.

    names is a category definition; Spark broadcasts it if small."""
    out = df.join(names.select(F.col("name").alias(column), "code"), column, "left")
    return out.withColumn("token", F.coalesce(F.col("code").cast("string"), F.col(column)))


def unmatched_names(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """name, n: the names without a code, and how many rows have each."""
    rows = df.where(F.col(column).isNotNull()).join(names.select(F.col("name").alias(column)), column, "left_anti")
    return rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def filter_category(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose code is that of the name in names(name, code)."""
    return df.join(names.where(F.col("name") == name).select(F.col("code").alias(column)), column, "left_semi")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


def add_constant(df: DataFrame, column: str, value: float, role: str | None = None, of: str | None = None) -> DataFrame:
    """Adds a column; with a role (weight, normal score, ...) of another column, which its metadata keep."""
    return with_role(df.withColumn(column, F.lit(value)), column, role, of) if role else df.withColumn(column, F.lit(value))


def with_role(df: DataFrame, column: str, role: str, of: str) -> DataFrame:
    return df.withMetadata(column, {**df.schema[column].metadata, "role": role, "of": of})


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """Drops the column and those with a role of it."""
    return df.drop(column, *[f.name for f in df.schema if f.metadata.get("of") == column])


def sort_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sorted by the column, ties by row_id."""
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc(), "row_id")


def group_tables(df: DataFrame, column: str) -> DataFrame:
    """A table for each value of the column: table, its number (by value), n and the bounds of its row ids; the rows stay in one frame."""
    groups = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    return with_row_id(groups, ["value"]).withColumnRenamed("row_id", "table")


def append_array(df: DataFrame, values: DataFrame, column: str, none: float = -999.0) -> DataFrame:
    """df with the column of values(cell, column); what is not finite, or not there, is none."""
    x = F.col(column)
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return df.join(values.select("cell", column), "cell", "left").withColumn(column, F.coalesce(finite, F.lit(none)))


def calculate(df: DataFrame, script: dict[str, str]) -> DataFrame:
    """Assigns SQL expressions to columns in order; values that are not finite become null."""
    for c, e in script.items():
        x = F.expr(e).cast("double")
        df = df.withColumn(c, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    return df


def append_column_from(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """df with the column of other by row_id; rows that only other has are there with nulls."""
    return df.join(other.select("row_id", column), "row_id", "full")


def summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.min(F.abs(c)).alias("min_abs"), F.max(F.abs(c)).alias("max_abs"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.count(c).alias("n"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def proportion(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    valid = df.where(F.col(column).isNotNull())
    return valid.agg(F.coalesce(F.avg(F.when(F.col(column).between(low, high), 1.0).otherwise(0.0)), F.lit(0.0)).alias("p"))


def bounding_box(df: DataFrame) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], *[F.avg(c).alias(f"center_{c}") for c in "xyz"])


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Weight and share of each bin in [low, high); the last bin is closed. Values outside take no part."""
    w = F.col(weight) if weight else F.lit(1.0)
    b = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.sum(w).alias("weight"))


def drift(df: DataFrame, column: str, slices: int) -> DataFrame:
    """Mean in equal slices along x, y and z of the bounding box; half-open, the last one closed."""
    box = df.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"]).first()  # one row
    axes = [F.struct(F.lit(a).alias("axis"), F.least(F.floor((F.col(a) - box[f"lo_{a}"]) / (box[f"hi_{a}"] - box[f"lo_{a}"]) * slices), F.lit(slices - 1)).cast("int").alias("slice")) for a in "xyz" if box[f"hi_{a}"] is not None and box[f"hi_{a}"] > box[f"lo_{a}"]]
    return df.select(column, F.explode(F.array(*axes)).alias("s")).groupBy("s.axis", "s.slice").agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def _in_cells(df: DataFrame, sizes: list[float], offsets: int) -> DataFrame:
    """df for every size and offset, with its cell cx, cy."""
    cells = df.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("offset"))
    shift = F.col("offset") * F.col("size") / offsets
    return cells.withColumns({"cx": F.floor((F.col("x") + shift) / F.col("size")), "cy": F.floor((F.col("y") + shift) / F.col("size"))})


def decluster(df: DataFrame, sizes: list[float], offsets: int = 5) -> DataFrame:
    """row_id, size, weight: cell declustering weights of mean 1 for every cell size, averaged over grid offsets."""
    keys = ["size", "offset", "cx", "cy"]
    cells = _in_cells(df.select("row_id", "x", "y"), sizes, offsets)
    counts = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    occupied = counts.groupBy("size", "offset").agg(F.count(F.lit(1)).alias("occupied"), F.sum("n").alias("rows"))
    weighted = cells.join(counts, keys).join(occupied, ["size", "offset"])
    return weighted.groupBy("row_id", "size").agg(F.avg(F.col("rows") / (F.col("n") * F.col("occupied"))).alias("weight"))


def decluster_best(df: DataFrame, column: str, sizes: list[float], offsets: int = 5, lowest: bool = True) -> DataFrame:
    """row_id, size, weight of the cell size with the lowest (highest) weighted mean; ties to the smaller size.

    The sizes are judged by counts and sums of cells; only the best one's weights are made row by row."""
    known = df.where(F.col(column).isNotNull())
    keys = ["size", "offset", "cx", "cy"]
    counts = _in_cells(known.select("row_id", "x", "y", column), sizes, offsets).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("total"))
    grids = counts.groupBy("size", "offset").agg(F.count(F.lit(1)).alias("occupied"), F.sum("n").alias("rows"), F.sum(F.col("total") / F.col("n")).alias("means"))
    # a row's weight in a grid is rows / (n * occupied), so the cells' own means and counts give the sums of weights and weighted values
    means = grids.groupBy("size").agg((F.sum(F.col("means") * F.col("rows") / F.col("occupied")) / F.sum("rows")).alias("mean"))
    best = means.orderBy(F.col("mean").asc() if lowest else F.col("mean").desc(), "size").select("size").first()  # one number
    return decluster(known, [best["size"]] if best else sizes[:1], offsets)


def cdf_table(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """value, w, p: mid-rank cumulative probability of each distinct value; equal values share it.

    Sums run in two levels: within ranges of values, then over the ranges before."""
    w = F.col(weight) if weight else F.lit(1.0)
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum(w).alias("w"))
    ranged = values.withColumn("_p", range_bucket(values, ["value"]))
    totals = ranged.groupBy("_p").agg(F.sum("w").alias("t"))
    before = totals.select("_p", F.coalesce(F.sum("t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # one row a range
    whole = totals.agg(F.sum("t").alias("all"))
    local = F.sum("w").over(Window.partitionBy("_p").orderBy("value"))
    out = ranged.withColumn("_c", local).join(F.broadcast(before), "_p").crossJoin(F.broadcast(whole))  # one row a range, and one row
    return out.select("value", "w", ((F.col("before") + F.col("_c") - F.col("w") / 2) / F.col("all")).alias("p"))


def percentiles_by(df: DataFrame, by: str, column: str, shares: list[float]) -> DataFrame:
    """by, q: for each value of by the percentiles of column at these shares, linear between two of its values, as F.percentile has them.

    Places are counted in two levels, within ranges of values and over the ranges before, so no task holds all values of
    a group. Lost values, and rows without by, take no part."""
    values = df.where(F.col(column).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = values.withColumn("_p", range_bucket(values, [by, "_v"]))
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum("_t").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy(by, "_p").agg(F.sum("_n").alias("_t")).select(by, "_p", before.alias("_before"), (F.sum("_t").over(w) - 1).alias("_most"))
    local = ranged.withColumn("_c", F.sum("_n").over(Window.partitionBy(by, "_p").orderBy("_v"))).join(F.broadcast(totals), [by, "_p"])  # a row a range and group
    last = F.col("_before") + F.col("_c") - 1
    at = [F.col("_most") * F.lit(float(p)) for p in shares]
    holds = lambda place: (place <= last) & (place > last - F.col("_n"))
    ends = [holds(f(p)) for p in at for f in (F.floor, F.ceil)]
    found = local.where(reduce(Column.__or__, ends)).groupBy(by, "_most").agg(*[F.max(F.when(e, F.col("_v"))).alias(f"_{n}") for n, e in enumerate(ends)])
    between = lambda p, a, b: F.when((F.ceil(p) == F.floor(p)) | (a == b), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
    return found.select(by, F.array(*[between(p, F.col(f"_{2 * n}"), F.col(f"_{2 * n + 1}")) for n, p in enumerate(at)]).alias("q"))


#: Coefficients of Acklam's rational approximation of the inverse normal (fixed values).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for k in c:
        out = out * x + k
    return out


def inverse_normal(p: Column) -> Column:
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(_C, t) / (_poly(_D, t) * t + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(_poly(_A, r) * q / (_poly(_B, r) * r + 1))


def normal_score(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Adds score to df; the transform table is cdf_table()."""
    scores = cdf_table(df, column, weight).select(F.col("value").alias(column), inverse_normal(F.col("p")).alias("score"))
    return df.join(scores, column, "left")


def bivariate(df: DataFrame, x: str, y: str, dx: float, dy: float) -> DataFrame:
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) / dx).alias("bx"), F.floor(F.col(y) / dy).alias("by")).count()
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("all")))).select("bx", "by", (F.col("count") / F.col("all")).alias("p"))  # one row


def soft_calibration(df: DataFrame, primary: str, secondary: Column, thresholds: list[float]) -> DataFrame:
    """Per secondary class the share of primary values at or below each threshold."""
    shares = [F.avg(F.when(F.col(primary) <= t, 1.0).otherwise(0.0)).alias(f"p{i}") for i, t in enumerate(thresholds)]
    return df.groupBy(secondary.alias("class")).agg(F.count(F.lit(1)).alias("n"), *shares)


def trend_sums(df: DataFrame, column: str) -> DataFrame:
    """Normal equations of the quadratic drift in one pass: a_ij and b_i for its nine terms."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    terms = [x * x, y * y, z * z, x * y, x * z, y * z, x, y, z]
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(9) for j in range(i, 9)]
    return df.where(F.col(column).isNotNull()).agg(*sums, *[F.sum(t * F.col(column)).alias(f"b{i}") for i, t in enumerate(terms)])


def detrended(df: DataFrame, column: str, coefficients: tuple[float, ...]) -> DataFrame:
    """Adds trend, the quadratic drift at x, y, z, and residual, the column less it."""
    out = df.withColumn("trend", quadratic_trend(F.col("x"), F.col("y"), F.col("z"), coefficients))
    return out.withColumn("residual", F.col(column) - F.col("trend"))


def fit_trend(df: DataFrame, column: str) -> tuple[float, ...]:
    import numpy as np

    r = trend_sums(df, column).first()  # 54 sums
    a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)], float)
    return tuple(np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(9)], float), rcond=None)[0])


def global_pdf(df: DataFrame, indicators: list[str]) -> DataFrame:
    """indicator, p: the mean of each indicator column, lost values aside."""
    means = df.agg(*[F.avg(c).alias(c) for c in indicators])
    return means.unpivot([], indicators, "indicator", "p")


def trend_errors(df: DataFrame, column: str, candidates: list[tuple[float, ...]]) -> DataFrame:
    """candidate, error: mean absolute error of each set of nine coefficients (xx, yy, zz, xy, xz, yz, x, y, z), in one pass."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    terms = [x * x, y * y, z * z, x * y, x * z, y * z, x, y, z]
    names = [str(i) for i in range(len(candidates))]
    errors = [F.avg(F.abs(F.col(column) - sum((t * c for t, c in zip(terms, row)), F.lit(0.0)))).alias(n) for n, row in zip(names, candidates)]
    return df.agg(*errors).unpivot([], names, "candidate", "error").withColumn("candidate", F.col("candidate").cast("int"))


def draw_category(pdf: DataFrame, draws: DataFrame) -> DataFrame:
    """draws(u, ...) with the first category of pdf(code, p), by code, whose cumulative probability reaches u; null if none does.

    The probabilities of one variable's categories are few: they become one row, as an array."""
    cum = F.sum("p").over(Window.partitionBy(F.lit(0)).orderBy("code"))
    steps = pdf.withColumn("cum", cum).agg(F.sort_array(F.collect_list(F.struct("code", "cum"))).alias("_steps"))
    hit = F.filter("_steps", lambda s: s["cum"] >= F.col("u"))
    return draws.crossJoin(F.broadcast(steps)).withColumn("code", F.get(hit, F.lit(0))["code"]).drop("_steps")  # one row
