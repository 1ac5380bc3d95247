"""Joins by place: pairs within a distance, neighbors, cells; variograms; contact analysis; kriging."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lithospark.functions.scalar import anisotropic_h, gamma
from lithospark.spec import GridSpec, Structure, VariogramModel


def _bucket(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / size).cast("bigint")


def _close(p: list[np.ndarray], q: list[np.ndarray], r: float, ahead: bool = False, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of p at a time and the rows of q around them; their distances, and whether these are below r, as matrices.

    p and q hold coordinates by axis. Rows lie in strips of width r / 2 along the last axis, sorted along it; a row meets what is within
    r along its own and the strips around. ahead: pairs are looked for once, from the row with the smaller first coordinate."""
    if not len(p[0]) or not len(q[0]):
        return
    d, low, r1 = len(p) - 1, [min(u.min(), v.min()) for u, v in zip(p, q)], r * (1 + 1e-9)  # a little more than r, as borders may be rounded
    cells = lambda s: [np.floor((x - o) / (r1 / 2)).astype(np.int64) + 2 for x, o in zip(s[:d], low)]
    cp, cq = cells(p), cells(q)
    wide = [int(max(u.max(), v.max())) + 3 for u, v in zip(cp, cq)]
    key = lambda c, n: reduce(lambda k, x: k * x[1] + x[0], zip(c, wide), np.zeros(n, np.int64))
    kp, kq = key(cp, len(p[d])), key(cq, len(q[d]))
    op, oq = np.lexsort((p[d], kp)), np.lexsort((q[d], kq))
    kp, kq, last, sp, sq = kp[op], kq[oq], q[d][oq], [x[op] for x in p], [x[oq] for x in q]
    around = np.array([int(key([np.array([o]) for o in move], 1)[0]) for move in product(range(-2, 3), repeat=d) if not ahead or not d or move[0] >= 0])
    start = np.append(np.flatnonzero(np.concatenate([[True], kp[1:] != kp[:-1]])), len(kp)).tolist()
    for begin, end in zip(start[:-1], start[1:]):
        strips, own = kp[begin] + around, sp[d][begin:end]
        lows, highs = np.searchsorted(kq, strips).tolist(), np.searchsorted(kq, strips, "right").tolist()
        i = begin
        while i < end:
            stop = min(end, i + 256, max(i + 32, begin + int(np.searchsorted(own, sp[d][i] + r / 2, "right"))))
            first, final = sp[d][i] - r1, sp[d][stop - 1] + r1
            some = [np.arange(lo + np.searchsorted(last[lo:hi], first), lo + np.searchsorted(last[lo:hi], final, "right")) for lo, hi in zip(lows, highs) if lo < hi]
            cols = np.concatenate(some) if some else np.zeros(0, np.int64)
            if len(cols):
                there, step = [x[cols] for x in sq], max(1, most // len(cols))
                for k in range(i, stop, step):
                    rows = slice(k, min(k + step, stop))
                    far = np.sqrt(reduce(lambda t, x: t + (x[0][rows, None] - x[1]) ** 2, zip(sp, there), 0.0))
                    yield op[rows], oq[cols], far, far < r
            i = stop


def meet(a: DataFrame, b: DataFrame, r: float, axes: str, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: StructType, rows: int = 4000, most: int = 40_000) -> DataFrame:
    """work(some rows of a, rows of b) over tiles, so that each two rows closer than r are in one call together, and a row of a meets no row of b twice.

    Rows without a finite place are dropped. Tiles have an edge of 2 to 64 times r, with some `rows` rows each if these are spread evenly;
    b's rows are copied to the tiles that they are within r of. Of tiles with over `most` rows of a table parts meet parts, each two in a call."""
    finite = reduce(lambda p, x: p & (F.abs(x) < math.inf), axes, F.lit(True))
    a, b = a.where(finite), b.where(finite)
    box = a.select(*axes).unionByName(b.select(*axes)).agg(F.count(F.lit(1)), *[F.max(x) - F.min(x) for x in axes]).first()  # one row
    sides = [x or 0.0 for x in box[1:]]
    m = next((m for m in (64, 32, 16, 8, 4) if box[0] <= rows * math.prod(max(1.0, side / (m * r)) for side in sides)), 2)
    edge, keys, tiles = m * r, [f"_{x}" for x in axes], math.prod(math.ceil(side / (m * r)) + 1 for side in sides)  # at most so many
    left = a.withColumns({k: _bucket(x, edge) for k, x in zip(keys, axes)})
    right = b
    for k, x in zip(keys, axes):
        right = right.withColumn(k, F.explode(F.sequence(F.floor((F.col(x) - r * (1 + 1e-9)) / edge), F.floor((F.col(x) + r * (1 + 1e-9)) / edge))))
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    deal = parts(left, "_na").join(parts(right, "_nb"), keys)
    deal = F.broadcast(deal) if tiles <= 100_000 else deal
    salt = lambda df, n: F.pmod(F.xxhash64(*df.columns), n).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = [*keys, "_pa", "_pb"]
    asked = left.join(deal, keys).withColumn("_pa", salt(a, F.col("_na"))).withColumn("_pb", copies("_nb")).select(*group, F.lit(0).alias("_side"), F.struct(*a.columns).alias("_a"))
    known = right.join(deal, keys).withColumn("_pb", salt(b, F.col("_nb"))).withColumn("_pa", copies("_na")).select(*group, F.lit(1).alias("_side"), F.struct(*b.columns).alias("_b"))
    n = int(min(600, tiles * max(1, (box[0] / most / tiles) ** 2)))  # a number, as the rows are few bytes and much work
    dealt = asked.unionByName(known, allowMissingColumns=True).repartition(n, *group).sortWithinPartitions(*group, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            here = t.num_rows - int(t.column("_side").to_numpy().sum())
            if 0 < here < t.num_rows:
                side = lambda c, part: pa.Table.from_struct_array(part.column(c).combine_chunks())
                yield from work(side("_a", t.slice(0, here)), side("_b", t.slice(here)))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            of = np.stack([t.column(k).to_numpy() for k in group])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = of[:, lo].tolist()
                if held and now != last:
                    yield from done()
                    held.clear()
                last = now
                held.append(t.slice(lo, hi - lo))
        if held:
            yield from done()

    return dealt.mapInArrow(run, schema)


def _at(t: pa.Table, axes: str) -> list[np.ndarray]:
    return [t.column(x).to_numpy().astype(float) for x in axes]


def _paired(a: DataFrame, b: DataFrame, r: float, axes: str, carry: tuple[str, ...] | None, choose: Callable, more: tuple[StructField, ...] = ()) -> DataFrame:
    """Pairs that choose(p, q, coordinates of both) gives as places in p and in q, distances and values of `more`, with columns of both."""
    names = [[c for c in df.columns if carry is None or c in carry] for df in (a, b)]
    schema = StructType([*[StructField(f"{c}_{e}", df.schema[c].dataType) for df, some, e in zip((a, b), names, "ab") for c in some], StructField("d", DoubleType()), *more])

    def work(p: pa.Table, q: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = [[t.column(c).combine_chunks() for c in some] for t, some in zip((p, q), names)]
        held, n = [], 0
        for got in choose(p, q, _at(p, axes), _at(q, axes)):
            held.append(got)
            n += len(got[0])
            if n > 1 << 17:
                yield made(whole, held)
                held, n = [], 0
        if n:
            yield made(whole, held)

    def made(whole: list[list[pa.Array]], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        i, j, *rest = (pa.array(np.concatenate(x)) for x in zip(*held))
        return pa.RecordBatch.from_arrays([*[c.take(i) for c in whole[0]], *[c.take(j) for c in whole[1]], *rest], schema.names)

    return meet(a, b, r, axes, work, schema)


def within_distance(a: DataFrame, b: DataFrame, r: float, axes: str = "xyz", carry: tuple[str, ...] | None = None) -> DataFrame:
    """All pairs closer than r: a's columns (or those of carry) with the suffix _a, b's with _b, and d."""
    def choose(p, q, x, y):
        for rows, cols, far, on in _close(x, y, r):
            k, n = np.nonzero(on)
            yield rows[k], cols[n], far[k, n]

    return _paired(a, b, r, axes, carry, choose)


def self_pairs(df: DataFrame, r: float, axes: str = "xyz", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Each two rows of df with different row_ids closer than r once, one with the suffix _a and the other with _b (which is which is open), and d."""
    def choose(p, q, x, y):
        one, two = p.column("row_id").to_numpy(), q.column("row_id").to_numpy()
        for rows, cols, far, on in _close(x, y, r, True):
            k, n = np.nonzero(on)
            i, j = rows[k], cols[n]
            first = (x[0][i] < y[0][j]) & (one[i] != two[j]) | (x[0][i] == y[0][j]) & (one[i] < two[j])
            yield i[first], j[first], far[k[first], n[first]]

    return _paired(df, df, r, axes, carry, choose)


def nearest_pairs(a: DataFrame, b: DataFrame, n: int, r: float, axes: str = "xyz", where: Callable[..., np.ndarray] | None = None, sectors: int = 0, skip_own: bool = False, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Of all pairs closer than r (with sectors: in each azimuth sector of a row, which is added) the n nearest of each row of a, ties to b's smaller row_id; with rank.

    where gets b's places less a's by axis, as matrices; skip_own leaves out pairs with the same row_id."""
    once = Window.partitionBy(*axes).orderBy("row_id")  # of rows at one place only those with the least row_ids can be among the nearest
    b = b.withColumn("_r", F.row_number().over(once)).where(F.col("_r") <= n + skip_own).drop("_r")

    def choose(p, q, x, y):
        one, two = p.column("row_id").to_numpy(), q.column("row_id").to_numpy()
        for rows, cols, far, on in _close(x, y, r):
            if where or sectors:
                move = [v[cols] - u[rows, None] for u, v in zip(x, y)]
            if where:
                on &= where(*move)
            if skip_own:
                on &= one[rows, None] != two[cols]
            sector = np.zeros(on.shape, np.int32) if sectors else None
            if sectors:
                degrees = np.degrees(np.arctan2(move[0][on], move[1][on]))
                sector[on] = np.minimum(np.floor(np.where(degrees < 0, degrees + 360, degrees) / (360 / sectors)), sectors - 1)
            for s in range(max(1, sectors)):
                of = on & (sector == s) if sectors else on
                if len(cols) > n:
                    d = np.where(of, far, np.inf)
                    of = of & (d <= np.partition(d, n - 1, 1)[:, n - 1 : n])
                k, c = np.nonzero(of)
                order = np.lexsort((two[cols[c]], far[k, c], k))
                k, c = k[order], c[order]
                top = np.arange(len(k)) - np.searchsorted(k, k) < n
                k, c = k[top], c[top]
                yield (rows[k], cols[c], far[k, c], *([np.full(len(k), s, np.int32)] if sectors else []))

    some = _paired(a, b, r, axes, carry, choose, (StructField("sector", IntegerType()),) if sectors else ())
    by = Window.partitionBy("row_id_a", *["sector"] * bool(sectors)).orderBy("d", "row_id_b")
    return some.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)  # of parts of tiles


def nearest(pairs: DataFrame, n: int, least: int = 0) -> DataFrame:
    """The n nearest of each row_id_a, ties to the smaller row_id_b; none for those with fewer than least."""
    w = Window.partitionBy("row_id_a")
    out = pairs.withColumn("rank", F.row_number().over(w.orderBy("d", "row_id_b"))).where(F.col("rank") <= n)
    return out.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_n") if least else out


def _met_by_group(n: int, radius: float, axes: str, group: list[str], skip_own: bool, chunk: int, names: list[str], fields: list[str]):
    """Rows of targets with their n nearest, from rows sorted by group (its targets, then its samples by row_id), `chunk` at a time.

    Of a group that goes on, its targets and those samples that are among the nearest of some target so far are held."""
    def tops(t: pa.Table, more: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        at = [t.column(f"_at_{x}").to_numpy() for x in axes]
        ids, sample, level = t.column("_id").to_numpy(), t.column("_sample").to_numpy(), t.column("_level").to_numpy()
        new = np.ones(t.num_rows, bool)
        new[1:] = reduce(np.logical_or, [(v[1:] != v[:-1]) for v in (t.column(k).to_numpy() for k in group)])
        start = np.append(np.flatnonzero(new), t.num_rows)
        one, two, far, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
        for low, high in zip(start[:-1].tolist(), start[1:].tolist()):
            first, last = low + int(np.searchsorted(sample[low:high], 1)), len(one)
            most = radius * (1 + 1e-6) / 2.0 ** int(level[low]) if level[low] else radius
            step = max(1, (1 << 20) // max(1, high - first))
            for i in range(low, first if high > first else low, step):
                rows = slice(i, min(i + step, first))
                d = np.sqrt(reduce(lambda s, x: s + (x[rows, None] - x[None, first:high]) ** 2, at, 0.0))
                on = (d < radius) & (d <= most)
                if skip_own:
                    on &= ids[rows, None] != ids[None, first:high]
                if high - first > n:
                    d[~on] = np.inf
                    on &= d <= np.partition(d, n - 1, 1)[:, n - 1 : n]
                r, c = np.nonzero(on)
                order = np.lexsort((d[r, c], r))  # stable, so ties are by row_id
                order = order[np.arange(len(r)) - np.searchsorted(r, r) < n]
                one.append(i + r[order])
                two.append(first + c[order])
                far.append(d[r[order], c[order]])
        held = t.slice(0, 0)
        if more:
            low = int(start[-2])
            first = low + int(np.searchsorted(sample[low:], 1))
            held = t.take(np.concatenate([np.arange(low, first), np.unique(np.concatenate([np.zeros(0, np.int64), *two[last:]]))]))
            one, two, far = one[:last], two[:last], far[:last]
        one, two, far = np.concatenate(one), np.concatenate(two), np.concatenate(far)
        if not len(one):
            return None, held
        begin = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        whole = lambda c: pa.concat_arrays(t.column(c).chunks)
        near = pa.StructArray.from_arrays([pa.array(far), *whole("_b").take(pa.array(two)).flatten()], fields)
        near = pa.ListArray.from_arrays(pa.array(np.append(begin, len(one)), pa.int32()), near)
        return pa.RecordBatch.from_arrays([*whole("_a").take(pa.array(one[begin])).flatten(), near], names), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for i in range(0, b.num_rows, chunk):
                part = pa.Table.from_batches([b.slice(i, chunk)])
                out, held = tops(pa.concat_tables([held, part]) if held is not None else part, True)
                if out is not None:
                    yield out
        if held is not None:
            out, _ = tops(held, False)
            if out is not None:
                yield out

    return run


def nearest_lists(a: DataFrame, b: DataFrame, n: int, radius: float, axes: str = "xy", skip_own: bool = False, chunk: int = 10_000, crowded: int = 2000) -> DataFrame:
    """a's columns and near: the n nearest rows of b closer than radius as an array of structs (d, row_id, b's other columns).

    Ties go to the smaller row_id; skip_own leaves out rows of b with the target's row_id; targets without a row have none.
    Buckets halve from the radius on: a target asks around its smallest bucket that holds n rows, as these show that its
    n nearest are no farther than that bucket's diagonal; so what it meets grows with n and not with the density of b.
    The targets of a bucket and the rows around it are sorted to one place and meet in numpy, `chunk` rows at a time.
    Joins are merged, since Spark takes exploded buckets for as small as what they are made from and would send them through the driver."""
    keys, need, edge = [f"_{x}" for x in axes], n + skip_own, radius / math.sqrt(len(axes)) * (1 + 1e-9)
    finite = reduce(lambda p, x: p & (F.abs(x) < math.inf), axes, F.lit(True))
    a, b = a.where(finite), b.where(finite)
    once = Window.partitionBy(*axes).orderBy("row_id")  # of rows at one place only those with the least row_ids can be among the nearest
    b = b.withColumn("_r", F.row_number().over(once)).where(F.col("_r") <= need).drop("_r")
    box = b.agg(F.count(F.lit(1)), *[F.max(x) - F.min(x) for x in axes]).first()  # one row
    sides = [x or 0.0 for x in box[1:]]
    filled = lambda k: box[0] / math.prod(max(1.0, side * 2.0**k / edge) for side in sides)  # rows in a bucket, if spread evenly
    first = next((k for k in range(1, 40) if edge / 2**k < max(sides)), 1)
    deep = next((k for k in range(first, 40) if filled(k) < need), first) + 2
    levels = [0, *range(first, deep + 1)]
    fine = lambda df: df.withColumns({f"_{x}": F.floor(F.col(x) / edge * 2.0**deep).cast("bigint") for x in axes})
    coarse = {k: F.expr(f"shiftright({k}, {deep} - _level)") for k in keys}
    at_levels = lambda df, which: df.withColumn("_level", F.explode(F.array(*map(F.lit, which))))

    full = at_levels(fine(b).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), levels[1:]).withColumns(coarse).groupBy("_level", *keys).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= need).drop("_n")
    homes = fine(a).groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    own = at_levels(homes, levels[1:]).select("_level", *keys, *[F.col(k).alias(f"_f{k}") for k in keys]).withColumns(coarse)
    served = own.join(full.hint("merge"), ["_level", *keys], "left_semi").groupBy(*[F.col(f"_f{k}").alias(k) for k in keys]).agg(F.max("_level").alias("_level"))
    placed = homes.join(served.hint("merge"), keys, "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
    crowd = F.sum("_t").over(Window.partitionBy("_level", *coarse.values()))  # a bucket with many targets is dealt out with copies of its lists
    placed = placed.select(*keys, "_level", F.ceil(crowd / crowded).cast("int").alias("_salts"))

    reach = math.ceil(math.sqrt(len(axes)))
    around = placed.withColumns(coarse).select("_level", "_salts", *keys).distinct().select("_level", "_salts", *[F.col(k).alias(f"_h{k}") for k in keys])
    for k in keys:
        around = around.withColumn(k, F.explode(F.sequence(F.col(f"_h{k}") - reach, F.col(f"_h{k}") + reach)))
    group, others = ["_level", *keys, "_salt"], [c for c in b.columns if c != "row_id"]
    place = lambda: [F.col(x).cast("double").alias(f"_at_{x}") for x in axes]
    met = at_levels(fine(b), levels).withColumns(coarse).join(around.hint("merge"), ["_level", *keys]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    met = met.select("_level", *[F.col(f"_h{k}").alias(k) for k in keys], "_salt", F.lit(1).alias("_sample"), F.col("row_id").alias("_id"), *place(), F.struct("row_id", *others).alias("_b"))
    asked = fine(a).join(placed.hint("merge"), keys).withColumns(coarse).withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.col("_salts")).cast("int"))
    asked = asked.select(*group, F.lit(0).alias("_sample"), F.col("row_id").alias("_id"), *place(), F.struct(*a.columns).alias("_a"))
    rows = asked.unionByName(met, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "_sample", "_id", "_b")
    near = StructType([StructField("d", DoubleType()), *met.schema["_b"].dataType.fields])
    schema = StructType([*a.schema.fields, StructField("near", ArrayType(near))])
    return rows.mapInArrow(_met_by_group(n, radius, axes, group, skip_own, chunk, schema.names, near.names), schema)


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint, where the session names a folder for these, so that no round plans those before it again."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def knn(a: DataFrame, b: DataFrame, n: int, radius: float, axes: str = "xyz", rounds: int = 8) -> DataFrame:
    """n nearest rows of b with another row_id; targets not served within radius are asked again with twice of it.

    After `rounds` rounds those left are asked with the diagonal of the box around all rows, so no target gets fewer rows than there are."""
    found, left, r, k = None, a, radius, 0
    need = min(n, max(0, b.count() - 1))
    real = [F.when(F.abs(x) < math.inf, F.col(x)) for x in axes]
    ends = a.select(*axes).unionByName(b.select(*axes)).agg(*[f(x) for x in real for f in (F.min, F.max)]).first()
    far = math.dist([x or 0.0 for x in ends[::2]], [x or 0.0 for x in ends[1::2]])
    while True:
        last = r > far
        got = nearest_pairs(left, b, n, r, axes, skip_own=True)
        done = got.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("row_id_a")))
        done = cut(done.where(F.col("_n") >= (0 if last else need)).drop("_n"))
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        left = cut(left.join(done.select(F.col("row_id_a").alias("row_id")).distinct(), "row_id", "left_anti"))
        if left.isEmpty():
            return found
        k += 1
        r = 2 * r if k < rounds else max(2 * r, 1.001 * far)


def thin_min_distance(pairs: DataFrame, least: float, axes: str = "xyz") -> DataFrame:
    """Of each row_id_a's rows those that a walk from the nearest on keeps: none nearer than `least` to one kept before.

    Ties in d go to the smaller row_id_b. Rounds in place of a walk: rows that no earlier row in reach can still block
    are settled together, and drop the later rows in their reach; as many rounds as the longest chain of blocks has links.
    Rows meet in buckets of edge `least` around a target, so only conflicts are made, not all pairs of a target."""
    place = [F.col(f"{x}_b") for x in axes]
    rows = pairs.select("row_id_a", "row_id_b", "d", *[p.alias(x) for p, x in zip(place, axes)])
    found = reduce(lambda df, x: df.withColumn(f"_{x}", F.explode(F.sequence(_bucket(x, least) - 1, _bucket(x, least) + 1))), axes, rows)
    late = found.select(F.col("row_id_a"), F.col("row_id_b").alias("q"), F.col("d").alias("dq"), *[F.col(x).alias(f"q{x}") for x in axes], *[f"_{x}" for x in axes])
    early = rows.select(F.col("row_id_a"), F.col("row_id_b").alias("p"), F.col("d").alias("dp"), *[F.col(x).alias(f"p{x}") for x in axes], *[_bucket(x, least).alias(f"_{x}") for x in axes])
    apart = sum(((F.col(f"p{x}") - F.col(f"q{x}")) ** 2 for x in axes), F.lit(0.0))
    met = early.join(late, ["row_id_a", *[f"_{x}" for x in axes]]).where((F.sqrt(apart) < least) & ((F.col("dp") < F.col("dq")) | ((F.col("dp") == F.col("dq")) & (F.col("p") < F.col("q")))))
    conflicts, dropped = cut(met.select("row_id_a", "p", "q")), []
    while not conflicts.isEmpty():
        blocked = conflicts.select("row_id_a", F.col("q").alias("p")).distinct()
        gone = cut(conflicts.join(blocked, ["row_id_a", "p"], "left_anti").select("row_id_a", "q").distinct())
        dropped.append(gone)
        conflicts = conflicts.join(gone, ["row_id_a", "q"], "left_anti").join(gone.withColumnRenamed("q", "p"), ["row_id_a", "p"], "left_anti")
        conflicts = cut(conflicts.select("row_id_a", "p", "q"))
    if not dropped:
        return pairs
    gone = reduce(DataFrame.unionByName, dropped).withColumnRenamed("q", "row_id_b")
    return pairs.join(gone, ["row_id_a", "row_id_b"], "left_anti").select(*pairs.columns)


def thin_neighbors(targets: DataFrame, samples: DataFrame, radius: float, least: float, axes: str = "xy") -> DataFrame:
    """row_id_a, row_id_b: what thin_min_distance keeps of the samples closer than radius to each target, without making the pairs.

    least is above 0, so of samples at one place only that with the least row_id can be kept, and the others go first.
    Targets meet in tiles of edge radius; a group holds its tile's targets and the places of the samples in the tiles around."""
    keys = [f"_{x}" for x in axes]
    finite = reduce(lambda p, x: p & (F.abs(x) < math.inf), axes, F.lit(True))
    places = samples.where(finite).groupBy(*axes).agg(F.min("row_id").alias("row_id")).select("row_id", *axes)
    tiled = targets.where(finite).select("row_id", *axes).withColumns({f"_{x}": _bucket(x, radius) for x in axes})
    around = reduce(lambda df, x: df.withColumn(f"_{x}", F.explode(F.sequence(_bucket(x, radius) - 1, _bucket(x, radius) + 1))), axes, places)

    def walk(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("row_id")  # so that a stable sort by distance has ties by row_id
        ids, at = known.column("row_id").to_numpy(), [known.column(x).to_numpy() for x in axes]
        far = lambda rows, place: np.sqrt(sum((a[rows] - p) ** 2 for a, p in zip(at, place)))
        one, two = [], []
        for target, *place in zip(asked.column("row_id").to_pylist(), *(asked.column(x).to_pylist() for x in axes)):
            d = far(slice(None), place)
            left = np.flatnonzero(d < radius)
            left = left[np.argsort(d[left], kind="stable")]
            while len(left):
                one.append(target)
                two.append(ids[left[0]])
                left = left[far(left, [a[left[0]] for a in at]) >= least]
        return pa.table({"row_id_a": pa.array(one, pa.int64()), "row_id_b": pa.array(two, pa.int64())})

    return tiled.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInArrow(walk, "row_id_a bigint, row_id_b bigint")


def in_ellipsoid(dx: Column, dy: Column, dz: Column, ranges: tuple[float, float, float]) -> Column:
    return (dx / ranges[0]) ** 2 + (dy / ranges[1]) ** 2 + (dz / ranges[2]) ** 2 <= 1


def in_shell(dx: Column, dy: Column, dz: Column, inner: float, outer: float) -> Column:
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    return (d > inner) & (d <= outer)


def in_annulus(dx: Column, dy: Column, inner: float, outer: float) -> Column:
    return in_shell(dx, dy, F.lit(0.0), inner, outer)


def in_washer(dx: Column, dy: Column, dz: Column, inner: float, outer: float, thickness: float) -> Column:
    return in_annulus(dx, dy, inner, outer) & (F.abs(dz) <= thickness / 2)


def in_vertical_dumbbell(dx: Column, dy: Column, dz: Column, radius: float, height: float, separation: float) -> Column:
    """Both cylinders and the space between them."""
    return (dx * dx + dy * dy <= radius * radius) & (F.abs(dz) <= height + separation / 2)


def in_rotated_ellipsoid(dx: Column, dy: Column, dz: Column, shape: Structure) -> Column:
    """The ellipsoid with the ranges and angles of a structure; its border is inside, also where turning rounds up."""
    return anisotropic_h(dx, dy, dz, shape) <= 1 + 1e-12


def in_stratigraphic_annulus(dx: Column, dy: Column, k_a: Column, k_b: Column, inner: float, outer: float) -> Column:
    """In the annulus and in the same layer."""
    return in_annulus(dx, dy, inner, outer) & (k_a == k_b)


def sector_neighbors(pairs: DataFrame, sectors: int, n_max: int, per_sector_min: int = 0, per_sector_max: int = 1 << 30) -> DataFrame:
    """Round robin by azimuth sector: nearest of each first; a sector below its minimum empties the target.

    pairs may have their sector, as those of nearest_pairs have."""
    a = F.degrees(F.atan2(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")))
    sector = F.least(F.floor(F.when(a < 0, a + 360).otherwise(a) / (360 / sectors)), F.lit(sectors - 1)).cast("int")
    rows = pairs if "sector" in pairs.columns else pairs.withColumn("sector", sector)
    rows = rows.withColumn("in_sector", F.row_number().over(Window.partitionBy("row_id_a", "sector").orderBy("d", "row_id_b"))).where(F.col("in_sector") <= per_sector_max)
    if per_sector_min:
        full = rows.where(F.col("in_sector") == per_sector_min).groupBy("row_id_a").count().where(F.col("count") == sectors)
        rows = rows.join(full.select("row_id_a"), "row_id_a", "left_semi")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("row_id_a").orderBy("in_sector", "sector"))).where(F.col("rank") <= n_max)


def in_box(points: DataFrame, boxes: DataFrame, size: float, axes: str = "xy") -> DataFrame:
    """Pairs of points and boxes(box, low_x, high_x, ...) that hold them, ends included.

    Points go to their tile of that size, boxes to the tiles they meet."""
    left = points.withColumns({f"_{c}": _bucket(c, size) for c in axes})
    right = boxes
    for c in axes:
        right = right.withColumn(f"_{c}", F.explode(F.sequence(_bucket(f"low_{c}", size), _bucket(f"high_{c}", size))))
    inside = reduce(lambda p, c: p & F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}")), axes, F.lit(True))
    return left.join(right, [f"_{c}" for c in axes]).where(inside).drop(*[f"_{c}" for c in axes])


def close_samples(points: DataFrame, r: float, axes: str = "xy", most: int = 500) -> DataFrame:
    """row_id_a < row_id_b, d of each two points closer than r: of pairs of places, each with lists of up to some `most` row_ids, dealt out before they are spread."""
    finite = reduce(lambda p, x: p & (F.abs(x) < math.inf), axes, F.lit(True))
    rows = points.where(finite).select("row_id", *axes)
    places = rows.groupBy(*axes).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("_n") / most)).cast("int").alias("_part")
    lists = rows.join(places.withColumnRenamed("row_id", "_p"), list(axes)).groupBy("_p", part).agg(F.collect_list("row_id").alias("_ids"))
    same = places.where((F.col("_n") > 1) & F.lit(r > 0)).select(F.col("row_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"), F.lit(0.0).alias("d"))
    pairs = self_pairs(places, r, axes, ("row_id",)).unionByName(same)
    for e in "ab":
        some = lists.select(F.col("_p").alias(f"row_id_{e}"), F.col("_part").alias(f"_part_{e}"), F.col("_ids").alias(f"_ids_{e}"))
        pairs = pairs.join(some.hint("merge"), f"row_id_{e}")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the lists are few bytes and many pairs
    dealt = pairs.repartition(n, "row_id_a", "row_id_b", "_part_a", "_part_b")
    spread = dealt.select((F.col("row_id_a") == F.col("row_id_b")).alias("_same"), "d", F.explode("_ids_a").alias("_i"), "_ids_b").select("_same", "d", "_i", F.explode("_ids_b").alias("_j"))
    spread = spread.where(F.when(F.col("_same"), F.col("_i") < F.col("_j")).otherwise(F.col("_i") != F.col("_j")))
    return spread.select(F.least("_i", "_j").alias("row_id_a"), F.greatest("_i", "_j").alias("row_id_b"), "d")


def cell_of(spec: GridSpec, df: DataFrame) -> DataFrame:
    """Adds i, j, k of the cell that holds x, y, z; null outside the grid."""
    out = {}
    for c, axis, o, d, n in (("i", "x", spec.x0, spec.dx, spec.nx), ("j", "y", spec.y0, spec.dy, spec.ny), ("k", "z", spec.z0, spec.dz, spec.nz)):
        at = F.lit(0) if c == "k" and spec.nz == 1 else F.floor((F.col(axis) - o) / d)
        out[c] = F.when((at >= 0) & (at < n), at).cast("int")
    return df.withColumns(out)


def center_of(spec: GridSpec, df: DataFrame) -> DataFrame:
    return df.withColumns({"x": spec.x0 + (F.col("i") + 0.5) * spec.dx, "y": spec.y0 + (F.col("j") + 0.5) * spec.dy, "z": spec.z0 + (F.col("k") + 0.5) * spec.dz if spec.nz > 1 else F.lit(0.0)})


def collocate_grid_to_points(points: DataFrame, grid: DataFrame, spec: GridSpec, value: str) -> DataFrame:
    return cell_of(spec, points).join(grid.select("i", "j", "k", F.col(value).alias("cell_value")), ["i", "j", "k"], "left")


def collocate_grid_to_grid(target: DataFrame, target_spec: GridSpec, source: DataFrame, source_spec: GridSpec, value: str) -> DataFrame:
    """target with the source's value at the center of each of its cells; null outside the source."""
    at = center_of(target_spec, target).withColumnsRenamed({c: f"_{c}" for c in "ijk"})
    out = cell_of(source_spec, at).join(source.select("i", "j", "k", F.col(value).alias("source_value")), ["i", "j", "k"], "left")
    return out.drop("i", "j", "k", "x", "y", "z").withColumnsRenamed({f"_{c}": c for c in "ijk"})


def grid_to_points(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """Points at the cell centers."""
    return center_of(spec, grid).drop("i", "j", "k")


def repositioned(spec: GridSpec, cells: tuple[tuple[int, int], tuple[int, int]], places: tuple[tuple[float, float], tuple[float, float]]) -> GridSpec:
    """spec with the origin and cell sizes that put the centers of two cells (i, j) at two places (x, y)."""
    (i0, j0), (i1, j1) = cells
    (xa, ya), (xb, yb) = places
    dx, dy = (xb - xa) / (i1 - i0), (yb - ya) / (j1 - j0)
    return replace(spec, dx=dx, dy=dy, x0=xa - (i0 + 0.5) * dx, y0=ya - (j0 + 0.5) * dy)


def collocate_points_to_grid(points: DataFrame, grid: DataFrame, spec: GridSpec, value: str) -> DataFrame:
    """Last sample by row_id wins in a cell; cells without one have null."""
    last = cell_of(spec, points).where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL").groupBy("i", "j", "k").agg(F.max_by(value, "row_id").alias("point_value"))
    return grid.join(last, ["i", "j", "k"], "left")


def variogram_points(df: DataFrame, head: str, tail: str, lag: float, lags: int, azimuth: float | None = None, tolerance: float = 22.5, axes: str = "xy") -> DataFrame:
    """lag, n, h, gamma, head, tail: experimental (cross) semivariogram; lag b holds distances in [b lag, (b + 1) lag).

    Rows at one place go as their sums, since all of them are as far from any other place."""
    known = df.where(F.col(head).isNotNull() & F.col(tail).isNotNull()).select(*axes, F.col(head).cast("double").alias("_u"), F.col(tail).cast("double").alias("_v"))
    mid = known.agg(F.avg("_u"), F.avg("_v")).first()  # one row; sums of what is left of the means lose fewer digits
    u, v = (F.col(c) - F.lit(m or 0.0) for c, m in zip(("_u", "_v"), mid))
    places = known.groupBy(*axes).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(u).alias("u"), F.sum(v).alias("v"), F.sum(u * v).alias("uv"))
    schema = StructType([StructField("lag", IntegerType()), StructField("n", LongType()), StructField("h", DoubleType()), StructField("g", DoubleType())])

    def work(p: pa.Table, q: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = _at(p, axes), _at(q, axes)
        one, two = _at(p, ("n", "u", "v", "uv")), _at(q, ("n", "u", "v", "uv"))
        total = np.zeros((3, lags + 1))
        for rows, cols, far, on in _close(x, y, lag * lags, True):
            on &= far > 0
            if azimuth is not None:
                dx, dy = x[0][rows, None] - y[0][cols], x[1][rows, None] - y[1][cols]
                on &= np.abs(dx * math.sin(math.radians(azimuth)) + dy * math.cos(math.radians(azimuth))) >= np.sqrt(dx * dx + dy * dy) * math.cos(math.radians(tolerance))
            k, c = np.nonzero(on)
            i, j, d = rows[k], cols[c], far[k, c]
            first = reduce(lambda later, v: (v[0][i] < v[1][j]) | (v[0][i] == v[1][j]) & later, list(zip(x, y))[::-1], np.zeros(len(i), bool))
            i, j, d = i[first], j[first], d[first]
            at = (d / lag).astype(np.int64)
            n = one[0][i] * two[0][j]
            half = (one[0][i] * two[3][j] + two[0][j] * one[3][i] - one[1][i] * two[2][j] - one[2][i] * two[1][j]) / 2
            total += [np.bincount(at, w, lags + 1) for w in (n, n * d, half)]
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at].astype(np.int64)), pa.array(total[1][at]), pa.array(total[2][at])], schema.names)

    sums = meet(places, places, lag * lags, axes, work, schema).groupBy("lag").agg(*[F.sum(c).alias(c) for c in ("n", "h", "g")])
    return sums.select("lag", "n", (F.col("h") / F.col("n")).alias("h"), (F.col("g") / F.col("n")).alias("gamma"))


def variogram_grid(grid: DataFrame, value: str, steps: list[tuple[int, int]], lags: int, by: tuple[str, ...] = ()) -> DataFrame:
    """dir, lag, n, gamma: pairs of cells at lag times each step.

    The cells that a step links form lines; each direction is one shuffle by its lines, and all lags are frames of one window."""
    rows, out = grid.where(F.col(value).isNotNull()).select(*by, "i", "j", F.col(value).alias("u")), []
    for number, (a, b) in enumerate(steps):
        a, b = (a, b) if (a, b) > (0, 0) else (-a, -b)  # the opposite step has the same pairs
        along, size = ("i", a) if a else ("j", b)
        lines = rows.withColumns({"_l": F.lit(b) * F.col("i") - F.lit(a) * F.col("j"), "_m": F.pmod(F.col(along), F.lit(size)), "_p": F.floor(F.col(along) / size)})
        w = Window.partitionBy(*by, "_l", "_m").orderBy("_p")
        met = lines.select(*by, *[((F.max("u").over(w.rangeBetween(k, k)) - F.col("u")) ** 2 / 2).alias(f"_{k}") for k in range(1, lags + 1)])
        sums = met.groupBy(*by).agg(*[f(f"_{k}").alias(f"_{n}{k}") for k in range(1, lags + 1) for n, f in (("n", F.count), ("g", F.avg))])
        each = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_n{k}").alias("n"), F.col(f"_g{k}").alias("gamma")) for k in range(1, lags + 1)])
        out.append(sums.select(*by, F.lit(number).alias("dir"), F.explode(each).alias("_s")).select(*by, "dir", "_s.*").where("n > 0"))
    return reduce(DataFrame.unionByName, out)


def contact_analysis(df: DataFrame, domain: str, grade: str, d1: int, d2: int, lag: float, lags: int, axes: str = "xyz") -> DataFrame:
    """side, lag, n, mean: mean grade by the distance to the nearest sample of the other domain; lag k holds ((k - 1) lag, k lag].

    A sample at the place of one of the other domain has distance 0, which no lag holds."""
    reach = lag * lags * (1 + 1e-9)
    one, two = (df.where(F.col(domain) == d).select("row_id", *axes, grade) for d in (d1, d2))
    sides = [nearest_lists(a, b.select("row_id", *axes), 1, reach, axes).select(F.lit(n).alias("side"), F.col("near")[0]["d"].alias("d"), F.col(grade).alias("g")) for n, (a, b) in enumerate(((one, two), (two, one)))]
    near = sides[0].unionByName(sides[1]).where((F.col("d") > 0) & (F.col("d") <= lag * lags))
    return near.groupBy("side", F.ceil(F.col("d") / lag).cast("int").alias("lag")).agg(F.count("g").alias("n"), F.avg("g").alias("mean"))


def shepard(targets: DataFrame, samples: DataFrame, value: str, r: float, power: float = 2.0, axes: str = "xy") -> DataFrame:
    """row_id, estimate: inverse distance weights of the samples closer than r; a sample at distance 0 is exact.

    Samples at one place go as their sum, and targets at one place share their estimate."""
    places = samples.where(F.col(value).isNotNull()).groupBy(*axes).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(value).cast("double")).alias("s"))
    asked, sums = targets.select(*axes).distinct(), ["n0", "s0", "w", "ws"]  # of samples at distance 0, and of weights
    schema = StructType([StructField(c, DoubleType()) for c in (*axes, *sums)])

    def work(p: pa.Table, q: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = _at(p, axes), _at(q, axes)
        n, s = _at(q, ("n", "s"))
        total, plain = np.zeros((4, p.num_rows)), np.isfinite(s).all()
        weighted = lambda w, v: w @ v if plain else np.where(w > 0, w * v, 0).sum(1)
        for rows, cols, far, on in _close(x, y, r):
            same = on & (far == 0)
            w = np.where(on & ~same, far, np.inf)
            w = 1 / (w * w) if power == 2 else w**-power
            total[2:, rows] = w @ n[cols], weighted(w, s[cols])
            if same.any():
                total[:2, rows] = same @ n[cols], weighted(same.astype(float), s[cols])
        on = (total[0] > 0) | (total[2] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(v[on]) for v in (*x, *total)], schema.names)

    found = meet(asked, places, r, axes, work, schema).groupBy(*axes).agg(*[F.sum(c).alias(c) for c in sums])
    made = found.select(*axes, F.when(F.col("n0") > 0, F.col("s0") / F.col("n0")).otherwise(F.col("ws") / F.col("w")).alias("estimate"))
    return targets.select("row_id", *axes).join(made, list(axes)).select("row_id", "estimate")


def _gamma_np(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray, model: VariogramModel) -> np.ndarray:
    total = np.full(np.broadcast(dx, dy, dz).shape, model.nugget)
    for s in model.structures:
        a, b, c = (math.radians(v) for v in (90 - s.azimuth, -s.dip, s.roll))
        turn = np.array([[1, 0, 0], [0, math.cos(c), math.sin(c)], [0, -math.sin(c), math.cos(c)]]) @ np.array([[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]]) @ np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
        v = np.stack([dx, dy, dz], -1) @ turn.T / np.array(s.ranges)
        h = np.sqrt((v * v).sum(-1))
        total = total + s.sill * {"spherical": lambda h: np.where(h >= 1, 1.0, 1.5 * h - 0.5 * h**3), "exponential": lambda h: 1 - np.exp(-3 * h), "gaussian": lambda h: 1 - np.exp(-9 * h * h), "power": lambda h, r=s.ranges[0]: (h * r) ** 1.5, "hole": lambda h: 1 - np.cos(np.pi * h)}[s.kind](h)
    return np.where((dx == 0) & (dy == 0) & (dz == 0), 0.0, total)


def krige(targets: DataFrame, samples: DataFrame, value: str, model: VariogramModel, radius: float, n_max: int = 8, n_min: int = 1, mean: float | None = None, leave_out_self: bool = False, axes: str = "xy", drift: tuple[str, ...] = (), also: tuple[str, ...] = (), part: VariogramModel | None = None, total: float = 1.0) -> DataFrame:
    """row_id, estimate, variance, n: ordinary kriging, or simple kriging with that mean, from the n_max nearest samples.

    With drift, columns of both tables (a trend's terms, an external drift), their weighted sums over the samples
    are those at the target. With also, other columns of the samples get estimates by the same weights, in the array `also`.
    With part, ordinary kriging of a part of the model: covariances with the target are those of part, weights add up to total.

    Neighbors come from nearest_lists; each target's few neighbors are one row, and rows with equally many
    are solved together."""
    cols, asked = [c for c in "xyz" if c in targets.columns], part or model
    known = samples.where(F.col(value).isNotNull()).select("row_id", *cols, *dict.fromkeys((value, *drift, *also)))
    lists = nearest_lists(targets.select("row_id", *cols, *drift), known, n_max, radius, axes, leave_out_self).where(F.size("near") >= n_min)
    doubles = lambda values: F.array(*[v.cast("double") for v in values]).cast("array<double>")

    def sample(e: Column, place: Column) -> Column:
        move = [(e[c] - F.col(c) if c in cols else F.lit(0.0)).alias(f"d{c}") for c in "xyz"]
        return F.struct((place + 1).alias("rank"), *move, doubles(e[c] for c in (value, *also)).alias("v"), doubles(e[c] for c in drift).alias("f"))

    rows = lists.select("row_id", F.transform("near", sample).alias("s"), doubles(F.col(c) for c in drift).alias("at"))  # n_max at most

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, s = b.column("row_id").to_numpy(), b.column("s")
            flat, to = s.flatten(), s.offsets.to_numpy() - s.offsets[0].as_py()
            d = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3)], -1)
            many = lambda x, width: x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            v, n = many(flat.field(4), 1 + len(also)), np.diff(to)
            f, at = (many(flat.field(5), len(drift)), many(b.column("at"), len(drift))) if drift else (np.zeros((len(v), 0)), np.zeros((len(n), 0)))
            estimate, variance = np.empty((len(n), 1 + len(also))), np.empty(len(n))
            for m in np.unique(n):
                t = np.flatnonzero(n == m)
                p, u = d[to[t][:, None] + np.arange(m)], v[to[t][:, None] + np.arange(m)]
                q = p[:, :, None] - p[:, None]
                c = model.sill - _gamma_np(q[..., 0], q[..., 1], q[..., 2], model)
                c0 = asked.sill - _gamma_np(p[..., 0], p[..., 1], p[..., 2], asked)
                if mean is None:
                    g = f[to[t][:, None] + np.arange(m)]
                    a = np.zeros((len(t), m + 1 + len(drift), m + 1 + len(drift)))
                    a[:, :m, :m], a[:, :m, m], a[:, m, :m] = c, 1, 1
                    a[:, :m, m + 1 :], a[:, m + 1 :, :m] = g, g.transpose(0, 2, 1)
                    r = np.concatenate([c0, np.full((len(t), 1), total), at[t]], 1)
                else:
                    a, r = c, c0
                try:
                    w = np.linalg.solve(a, r[..., None])[..., 0]
                except np.linalg.LinAlgError:  # coincident samples
                    w = np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, r)])
                estimate[t] = (w[:, :m, None] * u).sum(1) if mean is None else mean + (w[:, :, None] * (u - mean)).sum(1)
                variance[t] = asked.sill - (w * r).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(estimate[:, 0]), pa.array(variance), pa.array(n.astype(np.int32)), pa.array(list(estimate[:, 1:]), pa.list_(pa.float64()))][: 4 + bool(also)], ["row_id", "estimate", "variance", "n", "also"][: 4 + bool(also)])

    return rows.mapInArrow(solve, "row_id bigint, estimate double, variance double, n int" + ", also array<double>" * bool(also))


def factorial_krige(targets: DataFrame, samples: DataFrame, value: str, model: VariogramModel, factor: int, radius: float, n_max: int = 8, n_min: int = 1, axes: str = "xy") -> DataFrame:
    """row_id, estimate, variance, n of a factor: 0 is the nugget, k the k-th structure, -1 the local mean.

    All factors and the local mean add up to the ordinary kriging estimate."""
    if factor < 0:
        part, total = VariogramModel(0.0, ()), 1.0
    else:
        part, total = (VariogramModel(model.nugget, ()) if factor == 0 else VariogramModel(0.0, (model.structures[factor - 1],))), 0.0
    return krige(targets, samples, value, model, radius, n_max, n_min, axes=axes, part=part, total=total)


def indicator_krige(targets: DataFrame, samples: DataFrame, value: str, thresholds: list[float], model: VariogramModel, radius: float, n_max: int = 8, n_min: int = 1, axes: str = "xy") -> DataFrame:
    """row_id, p0, p1, ...: probabilities that the value is at most each threshold, between 0 and 1 and never falling.

    All thresholds share the neighbors and the model, so one solve serves them; order relations are mended by running maxima."""
    names = [f"p{i}" for i in range(len(thresholds))]
    rows = samples.where(F.col(value).isNotNull()).withColumns({c: F.when(F.col(value) <= t, 1.0).otherwise(0.0) for c, t in zip(names, thresholds)})
    out = krige(targets, rows, names[0], model, radius, n_max, n_min, axes=axes, also=tuple(names[1:]))
    top, mended = F.lit(0.0), []
    for i, c in enumerate(names):
        top = F.greatest(top, F.least(F.col("also")[i - 1] if i else F.col("estimate"), F.lit(1.0)))
        mended.append(top.alias(c))
    return out.select("row_id", *mended)


def fill_nulls_kriging(grid: DataFrame, value: str, model: VariogramModel, radius: float, n_max: int = 8, n_min: int = 1, default: float | None = None) -> DataFrame:
    """Adds filled: the value, or in null cells the estimate from the nearest cells within radius (in cells), or the default."""
    cells = grid.select(F.col("cell").alias("row_id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), value)
    made = krige(cells.where(F.col(value).isNull()).drop(value), cells, value, model, radius, n_max, n_min, axes="xy")
    return grid.join(made.select(F.col("row_id").alias("cell"), "estimate"), "cell", "left").withColumn("filled", F.coalesce(value, "estimate", F.lit(default))).drop("estimate")


def is_lmc(first: VariogramModel, second: VariogramModel, cross: VariogramModel) -> bool:
    """Whether three models may stand together as a linear model of coregionalization."""
    models = (first, second, cross)
    if any(s.kind == "power" for m in models for s in m.structures):
        return False
    shape = [[(s.kind, s.azimuth, s.dip, s.roll, s.ranges) for s in m.structures] for m in models]
    parts = [[m.nugget, *(s.sill for s in m.structures)] for m in models]
    return shape[0] == shape[1] == shape[2] and min(parts[0] + parts[1]) > 0 and all(a * b > c * c for a, b, c in zip(*parts))


def model_surface(grid: DataFrame, model: VariogramModel) -> DataFrame:
    return grid.withColumn("gamma", gamma(F.col("x"), F.col("y"), F.col("z"), model))


def model_curve(model: VariogramModel, lags: DataFrame, azimuth: float = 0.0) -> DataFrame:
    """lags(h) with gamma at the distance h in that horizontal direction."""
    a = math.radians(azimuth)
    return lags.withColumn("gamma", gamma(F.col("h") * math.sin(a), F.col("h") * math.cos(a), F.lit(0.0), model))
