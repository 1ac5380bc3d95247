"""Line dedup: of lines within an edit distance of each other, the first one stays.

Segment-partition edit join. A line within `edits` edits of another holds at least one of the other's
edits + 1 even segments unchanged, near its place. Each distinct line of at least `min_chars` characters puts
its segments into an index keyed by (its length, segment number, hash), and probes, for its own and each
smaller length down to `edits` less, the substrings whose places are compatible with the edits to the left
and right of the segment. Keys that only one line has drop out in one sorted pass; lines that share a key
are compared: first by character histograms, then by edit distance (furthest reaching rows), vectorised over pairs.
Keys with many lines are compared in blocks paired with each other. Only a spanning star of each block's
matches leaves a task, and connected components over all stars make the classes of lines.

With `per`, a line may differ from a longer one by its length / per edits where these are more. The edits
leave a run of unchanged characters of a known length in such a line, wherever the edits are, and with it the
least GRAM hash of a window of that run; the index has these, keyed by length class and place, each line being in
the next class and step of places too where its edits reach them. Few lines with a key are compared as distinct pairs, many in blocks
as above (fewer and larger ones), without pairs that a block has joined already. With `exact`, lines below `min_chars` with a word go
where they equal an earlier line; without it they are never touched. The query and the pipeline use both.

Lines are what newlines separate, without ASCII white space at the ends; edits count code points. Of each
class the line with the least (doc_id, row, line number) stays, wherever it is. A null text stays null; a text
may lose all its lines and is then empty. Repeated rows: the repeats are equal lines at equal places, and share
one result: what the first of them keeps. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import components, discard, keep, local_components, low_bits, partitions, split_likely, table, whole_groups
from lithospark.llm.hashing import mix, powers, range_hash
from lithospark.llm.repeats import row_id, window_min

EDITS, MIN_CHARS, BUCKET, HOT = 2, 24, 1000, 1000
#: Most lines of a window key that stay in one block; of n times as many each is in the root of n blocks. All lines of a block, or of two, may be compared in one task.
BLOCK = 250
#: The same where lines are told apart by counts of their characters only.
MARKED = 2000
#: Characters to an edit; characters hashed together; most lines of a key that are compared as pairs.
PER, GRAM, FEW = 64, 20, 8
#: Characters of lines whose keys are made together, and of pairs whose distances are.
CHARACTERS = 1 << 18
#: Most edits of pairs whose distances are made together by furthest reaching rows.
RUNS = 200
#: Keys that a task packs at a time.
PACKED = 1 << 19
_CLASSES = np.unique((1.1 ** np.arange(1, 226)).astype(np.int64))
_STRIP = " \t\n\r\x0b\x0c"


def _hash(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _hashes(lines: list[str]) -> np.ndarray:
    """_hash of each line."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in lines), np.uint64, len(lines)).view(np.int64)


def _line_rows(min_chars: int):
    """rid, doc_id, line_no, h (hash of the stripped line) of the lines that count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, lines = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, x in enumerate((text or "").split("\n")):
                    if len(x := x.strip(_STRIP)) >= min_chars:
                        row.append(i)
                        number.append(k)
                        lines.append(x)
            at, h = pa.array(row, pa.int64()), _hashes(lines)
            yield pa.RecordBatch.from_arrays([b.column("rid").take(at), b.column("doc_id").take(at), pa.array(number, pa.int32()), pa.array(h, pa.int64())], ["rid", "doc_id", "line_no", "h"])

    return run


def line_places(docs: DataFrame, min_chars: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text IS NOT NULL").select(row_id().alias("rid"), "doc_id", "text").mapInArrow(_line_rows(min_chars), f"rid bigint, doc_id {kind}, line_no int, h bigint")


def segments(length: np.ndarray, parts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment k of lines of these lengths, cut as evenly as can be, the longer ones last."""
    short, longer = length // parts, length % parts
    size = short + (k >= parts - longer)
    start = k * short + np.maximum(0, k - (parts - longer))
    return start, size


def keys_of(texts: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the index (lowest bit 1) and the probes (lowest bit 0) of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    up, _ = powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x1234567)) * up[: len(codes)], out=prefix[1:])
    parts, out_line, out_key = edits + 1, [], []

    def add(on: np.ndarray, start: np.ndarray, n: np.ndarray, length: np.ndarray, k: int, kind: int) -> None:
        h = range_hash(prefix, begin[on] + start, begin[on] + start + n)
        h = mix(h + (length.astype(np.uint64) << np.uint64(8)) + np.uint64(k))
        out_line.append(on)
        out_key.append((h & ~np.uint64(1)) | np.uint64(kind))

    everything = np.arange(len(texts))
    for k in range(parts):
        start, n = segments(size, parts, k)
        on = everything[n > 0]
        add(on, start[on], n[on], size[on], k, 1)
        for less in range(edits + 1):
            start, n = segments(size - less, parts, k)
            for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                if less == 0 and shift == 0:
                    continue  # the index entry itself meets equal segments
                on = everything[(n > 0) & (start + shift >= 0) & (start + shift + n <= size) & (size > less)]
                add(on, start[on] + shift, n[on], size[on] - less, k, 0)
    return np.concatenate(out_line), np.concatenate(out_key).view(np.int64)


def allowed(size, edits: int, per: int):
    """Edits to a line of this length from a line that is as long or longer."""
    return np.maximum(edits, size // per) if per else edits + 0 * size


def grown_from(edits: int, per: int) -> int:
    """Length from which lines have more than `edits` edits."""
    return (edits + 1) * per


@functools.cache
def _tiers(per: int, least: int) -> list[tuple[int, int]]:
    """(first length class, window) of the tiers of lines of `least` characters and more.

    A line of n characters changed by k = n // per edits keeps a run of (n - k) / (k + 1) characters, which
    grows with k; a tier's window is the shortest such run of the lines that may meet others in its classes."""
    out = []
    for size in (least, 2 * least, 4 * least):
        first = int(np.searchsorted(_CLASSES, size, "right"))
        low = max(least, int(_CLASSES[first - 1]) * per // (per + 1))
        n = np.arange(low, low + 2 * per)
        out.append((first, int((-(-(n - n // per) // (n // per + 1))).min())))
    return out


def window_keys(texts: list[str], per: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the least hashes of the windows of each text; texts of at least `least` characters, by length.

    A key holds the hash, the length class and the place in the line in steps of 8 times the most edits of the
    class; what the edits may move into the next step has that step's key too."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(31)
    up, down = powers(len(codes) + 1)
    kind, next_kind = (np.searchsorted(_CLASSES, x, "right") for x in (size, size + size // per))
    step = 8 * np.maximum(1, (_CLASSES - 1) // per)
    tiers, out_line, out_key = _tiers(per, least), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for (first, run), end in zip(tiers, [*(x for x, _ in tiers[1:]), len(_CLASSES) + 1]):
        owns, meets = (kind >= first) & (kind < end), (next_kind != kind) & (next_kind >= first) & (next_kind < end)
        on = np.flatnonzero(owns | meets)  # lengths in a row
        if not len(on):
            continue
        gram, origin, stop = min(GRAM, run), begin[on[0]], begin[on[-1]] + size[on[-1]]
        if stop - origin < run:
            continue
        prefix = np.zeros(stop - origin + 1, np.uint64)
        np.cumsum(codes[origin:stop] * up[: stop - origin], out=prefix[1:])
        h = (prefix[gram:] - prefix[:-gram]) * down[: stop - origin - gram + 1]  # of each run of gram characters
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        # the first least hash of each window
        low = window_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), run - gram + 1)
        low = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.arange(len(low)) + run <= np.repeat(begin[on] + size[on] - origin, size[on])[: len(low)]
        low = low[inside]
        low = low[np.concatenate([[True], low[1:] != low[:-1]])] if len(low) else low
        line = on[np.searchsorted(begin[on] - origin, low, "right") - 1]
        place, h = low + origin - begin[line], h[low]
        for classes, some in ((kind, owns), (next_kind, meets)):
            some = np.flatnonzero(some[line])
            x, c = line[some], classes[line[some]]
            now, later = place[some] // step[c], (place[some] + size[x] // per) // step[c]
            for p, k in ((now, slice(None)), (later, np.flatnonzero(later != now))):
                key = mix(h[some][k] + ((c[k] << 40) + p[k]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                new = np.ones(len(key), bool)  # a line that repeats itself has one key
                new[1:] = (key[1:] != key[:-1]) | (x[k][1:] != x[k][:-1])
                out_line.append(x[k][new])
                out_key.append(key[new] | np.uint64(1))
    return np.concatenate(out_line), np.concatenate(out_key).view(np.int64)


def _key_rows(edits: int, min_chars: int, per: int = 0, windows: bool = False):
    """Keys of the segments of lines that have no more than `edits` edits, or of the windows of the others."""
    first = max(min_chars, grown_from(edits, per)) if windows else min_chars
    end = grown_from(edits, per) + edits if per and not windows else 1 << 40

    def keys(lines: set[str]) -> Iterator[pa.RecordBatch]:
        texts = sorted(lines, key=len)
        h = _hashes(texts)
        line, key = window_keys(texts, per, first) if windows else keys_of(texts, edits)
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(h[line[i : i + 100_000]])], ["key", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, held = set(), 0
            for text in b.column("text").to_pylist():
                for x in (text or "").split("\n"):
                    if first <= len(x := x.strip(_STRIP)) < end and x not in lines:
                        lines.add(x)
                        held += len(x)
                if held >= CHARACTERS:
                    yield from keys(lines)
                    lines, held = set(), 0
            if lines:
                yield from keys(lines)

    return run


def _packed(run, ranges: int):
    """(range, keys): the (key, h) rows that run makes, put together by ranges of buckets, as pairs of 64-bit numbers."""
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        to = ((rows[:, 0].view(np.uint64) >> np.uint64(1)) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(to.astype(np.uint16) if ranges <= 1 << 16 else to, kind="stable")  # of 16 bits by radix
        rows, to = rows[order], to[order]
        start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(to[start]), pa.array([x.tobytes() for x in np.split(rows, start[1:])], pa.binary())], ["range", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            if b.num_rows:
                held.append(np.stack([b.column("key").to_numpy(), b.column("h").to_numpy()], 1))
                n += b.num_rows
            if n >= PACKED:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return pack


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed keys, range after range: rows whose bucket (key without its lowest bit) has another line.

    Of a long range, the rows of buckets known to be shared leave at once, and may leave again if they come again;
    what stays is a line a bucket."""
    held, n, met, now = [], 0, np.zeros(0, np.int64), None

    def settle() -> pa.RecordBatch:
        nonlocal held, n, met
        rows = np.concatenate(held)
        k = np.ascontiguousarray(rows[:, 0])
        order = np.argsort(k)
        k, g = k[order], rows[order, 1]
        start = np.flatnonzero(np.concatenate([[True], (k[1:] >> 1) != (k[:-1] >> 1)]))
        many = (np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)) | np.isin(k[start] >> 1, met)
        met = np.union1d(met, k[start][many] >> 1)
        hit = np.repeat(many, np.diff(np.append(start, len(k))))
        alone = ~hit
        alone[1:] &= k[1:] != k[:-1]  # all of a bucket are the same line
        held, n = [np.stack([k[alone], g[alone]], 1)], 0
        k, g = k[hit], g[hit]
        order = np.lexsort((g, k))
        k, g = k[order], g[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        k, g = k[new], g[new]
        return pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(g), pa.array((k & 1).astype(bool))], ["bucket", "h", "index"])

    for b in batches:
        for to, keys in zip(b.column("range").to_pylist(), b.column("keys").to_pylist()):
            if to != now:
                if n:
                    yield settle()
                held, n, met, now = [], 0, met[:0], to
            held.append(np.frombuffer(keys, np.int64).reshape(-1, 2))
            n += len(held[-1])
            if n >= 2 * PACKED:
                yield settle()
    if n:
        yield settle()


def banded_distance(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Edit distances of the pairs (a[i], b[i]); edits + 1 if they are above edits."""
    return runs_distance([*a, *b], np.arange(len(a)), len(a) + np.arange(len(b)), np.full(len(a), edits))


def runs_distance(texts: list[str], a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs of texts with the numbers a[i] and b[i], which differ; edits[i] + 1 where they are above edits[i].

    By furthest reaching rows: after e edits a diagonal's row is the furthest of its neighbors' rows after e - 1, moved on
    over the equal characters that follow. These are found by hashes of 64, 32, ... characters, so equal stretches cost a few
    steps whatever their length. Diagonals from which the edits left don't lead to the end are left out."""
    size = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    codes = np.empty(int(size.sum()) + len(texts) + 64, np.uint64)
    codes[: len(codes) - 64] = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    codes[begin + size] = (1 << 32) + np.arange(len(texts), dtype=np.uint64)  # an end equals nothing
    codes[len(codes) - 64 :] = 1 << 33
    hashes = [mix(codes)]
    for p in range(6):
        h = hashes[-1].copy()
        h[: -(1 << p)] += mix(hashes[-1][1 << p :] + np.uint64(p + 1))
        hashes.append(mix(h))

    def moved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many characters from x and y on are equal."""
        out = np.zeros(len(x), np.int64)
        some = np.flatnonzero(hashes[0][x] == hashes[0][y])
        x, y, on = x[some], y[some], np.arange(len(some))
        start = x.copy()
        while len(on := on[hashes[6][x[on]] == hashes[6][y[on]]]):
            x[on] += 64
            y[on] += 64
        for p in range(5, -1, -1):
            step = (hashes[p][x] == hashes[p][y]).astype(np.int64) << p
            x += step
            y += step
        out[some] = x - start
        return out

    out, never = edits + 1, -(1 << 40)
    live = np.flatnonzero(np.abs(size[a] - size[b]) <= edits)
    n, m, at, to, k = (x[live] for x in (size[a], size[b], begin[a], begin[b], edits))
    most = int(k.max(initial=0))
    diagonal = np.arange(-most, most + 1)[:, None]
    row = np.full((2 * most + 3, len(live)), never)  # a row of nothing at both ends
    for e in range(most + 1):
        if not len(live):
            break
        low, high = most - e, most + e + 1  # the diagonals -e to e
        if e:
            new = np.maximum(np.maximum(row[low + 1 : high + 1] + 1, row[low:high]), row[low + 2 : high + 2] + 1)
        else:
            new = np.zeros((1, len(live)), np.int64)
        d = diagonal[low:high]
        new = np.minimum(new, np.minimum(n, m - d))
        on = (new >= 0) & (new + d >= 0) & (np.abs(m - n - d) <= k - e)
        new[~on] = never
        i, pair = np.nonzero(on)
        here = new[i, pair]
        new[i, pair] = here + moved(at[pair] + here, to[pair] + here + d[i, 0])
        row[low + 1 : high + 1] = new
        done = row[m - n + most + 1, np.arange(len(live))] == n
        out[live[done]] = e
        left = ~done & (k > e)
        if not left.all():
            live, n, m, at, to, k = (x[left] for x in (live, n, m, at, to, k))
            row = row[:, left]
    return out


def _close_pairs(texts: list[str], a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Which of some pairs of different texts are within their edits; where these are many, pair by pair."""
    near, some = np.zeros(len(a), bool), np.flatnonzero(edits <= RUNS)
    for i in np.flatnonzero(edits > RUNS):
        near[i] = within(texts[a[i]], texts[b[i]], int(edits[i]))
    size = np.array([len(x) for x in texts], np.int64)
    some = some[np.argsort(np.maximum(size[a[some]], size[b[some]]), kind="stable")]
    held = (size[a[some]] + size[b[some]] + 8 * edits[some]).cumsum()  # what hashes and rows of diagonals may take
    for part in np.split(some, np.flatnonzero(np.diff(held // (4 * CHARACTERS))) + 1):
        if len(part):
            use, at = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
            near[part] = runs_distance([texts[i] for i in use], at[: len(part)], at[len(part) :], edits[part]) <= edits[part]
    return near


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits, however many these are: bit-parallel over the band of each column."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    same, high = 0, len(a)
    while same < high:  # the longest equal start
        mid = (same + high + 1) // 2
        same, high = (mid, high) if a[same:mid] == b[same:mid] else (same, mid - 1)
    a, b = a[same:], b[same:]
    same, high = 0, len(a)
    while same < high:
        mid = (same + high + 1) // 2
        same, high = (mid, high) if a[len(a) - mid : len(a) - same] == b[len(b) - mid : len(b) - same] else (same, mid - 1)
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or len(b) <= edits:
        return len(b) <= edits
    # the band around the diagonal, a row lower in each column; the highest bit is the row `edits` below it
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i + edits
    top, full, score = 2 * edits, (2 << 2 * edits) - 1, edits
    vp, vn = full >> edits << edits, 0
    for j, c in enumerate(b):
        match = at.get(c, 0) >> j & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp, hn = vn | full & ~(d0 | vp), d0 & vp
        score += not d0 >> top
        d0 >>= 1
        vp, vn = hn | full & ~(d0 | hp), d0 & hp
        if score - vp.bit_count() > edits:  # no value of the column is less
            return False
    above = len(b) + edits - len(a)
    rows = (1 << above) - 1 << top - above
    return score - (vp & rows).bit_count() + (vn & rows).bit_count() <= edits


def _marks(texts: list[str]) -> np.ndarray:
    """Counts of the characters of each text in 32 classes, 32,767 at most."""
    size = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), 32), np.int16)
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size.cumsum() // CHARACTERS)) + 1):
        codes = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(27)
        n = np.bincount(np.repeat(np.arange(len(part)) * 32, size[part]) + codes, minlength=32 * len(part))
        out[part] = np.minimum(n, 32767).reshape(-1, 32)
    return out


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters, counted by class, that one of two texts has more than the other."""
    return np.abs(a - b).sum(1, dtype=np.int64)


def _unpacked(marks: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(marks.to_pylist()), np.int16).reshape(-1, 32)


def _likely_pairs(edits: int, per: int):
    """The pairs whose lengths and characters allow for the edits of the shorter line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            most = allowed(np.minimum(n, m), edits, per)
            on = pa.array((np.abs(n - m) <= most) & (_gap(_unpacked(b.column("left")), _unpacked(b.column("right"))) <= 2 * most))
            yield pa.RecordBatch.from_arrays([b.column("src").filter(on), b.column("dst").filter(on)], ["src", "dst"])

    return run


def _likely_rows(edits: int, per: int):
    """(bucket, h): the lines of each bucket that some line of it, by lengths and characters, may be near to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, ["lead", "bucket", "lo", "hi"], 5000):
            block, size, h, bucket = (t.column(c).to_numpy() for c in ("block", "n", "h", "bucket"))
            lo, hi, marks = t.column("lo").to_numpy(), t.column("hi").to_numpy(), _unpacked(t.column("marks"))
            hit = np.zeros(t.num_rows, bool)
            for g in range(len(start) - 1):
                s = np.arange(start[g], start[g + 1])
                s = s[np.argsort(size[s], kind="stable")]
                for i, j in _in_reach(size[s], edits, per):
                    i, j = s[i], s[j]
                    if lo[s[0]] != hi[s[0]]:
                        i, j = i[on := block[i] != block[j]], j[on]
                    if not (some := ~(hit[i] & hit[j])).all():
                        i, j = i[some], j[some]
                    near = _gap(marks[i], marks[j]) <= 2 * allowed(np.minimum(size[i], size[j]), edits, per)
                    hit[i[near]] = hit[j[near]] = True
            yield pa.RecordBatch.from_arrays([pa.array(bucket[hit]), pa.array(h[hit])], ["bucket", "h"])

    return run


def _in_reach(length: np.ndarray, edits: int, per: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ascending lengths, the longer of which is in reach of the shorter; some 100,000 at a time."""
    more = np.searchsorted(length, length + allowed(length, edits, per), "right") - np.arange(1, len(length) + 1)
    upto, at = np.cumsum(more), 0
    while at < len(length):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 100_000, "right")))
        i = np.repeat(np.arange(at, end), more[at:end])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[at:end]) - more[at:end], more[at:end])
        at = end


def _near_pairs(edits: int, per: int):
    """The pairs within the edits of the shorter line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            most = allowed(np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64), edits, per)
            texts = {x: i for i, x in enumerate(dict.fromkeys([*left, *right]))}
            near = _close_pairs(list(texts), np.array([texts[x] for x in left], np.int64), np.array([texts[x] for x in right], np.int64), most)
            if len(on := np.flatnonzero(near)):
                yield pa.RecordBatch.from_arrays([b.column("src").take(pa.array(on)), b.column("dst").take(pa.array(on))], ["src", "dst"])

    return run


def _near_blocks(edits: int, per: int):
    """Spanning trees of the matching lines of some block pairs at a time; pairs joined or compared already are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, ["lead", "bucket", "lo", "hi"], 5000):
            block, texts = t.column("block").to_numpy(), t.column("line").to_pylist()
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            h, first, of = np.unique(t.column("h").to_numpy(), return_index=True, return_inverse=True)
            texts = [texts[i] for i in first]
            size, marks, label, n = np.array([len(x) for x in texts], np.int64), _marks(texts), np.arange(len(texts)), len(texts)
            seen, pending, src, dst = np.zeros(0, np.int64), [], [], []

            def join(pending: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
                p = np.unique(np.concatenate(pending)) if pending else seen[:0]
                for a, b in _joined(np.stack([p // n, p % n], 1), texts, edits, per, label):
                    src.append(h[a])
                    dst.append(h[b])
                return np.union1d(seen if len(seen) < 1_000_000 else seen[:0], p)

            for g in range(len(start) - 1):
                s = np.arange(start[g], start[g + 1])
                s = s[np.argsort(size[of[s]], kind="stable")]
                for i, j in _in_reach(size[of[s]], edits, per):
                    if lo[s[0]] != hi[s[0]]:
                        i, j = i[on := block[s[i]] != block[s[j]]], j[on]
                    i, j = of[s[i]], of[s[j]]
                    on = label[i] != label[j]
                    code = np.minimum(i, j)[on] * n + np.maximum(i, j)[on]
                    if len(seen):
                        code = code[seen[np.minimum(np.searchsorted(seen, code), len(seen) - 1)] != code]
                    i, j = code // n, code % n
                    near = np.abs(marks[i] - marks[j]).sum(1, dtype=np.int64) <= 2 * allowed(np.minimum(size[i], size[j]), edits, per)
                    pending.append(code[near])
                    if sum(map(len, pending)) > 10_000:
                        seen, pending = join(pending, seen), []
            join(pending, seen)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _joined(p: np.ndarray, texts: list[str], edits: int, per: int, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs p within the edits of the shorter line that join two labels; label is brought up to date."""
    size = np.array([len(x) for x in texts], np.int64)
    most = allowed(size[p].min(1), edits, per)
    order = np.argsort(size[p].max(1), kind="stable")
    p, most = p[order], most[order]
    long = size[p].max(1)
    at = 0
    while at < len(p):
        n = max(1, min(4000, CHARACTERS * 8 // int(long[min(at + 4000, len(p)) - 1])))
        q, k = p[at : at + n], most[at : at + n]
        at += n
        on = label[q[:, 0]] != label[q[:, 1]]
        q, k = q[on], k[on]
        close = q[_close_pairs(texts, q[:, 0], q[:, 1], k)]
        for i, j in close:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield i, j


def _near_lines(edits: int):
    """Spanning stars of the matching lines of each bucket (block pair)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in whole_groups(batches, ["bucket", "lo", "hi"], 5000):
            h, index, block = (t.column(c).to_numpy() for c in ("h", "index", "block"))
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            lines, where = {}, np.empty(len(h), np.int64)
            texts = t.column("line").to_pylist()
            for i, x in enumerate(texts):
                where[i] = lines.setdefault(x, len(lines))
            distinct = list(lines)
            marks = _marks(distinct)
            pairs = set()
            for g in range(len(start) - 1):
                s = np.arange(start[g], start[g + 1])
                across = lo[s[0]] != hi[s[0]]
                for i in s[index[s]]:
                    other = s[(h[s] != h[i]) & ((block[s] != block[i]) if across else True)]
                    gap = np.abs(marks[where[other]] - marks[where[i]]).sum(1)
                    for k in other[gap <= 2 * edits]:
                        pairs.add((min(where[i], where[k]), max(where[i], where[k])))
            if not pairs:
                continue
            p = np.array(sorted(pairs))
            p = p[_close_pairs(distinct, p[:, 0], p[:, 1], np.full(len(p), edits))]
            low = local_components(len(distinct), p[:, 0], p[:, 1])
            name = np.zeros(len(distinct), np.int64)
            name[where] = h
            own = np.flatnonzero(low != np.arange(len(low)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(name[low[own]])], ["src", "dst"])

    return run


def first_places(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, n, first) of every line that counts, and of these the at most HOT that are more than 1 / HOT of all."""
    firsts = keep(places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "rid", "line_no")).alias("first")), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    return firsts, keep(firsts.where(F.col("n") * HOT > total).coalesce(1), "hot")


def _lines_of(docs: DataFrame, hot: DataFrame, met: DataFrame, min_chars: int) -> DataFrame:
    """(h, line, n, marks) of the lines in met, their lengths and counts of characters; hot ones taken at their first place; only lines that a bitmap lets through are shuffled."""
    wanted = keep(met.select("h").distinct(), "wanted")
    bits, once = low_bits(wanted, "h"), {r["h"]: (r["first"]["rid"], r["first"]["line_no"]) for r in hot.select("h", "first").collect()}  # HOT rows at most
    size = np.int64(8 * len(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, lines, where = b.slice(at, 1000), [], []
                for rid, text in zip(part.column("rid").to_pylist(), part.column("text").to_pylist()):
                    for k, x in enumerate((text or "").split("\n")):
                        if len(x := x.strip(_STRIP)) >= min_chars:
                            lines.append(x)
                            where.append((rid, k))
                h = _hashes(lines)
                bit = h % size
                on = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1)
                on = np.array([i for i, own in zip(on.tolist(), h[on].tolist()) if once.get(own, where[i]) == where[i]], np.int64)
                lines, h = [lines[i] for i in on], h[on]
                marks = _marks(lines)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(lines, pa.string()), pa.array([len(x) for x in lines], pa.int64()), pa.array([x.tobytes() for x in marks], pa.binary())], ["h", "line", "n", "marks"])

    lines = docs.where("text IS NOT NULL").select(row_id().alias("rid"), "text").mapInArrow(run, "h bigint, line string, n bigint, marks binary")
    lines = lines.join(wanted.hint("merge"), ["h"], "left_semi")
    return keep(lines.dropDuplicates(["h"]), "lines")


def _blocks(met: DataFrame, lines: DataFrame, *lead: str) -> DataFrame:
    """Rows of met, with their lines, in each pair of blocks of their bucket they belong to, sorted by it.

    Buckets of one lead are dealt to one task, if their blocks are the same."""
    met = met.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    met = met.select(*lead, "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "h", "index").join(lines.hint("merge"), "h")
    keys = [*(lead or ["bucket"]), "lo", "hi"]
    return met.repartition(partitions(met.sparkSession), *keys).sortWithinPartitions(*lead, "bucket", "lo", "hi")


def _shared(docs: DataFrame, run) -> DataFrame:
    """(bucket, h, index): the keys that run makes of texts, where lines share them. Keys are shuffled many to a row."""
    n = partitions(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_packed(run, 8 * n), "range int, keys binary").repartition(n, "range").sortWithinPartitions("range")
    return keep(rows.mapInArrow(_shared_keys, "bucket bigint, h bigint, index boolean").distinct(), "shared")


def clean(spark) -> None:
    """Spark deletes the shuffle files of plans that are done when the driver's JVM collects them."""
    spark._jvm.System.gc()


def _met_segments(shared: DataFrame) -> DataFrame:
    """(bucket, h, index, blocks): lines that share a segment key with the index entry of another line."""
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max("index").alias("any")).where("size > 1 AND any")
    return keep(shared.join(sizes.hint("merge"), "bucket").withColumn("blocks", F.ceil(F.col("size") / BUCKET)).select("bucket", "h", "index", "blocks"), "met")


def _met_windows(shared: DataFrame, block: int) -> DataFrame:
    """(bucket, h, index, size, lead, blocks): lines that share a window key with another line; keys of the same lines count once.

    A line goes to as many tasks as its bucket has blocks, so blocks grow in number and in size, each as the root of the bucket."""
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("h")).alias("mark"), F.min("h").alias("lead")).where("size > 1")
    sizes = sizes.groupBy("size", "mark").agg(F.min("bucket").alias("bucket"), F.min("lead").alias("lead"))
    return keep(shared.join(sizes.select("bucket", "size", "lead").hint("merge"), "bucket").withColumn("blocks", F.ceil(F.sqrt(F.col("size") / block))), "met")


def _likely(grown: DataFrame, lines: DataFrame, edits: int, per: int) -> DataFrame:
    """Of the keys that many lines share, the lines that may have a near one, told without their texts."""
    marks = lines.select("h", "n", "marks")
    rows = _blocks(grown.where(F.col("size") > FEW), marks, "lead").mapInArrow(_likely_rows(edits, per), "bucket bigint, h bigint")
    return keep(rows.distinct().withColumn("index", F.lit(True)), "likely")


def _pairs(met: DataFrame, lines: DataFrame, edits: int, per: int) -> DataFrame:
    """(src, dst): near lines among those of keys that few lines share; texts of likely pairs only meet."""
    few = met.where(F.col("size") <= FEW).groupBy("bucket").agg(F.sort_array(F.collect_list("h")).alias("all"))
    few = few.select("all", F.posexplode("all").alias("at", "src")).select("src", F.explode(F.slice("all", F.col("at") + 2, FEW)).alias("dst")).distinct()
    left, right = lines.select(F.col("h").alias("src"), "n", F.col("marks").alias("left")), lines.select(F.col("h").alias("dst"), F.col("n").alias("m"), F.col("marks").alias("right"))
    few = few.join(left.hint("merge"), "src").join(right.hint("merge"), "dst").select("src", "dst", "n", "m", "left", "right")
    few = keep(few.mapInArrow(_likely_pairs(edits, per), "src bigint, dst bigint"), "few")
    left, right = lines.select(F.col("h").alias("src"), F.col("line").alias("left")), lines.select(F.col("h").alias("dst"), F.col("line").alias("right"))
    few = few.join(left.hint("merge"), "src").join(right.hint("merge"), "dst")
    return few.select("src", "dst", "left", "right").mapInArrow(_near_pairs(edits, per), "src bigint, dst bigint")


def line_classes(docs: DataFrame, hot: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, per: int = 0) -> DataFrame:
    """(node, root): lines (by hash) with near lines, and the class of each; hot as first_places() gives it."""
    met = _met_segments(_shared(docs, _key_rows(edits, min_chars, per)))
    clean(docs.sparkSession)
    if not per:
        return components(_blocks(met, _lines_of(docs, hot, met, min_chars).select("h", "line")).mapInArrow(_near_lines(edits), "src bigint, dst bigint"), "near")
    shared = _shared(docs, _key_rows(edits, min_chars, per, True))
    clean(docs.sparkSession)
    grown = _met_windows(shared, MARKED)
    discard(shared)
    lines = _lines_of(docs, hot, met.select("h").unionByName(grown.select("h")), min_chars)
    likely = _likely(grown, lines, edits, per)
    many = _met_windows(likely, BLOCK)
    texts = lines.select("h", "line")
    edges = [
        keep(_blocks(met, texts).mapInArrow(_near_lines(edits), "src bigint, dst bigint"), "segments"),
        keep(_pairs(grown.where(F.col("size") <= FEW).select("bucket", "h", "size").unionByName(many.select("bucket", "h", "size")), lines, edits, per), "pairs"),
        keep(_blocks(many.where(F.col("size") > FEW), texts, "lead").mapInArrow(_near_blocks(edits, per), "src bigint, dst bigint"), "blocks"),
    ]
    for x in (met, grown, likely, many, lines):
        discard(x)
    clean(docs.sparkSession)
    return components(edges[0].unionByName(edges[1]).unionByName(edges[2]), "near")


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, per: int = 0, exact: bool = False) -> DataFrame:
    """docs with text less the removed lines (n_chars, if there, follows), and n_lines, n_removed."""
    least = 1 if exact else min_chars
    places = keep(line_places(docs, least), "places")
    first, hot = first_places(places)
    near = keep(line_classes(docs, hot, edits, min_chars, per), "classes")
    rows = places.select("rid", "line_no", "h")
    repeated = first.join(near.select(F.col("node").alias("h"), "root").hint("merge"), ["h"], "left").where("n > 1 OR root IS NOT NULL")
    repeated = keep(repeated.withColumn("root", F.coalesce("root", "h")), "repeated")
    heads = keep(repeated.groupBy("root").agg(F.min("first").alias("first")), "heads")
    repeated = keep(repeated.select("h", "root").join(heads.hint("merge"), "root").select("h", F.col("first.rid").alias("kept_rid"), F.col("first.line_no").alias("kept_line")), "kept")
    often = keep(repeated.join(F.broadcast(hot.select("h")), "h", "left_semi").coalesce(1), "often")
    rows = rows.join(F.broadcast(often.select("h", F.col("kept_rid").alias("often_rid"), F.col("kept_line").alias("often_line"))), ["h"], "left")
    # places of hot lines spread over all tasks by their own hash and meet nothing there
    rows = rows.withColumn("cold", F.col("often_rid").isNull()).withColumn("h", F.when(F.col("cold"), F.col("h")).otherwise(F.xxhash64("rid", "line_no")))
    gone = rows.join(repeated.withColumn("cold", F.lit(True)).hint("merge"), ["h", "cold"], "left")
    gone = gone.select("rid", "line_no", F.coalesce("often_rid", "kept_rid").alias("kept_rid"), F.coalesce("often_line", "kept_line").alias("kept_line"))
    discard(first)
    gone = gone.where((F.col("rid") != F.col("kept_rid")) | (F.col("line_no") != F.col("kept_line")))
    gone = keep(gone.groupBy("rid").agg(F.collect_set("line_no").alias("gone")), "gone")  # bounded by one text
    discard(places)
    names = docs.columns
    gone = gone.withColumnRenamed("rid", "_rid")
    maybe, whole = split_likely(docs.withColumn("_rid", row_id()), "_rid", gone)
    out = maybe.join(gone.hint("merge"), "_rid", "left").unionByName(whole, allowMissingColumns=True)
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = out.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"), "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)})
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.select(*names, "n_lines", "n_removed", "gone")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, the line numbers removed and a digest of the text left."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), per=PER, exact=True)
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.sort_array("gone"), F.array().cast("array<int>")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
