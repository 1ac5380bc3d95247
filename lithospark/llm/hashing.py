"""Vectorised 64-bit hashes of byte ranges and words (numpy only)."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse for i < n, modulo 2 ** 64; kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            _powers[k] = p
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums; range_hash() takes the hash of any byte range from them."""
    return prefix_sums(_BYTES[data])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """The same for any 64-bit values, such as hashes of words."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end); the same bytes have the same hash wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of rows data[offsets[i]:offsets[i+1]]; words are runs of anything but ASCII white space."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    inner = offsets[1:-1]
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(inner):  # a word also ends where its row ends
        at = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = at[(solid[at] == 1) & (solid[at + 1] == 1)] if len(at) else at
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of these rows."""
    start, end = word_spans(data, offsets)
    return range_hash(prefix_hash(data), start, end), np.searchsorted(offsets, start, "right") - 1


def shingles(word: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (hash, row) of runs of size words; a row of 1 to size - 1 words has one shingle of all its words."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= size:
        h = np.zeros(len(word) - size + 1, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9FB21C651E98DF25) + word[k : len(word) - size + 1 + k]
        same = row[: len(h)] == row[size - 1 :]
        out, of = mix(h[same]), row[: len(h)][same]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        h = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            on = n[few] > k
            h[on] = h[on] * np.uint64(0x9FB21C651E98DF25) + word[first[few[on]] + k] + np.uint64(1)
        out, of = np.concatenate([out, mix(h)]), np.concatenate([of, few])
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[new], of[new]
