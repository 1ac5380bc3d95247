"""Byte-level BPE encoding and decoding by speculate and verify.

Words (the pieces of the tokenizer's split pattern) that are not known yet are encoded together. Greedy
longest match proposes tokens for all words at once, looking up hashes of byte ranges in the sorted hashes
of the vocabulary. A proposal is right if each token stands for its own bytes and every adjacent pair is
compatible: no merge across the border of two tokens would have run before the merges that use up its two
sides. These checks are vectorised over the distinct pairs. Only words that fail are merged exactly.

A merge's rank is larger than the ranks of the merges that made its two parts, so merges of a word run in
order of rank; hence a border pair (x on the right edge of the left token, y on the left edge of the right
one) merges wrongly if its rank is below the rank that uses x up and not above the one that uses y up
(equal ranks run from left to right).

A null text is an empty one: no tokens. Texts are processed whole. Text that spells a special token is
that token, as in the library. Repeated rows get the same result; an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lithospark.llm.common import table
from lithospark.llm.hashing import prefix_hash, range_hash

#: Split pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = np.int64(1) << 40


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes of a word up to which tokens are proposed.
LONG_WORD = 2000


class Vocabulary:
    """Tables made once from a tokenizer file and sent to the tasks (their size is that of the vocabulary)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocab = byte_of_char(), spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.size, self.rank_of, self.made_by = size, {}, []
        made, parts = np.full(size, -1, np.int64), np.full((size, 2), -1, np.int64)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.rank_of.setdefault(vocab[a] * size + vocab[b], rank)
            self.made_by.append(i)
            if made[i] < 0:
                made[i], parts[i] = rank, (vocab[a], vocab[b])
        self.base = [0] * 256
        for t, i in vocab.items():
            if len(t) == 1:
                self.base[byte[t]] = i
        codes = np.array([c // size << 32 | c % size for c in self.rank_of], np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], np.array(list(self.rank_of.values()), np.int64)[order]
        # edges[t, k]: k-th token on the right (left) edge of t, from t inward; used[t, k]: rank of the merge that uses it up
        self.right, self.right_used = self._edges(parts, made, 1)
        self.left, self.left_used = self._edges(parts, made, 0)
        model = sorted(set(vocab.values()) - set(self.special.values()))
        own = np.array([i for i in model if len(self.bytes[i]) == 1 or self.merge(self.bytes[i]) == [i]], np.int64)
        self.lengths = sorted({len(self.bytes[i]) for i in own})
        data = np.frombuffer(b"".join(self.bytes[i] for i in own), np.uint8)
        ends = np.cumsum([len(self.bytes[i]) for i in own])
        hashes = range_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.hashes, self.tokens = hashes[order], own[order]
        self.byte_length = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)

    @staticmethod
    def _edges(parts: np.ndarray, made: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        edge, used = [np.arange(len(parts))], [np.full(len(parts), _NEVER)]
        while True:
            inner = np.where(edge[-1] >= 0, parts[edge[-1], side], -1)
            if (inner < 0).all():
                return np.stack(edge, 1), np.stack(used, 1)
            used.append(np.where(inner >= 0, made[edge[-1]], -1))
            edge.append(inner)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, from the left."""
        if len(word) > 200:
            return self.merge_long(word)
        size, rank_of, made, never = self.size, self.rank_of, self.made_by, len(self.made_by)
        ids = [self.base[b] for b in word]
        ranks = [rank_of.get(a * size + b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            new = made[low]
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of.get(ids[i - 1] * size + new, never)
            if i < len(ranks):
                ranks[i] = rank_of.get(new * size + ids[i + 1], never)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs by (rank, place), for words of any length."""
        size, rank_of, made, n = self.size, self.rank_of, self.made_by, len(word)
        ids, before, after = [self.base[b] for b in word], list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of.get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] * size + ids[j]) != rank:
                continue  # one of the two has been merged
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank_of.get(ids[k] * size + ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for i in range(self.right.shape[1]):
            x, used_x = self.right[a, i], self.right_used[a, i]
            if (x < 0).all():
                break
            for j in range(self.left.shape[1]):
                y, used_y = self.left[b, j], self.left_used[b, j]
                on = ok & (x >= 0) & (y >= 0)
                if not on.any():
                    break
                code = x[on] << 32 | y[on]
                at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
                rank = np.where(self.pair_codes[at] == code, self.pair_ranks[at], _NEVER)
                ok[on] = ~((rank < used_x[on]) & (rank <= used_y[on]) & (rank < _NEVER))
        return ok

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words, and the word of each; in order."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        pos, prefix = end - size, prefix_hash(data)
        live, tokens, of, steps, step = np.flatnonzero(size > 0), [], [], [], 0
        while len(live):
            found = np.full(len(live), -1, np.int64)
            room = end[live] - pos[live]
            for n in reversed([n for n in self.lengths if n <= room.max()]):
                on = np.flatnonzero((found < 0) & (room >= n))
                if len(on):
                    p = pos[live[on]]
                    h = range_hash(prefix, p, p + n)
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    found[on] = np.where(self.hashes[at] == h, self.tokens[at], -1)
            tokens.append(found)
            of.append(live)
            steps.append(np.full(len(live), step))
            step += 1
            pos[live] += self.byte_length[found]
            live = live[pos[live] < end[live]]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, of = np.concatenate(tokens), np.concatenate(of)
        order = np.lexsort((np.concatenate(steps), of))
        return tokens[order], of[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers; very long words are merged without a proposal, one token at a time takes as many steps."""
        if any(len(w) > LONG_WORD for w in words):
            short = iter(self.encode_words([w for w in words if len(w) <= LONG_WORD]))
            return [np.array(self.merge(w), "<u4").tobytes() if len(w) > LONG_WORD else next(short) for w in words]
        tokens, of = self.greedy(words)
        inner = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(tokens[inner] << 32 | tokens[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.zeros(len(words), bool)
        failed[of[inner[bad[back]]]] = True
        raw, cut = tokens.astype("<u4").tobytes(), 4 * np.searchsorted(of, np.arange(len(words) + 1))
        return [np.array(self.merge(w), "<u4").tobytes() if f else raw[a:b] for w, f, a, b in zip(words, failed, cut[:-1].tolist(), cut[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.byte_length[ids]
        end = np.cumsum(n)
        if not len(ids):
            return b""
        return self.all_bytes[np.repeat(self.byte_start[ids] - (end - n), n) + np.arange(end[-1])].tobytes()


class Encoder:
    """Encodes texts; remembers words and the chunks between single blanks, up to a bound."""

    WORDS, CHUNKS = 250_000, 250_000

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.words, self.chunks = vocabulary, {}, {}
        self.split, self.runs = regex.compile(PATTERN), regex.compile(r"\s\s")

    def _learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.WORDS:
            self.words.clear()
            new = list(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.words.update(zip(part, self.v.encode_words([w.encode() for w in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list] = []  # of each text: chunks, words or ids of special tokens
        for t in texts:
            pieces: list = [t]
            for s, i in self.v.special.items():
                if s in t:
                    pieces = [y for x in pieces for y in (self._around(x, s, i) if isinstance(x, str) else [x])]
            parts.append([x if isinstance(x, bytes) else self.split.findall(x) if self.runs.search(x) else self._blanks(x) for x in pieces if x])
        new = set().union(*(x for p in parts for x in p if isinstance(x, (list, tuple)))) - self.chunks.keys()
        if len(self.chunks) + len(new) > self.CHUNKS:
            self.chunks.clear()
            new = set().union(*(x for p in parts for x in p if isinstance(x, (list, tuple))))
        split = {c: self.split.findall(c) for c in new}
        self._learn_words(set().union(*split.values()))
        words, chunks = self.words, self.chunks
        for c, w in split.items():
            chunks[c] = b"".join([words[x] for x in w])
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(chunks.__getitem__, x)) for x in p]) for p in parts]

    @staticmethod
    def _around(text: str, special: str, i: int) -> list:
        out: list = []
        for k, x in enumerate(text.split(special)):
            out += [np.array([i], "<u4").tobytes()] * (k > 0) + [x]
        return out

    @staticmethod
    def _blanks(text: str) -> list[str]:
        """Chunks at single blanks, each but the first with its blank: no word of the pattern crosses them."""
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]


#: Of this Python worker: words learnt in one task serve the next.
_encoders: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every whole text."""
    vocabulary = Vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(vocabulary))
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part, rows = b.slice(at, 400), []
                for ids in encoder.encode([x or "" for x in part.column("text").to_pylist()]):
                    numbers = np.frombuffer(ids, "<u4").astype(np.int64)
                    raw = vocabulary.decode(numbers)
                    try:
                        text = raw.decode() if with_ids else None
                    except UnicodeDecodeError:
                        text = raw.decode(errors="replace")
                        raw = text.encode()
                    rows.append((len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), numbers if with_ids else None, text))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k, _ in zip(columns, kinds, names))], ["doc_id", *names])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of every document's ids and of the text they decode to."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
