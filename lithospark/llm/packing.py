"""Best-fit packing of documents into token sequences of a fixed size.

Best fit in rounds, in place of the bulk-synchronous one by Spark joins: each round is a loop on the driver over the
histogram of lengths, and only ranks are found by Spark. Documents (pieces) and gaps (room left in sequences) are range-sorted by size;
a sweep from the largest size down pushes gaps on a stack and gives each document the smallest gap not
yet taken that holds it; where several documents want one gap, rank decides: the longer first, then the
smaller id. Gaps are updated and the round repeats until a round places nothing, when new sequences are opened.

Sizes are whole numbers up to the sequence size, so the sorted rows are runs of equal size, and one
document or gap of a run is as good as another. A round therefore sweeps over runs: at most `size` runs of
documents and their gaps, a table whose size does not grow with the rows. Which document of a run goes to
which sequence is settled by its rank in the run, and the ranks are found by Spark: (length, salt) groups
are numbered in parallel and shifted by the counts before them, so a length that a third of all rows
share is many tasks.

Nulls: a null text is an empty one (one piece: the end token). Repeated rows are packed like any others.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithospark.llm.common import keep, partitions, table


class WordTokens(dict):
    """Chunk of text between white space, in lower case -> bytes of its ids, for a tokenizer that cuts text into
    words by its split pattern, never joins over white space and lower-cases.

    New chunks are cut into words, and only words not met before go to the tokenizer, many in one text: each
    word's last token ends a word, which tells them apart again. Latin-1 chunks are lower-cased and cut here,
    where Python's and the tokenizer's rules agree; other chunks stay as they are. Beyond CHUNKS entries those
    met since the last time stay, so that memory is bounded and frequent words are not learnt again."""

    CHUNKS = 600_000
    TOGETHER = 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.plain, self.old = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.split = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # words are cut and lower-cased already
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(file["model"]["end_of_word_suffix"])]] = True

    def learn(self, chunks: set[str]) -> None:
        # set - dict.keys() would go through all keys of the dict
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > self.CHUNKS:
            self.old = dict(self)
            self.clear()
            new = list(chunks)
        known, words, cut, other = self.old, set(), {}, []
        for c in new:
            if c in known:
                self[c] = known[c]
            elif not (c.isascii() or latin(c)):
                other.append(c)
            elif c.isalpha():
                words.add(c)
            else:  # most often a word and a mark
                cut[c] = w = (c[:-1], c[-1]) if c[:-1].isalpha() else self.split.findall(c)
                words.update(w)
        unknown = [w for w in words if w not in self]
        for i in range(0, len(unknown), self.TOGETHER):
            some = unknown[i : i + self.TOGETHER]
            ids = np.array(self.plain.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            assert len(stop) == len(some)
            ids = ids.tobytes()
            self.update(zip(some, [ids[a:b] for a, b in zip([0, *stop], stop)]))
        for c, w in cut.items():
            self[c] = b"".join([self[x] for x in w])
        for c in other:
            self[c] = self.whole(c)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        # the tokenizer takes \x1c to \x1f for no white space, str.split() does; special tokens are cut out before splitting
        odd = [any(c in t for c in (*self.special, "\x1c", "\x1d", "\x1e", "\x1f")) for t in texts]
        split = [() if o else t.lower().split() if t.isascii() or latin(t) else [x.lower() if latin(x) else x for x in t.split()] for t, o in zip(texts, odd)]
        self.learn(set().union(*split))
        for t, o, chunks in zip(texts, odd, split):
            yield self.whole(t) if o else b"".join(map(self.__getitem__, chunks))


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Of this Python worker: chunks learnt in one task serve the next.
_tokens: dict[str, WordTokens] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece; only documents longer than size are cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens[tokenizer] if tokenizer in _tokens else _tokens.setdefault(tokenizer, WordTokens(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.ids(texts)):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * size)):
                        x = ids[s : s + 4 * size]
                        rows.append((doc, k, s // 4, len(x) // 4, zlib.crc32(x), np.frombuffer(x, "<u4").tolist() if with_ids else None))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)][: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit_rounds(lengths: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): documents of a length, by rank, go one each to consecutive sequences."""
    left = np.zeros(size + 1, np.int64)
    left[lengths] = counts
    ranks = np.zeros(size + 1, np.int64)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number)
    plan, opened = [], 0
    while left.sum():
        wanted = np.flatnonzero(left)
        if not gaps or max(gaps) < wanted[0]:
            more = -(-int((left * np.arange(size + 1)).sum()) // size)
            gaps.setdefault(size, []).append((opened, more))
            opened += more
        stack: list[list[int]] = []  # (room, first, number), smallest room on top
        after: dict[int, list[tuple[int, int]]] = {}
        rooms = sorted(gaps, reverse=True)
        at, placed = 0, False
        for length in wanted[::-1]:
            length = int(length)
            while at < len(rooms) and rooms[at] >= length:
                stack.extend([rooms[at], s, n] for s, n in gaps[rooms[at]])
                at += 1
            while left[length] and stack:
                room, s, n = stack[-1]
                k = int(min(n, left[length]))
                plan.append((length, int(ranks[length]), k, s, size - room))
                ranks[length] += k
                left[length] -= k
                placed = True
                if room > length:
                    after.setdefault(room - length, []).append((s, k))
                if k == n:
                    stack.pop()
                else:
                    stack[-1][1:] = s + k, n - k
        for room, s, n in stack:
            after.setdefault(room, []).append((s, n))
        for room in rooms[at:]:
            after.setdefault(room, []).extend(gaps[room])
        least = np.flatnonzero(left)
        gaps = {r: runs for r, runs in after.items() if len(least) and r >= least[0]}
        assert placed
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, length, ...); lengths are 1 to size."""
    salts = max(16, partitions(pieces.sparkSession))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = keep(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    totals = sums.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most size rows
    plan = best_fit_rounds(np.array([r["length"] for r in totals], np.int64), np.array([r["n"] for r in totals], np.int64), size)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_local", local).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_local")).drop("_salt", "_base", "_local")
    names = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank") + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            key, keys = length * (1 << 40) + rank, plan[:, 0] * (1 << 40) + plan[:, 1]
            row = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(plan[row, 3] + rank - plan[row, 1]), pa.array(plan[row, 4])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from packed pieces with ids: at most `size` numbers a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    pieces = keep(tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
