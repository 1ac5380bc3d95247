"""Lexical search, manifest and toxicity against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from lithospark.llm import lexical, manifest, toxicity  # noqa: E402

CLASH = ("n", "ids", "norm", "item", "rank", "g", "o", "u", "row", "leaf", "place", "tree", "idx", "digest", "x", "v", "bucket")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clashing(df, *more):
    return df.withColumns({c: F.lit(i) for i, c in enumerate((*CLASH, *more))})


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def search_by_force(docs, items, k):
    counts = [(i, Counter(TERM.findall(low(t)))) for i, t in docs if t and TERM.search(t)]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        found = []
        for i, c in counts:
            m = 100 - 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(low(text))) if c[t])
            if s > 0:
                found.append((-s, -1 if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [1 << 20, 40])
def test_search_equals_brute_force(spark, item_bytes):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "日本", "a_b", "X9"]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(65)], k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(500 + i, "w1 w2 copy W2") for i in range(30)] + [(7, "w1 w2 copy W2"), (900, None), (901, ""), (902, " ,;\x7f "), (None, "w3 w4 w5"), (903, "w50 " * 200_000)]
    items = [(1, "w1 w2 W1 été"), (2, None), (3, "--"), (4, "unknown"), (4, "w3 a b 日本"), (5, "w9 w50 x9"), (5, "w9 w50 x9"), (6, "copy")]
    got = lexical.search(clashing(spark.createDataFrame(docs, "doc_id bigint, text string")), clashing(spark.createDataFrame(items, "item_id bigint, text string")), 5, item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == search_by_force(docs, items, 5)


def test_search_prunes_and_loses_nothing(spark, monkeypatch):
    """Small blocks and many ranges: limits of earlier rounds drop most of the later blocks."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(8)
    docs = [(i, " ".join(f"t{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.randint(5, 40)))) for i in range(1500)]
    items = [(i, " ".join(f"t{rng.randint(0, 150)}" for _ in range(6))) for i in range(12)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((tuple(r) for r in got), key=str) == search_by_force(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, 287 * (1_000_000_000 // 3000))]  # m is 100, the weight floor(1000 * ln(4 / 3))
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0


def manifest_by_force(rows):
    """The contract row by row: doc_id, source, lang, n_chars, text."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*[field(v) for v in r])
    first = lambda v: (v is not None, v if v is not None else 0)

    def climb(nodes):
        """Root, and the (left, right) steps of each node."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                steps[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
                at[k] = i // 8
            level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        return level[0], steps

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]), leaf(r))) for g in langs]
    climbed = [climb([leaf(r) for r in g]) for g in groups]
    root, tops = climb([c[0] for c in climbed])
    out = []
    for g, (subroot, steps), top in zip(groups, climbed, tops):
        for r, s in zip(g, steps):
            path = s + top
            crc = 0 if r[0] is None else zlib.crc32(str(r[0]).encode())
            d = leaf((*r[:4], low(r[4]) if r[4] is not None and crc % 3 == 0 else r[4]))
            for a, b in path:
                d = h(a, d, b)
            out.append((r[0], leaf(r), subroot, root, h(*[a + b for a, b in path]), d, d == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 150])
def test_manifest_equals_brute_force(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i * 7 % 151, rng.choice(["a", None, "çé"]), rng.choice(["en", "fr", None, "é", "z"] if n > 8 else ["en"]), rng.choice([None, i]), rng.choice([None, "", "Text ÄB", f"T{i}"])) for i in range(n)]
    if n > 100:
        rows += [rows[0], rows[0], (None, None, None, None, None), (5, "one", "lone", 1, "Lone"), (6, "s", "en", 2, "Q" * 300_000)] + [(40, "x", "fr", k, "Y") for k in range(20)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = manifest.op12_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest_by_force(rows)


def test_manifest_of_an_empty_table_and_a_narrow_tree(spark):
    leaves = spark.range(40).select(F.col("id"), F.lit("g").alias("lang"), manifest.leaf_digest(F.col("id")).alias("leaf"))
    assert manifest.proofs(leaves.limit(0), "lang", "id", "leaf", ["id"]).count() == 0
    out = manifest.proofs(leaves, "lang", "id", "leaf", ["id"], fan=2)  # six levels: three rounds of doubling
    got = out.select("root", manifest.fold(F.col("leaf"), F.col("path")).alias("f"), F.size("path").alias("n")).collect()
    assert len(got) == 40 and {r["n"] for r in got} == {6} and all(r["f"] == r["root"] for r in got)


def toxic_corpus(n):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(30, 400))
        y = int(i % 6 == 0)
        for _ in range(y * rng.randint(2, 5)):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "Moron", "scum", "loser,"]))
        rows.append((i, " ".join(text), y))
    return rows


def test_toxicity_on_texts_not_learnt(spark):
    rows = toxic_corpus(1200)
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = toxicity.score(docs.drop("toxic"), model).collect()
    held = [(r["score"] >= 0.5, rows[r["doc_id"]][2]) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {r["doc_id"] for r in toxicity.training_rows(docs, labels).collect()}.isdisjoint(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0)
    assert toxicity.training_rows(docs, labels, 50).count() <= 50


def test_ratios_equal_the_formula():
    import numpy as np

    n1, n0 = np.array([9.0, 0.0, 1.0]), np.array([1.0, 9.0, 1.0])
    r = toxicity.log_count_ratios(n1, n0, 0.0)
    assert np.allclose(r, [math.log(10 / 13) - math.log(2 / 14), math.log(1 / 13) - math.log(10 / 14), math.log(2 / 13) - math.log(2 / 14)])
    assert (np.abs(toxicity.log_count_ratios(n1, n0, 1.0)) <= np.abs(r)).all() and toxicity.log_count_ratios(n1, n0, 9.0).any() == 0
    at, share = toxicity.shares("Ab ab")
    assert math.isclose(share.sum(), 1) and len(toxicity.shares(None)[0]) == len(toxicity.shares("")[0]) == 0 and len(at) == len(set(at.tolist()))


def test_toxicity_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 700_000), (4, "idiot " * 3), (5, "fine words"), (5, "fine words"), (5, "other"), (None, "no id")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "score", "toxic")
    labels = clashing(spark.createDataFrame([(3, 0), (4, 1), (5, 0), (5, 1), (9, 1), (None, 1), (1, None)], "doc_id bigint, toxic int"))
    for some in (labels, labels.where("toxic = 1"), labels.limit(0)):
        out = toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, some))).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 5 and r["text"] == "fine words"}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(toxicity.training_rows(docs.limit(0), labels))).count() == 0


def test_no_checkpoint_folder_set():
    """A plain local session without spark.checkpoint.dir gets a folder of its own."""
    import subprocess
    import sys
    from pathlib import Path

    code = "from pyspark.sql import SparkSession as S; s = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); from lithospark.llm.common import keep; assert keep(s.range(3), 'x').count() == 3 and keep(s.range(2), 'x').count() == 2; print('kept')"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).resolve().parents[2])
    assert "kept" in out.stdout, out.stderr[-1500:]
