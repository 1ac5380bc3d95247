"""Corpus operators against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from lithospark.llm import bpe, langid, lines, ngram_join, packing, quality, repeats, rules, topk, urls  # noqa: E402

DOC = "doc_id bigint, text string"
ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "a" * 5000), (None, "no id here"), (104, "same twice"), (104, "same twice"), (105, "ñandú 日本語 <|endoftext|> x\x1cy  z")]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema).withColumns({"n": F.lit(7), "key": F.lit("k"), "rid": F.lit("r"), "h": F.lit(1.5), "count": F.lit(0)})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(12)]
    out = []
    for i in range(70):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i, " ".join(t) if i % 5 else " ".join(t) + "\n" + rng.choice(base)))
    return out + ODD


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = packing.pack(packing.tokenized_pieces(frame(spark, corpus), path, size=64, with_ids=True), 64)
    got = out.toPandas()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in corpus}
    assert len(got) == sum(-(-len([*t.encode(x or "", add_special_tokens=False).ids, 1]) // 64) for _, x in corpus)
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            assert list(r.ids) == ids[int(r.doc_id)][r.start : r.start + 64] and r.start == 64 * r.piece and r.length == len(r.ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 64 and list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]
    total = int(got["length"].sum())
    assert got["sequence_id"].nunique() <= -(-total // 64) * 1.1 + 1
    assert packing.sequences(out).count() == got["sequence_id"].nunique()
    assert packing.pack(packing.tokenized_pieces(frame(spark, []), path)).count() == 0


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [x or "" for _, x in corpus] + ["a  b   c\n \n d\t\t e  ", "don't we'll 1234 5６", "<|endoftext|>", "\n\n", " ", "-----===  ===", "a\r\nb  \r\n", "😀 😀😀"]
    got = rows_of(bpe.encode_decode(frame(spark, list(enumerate(texts))), path, with_ids=True).select("doc_id", "n_tokens", "ids_sha256", "ids", "decoded"))
    for i, n, digest, ids, decoded in got:
        want = t.encode(texts[i], add_special_tokens=False).ids
        assert ids == want and n == len(want) and decoded == t.decode(want, skip_special_tokens=False)
        assert digest == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(frame(spark, []), path).count() == 0


def test_bpe_long_words():
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(40):
        w = "".join(rng.choice("aeiounrstlñ3") for _ in range(rng.randint(1, 190))).encode()
        assert v.merge(w) == v.merge_long(w)
    long = ("".join(rng.choice("aeiounrst") for _ in range(50)) * 20_000).encode()
    assert b"".join(v.bytes[i] for i in v.merge(long)) == long


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n, links = len(rows), [0] * len(rows)
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min([x for x in (least.get(label[k]), i) if x is not None], default=None)
    return sorted(((rows[k][0], least[label[k]], links[k]) for k in range(n)), key=str)


def test_ngram_join(spark, corpus):
    assert rows_of(ngram_join.jaccard_join(frame(spark, corpus)).select("doc_id", "class_id", "n_links")) == jaccard_brute(corpus)
    assert ngram_join.jaccard_join(frame(spark, [])).count() == 0


def test_ngram_join_with_a_hub(spark):
    """Thousands of near copies of one text, all linked to each other, beside a third of the rows that are one text."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(3000):
        t = list(base)
        t[rng.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(t)))
    rows += [(i, "this same short text is here again and again") for i in range(3000, 4500)] + [(i, f"alone{i} has no other text like it{i}") for i in range(4500, 4600)]
    got = ngram_join.jaccard_join(frame(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    assert {tuple(r) for r in got} == {(i, 0, 2999) if i < 3000 else (i, 3000, 1499) if i < 4500 else (i, i, 0) for i, _ in rows}


@pytest.mark.parametrize(("length", "window"), [(60, 20), (100, 40)])
def test_repeats(spark, corpus, length, window):
    data = [(i, (t or "").encode()) for i, t in corpus]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = repeats.remove_repeats(frame(spark, corpus), length, window).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == sorted(want, key=str)
    text = repeats.remove_repeats(frame(spark, corpus), length, window, as_text=True)
    assert text.where("text IS NULL").count() == 1 and "�" not in "".join(r["text"] or "" for r in text.collect())


@pytest.mark.parametrize(("length", "window"), [(12, 6), (30, 12)])
def test_repeats_in_words(spark, corpus, length, window):
    word = re.compile("[^\x20\x09-\x0d]+")
    spans = [[m.span() for m in word.finditer(t or "")] for _, t in corpus]
    texts = [[t[a:b] for a, b in s] for (_, t), s in zip(corpus, spans)]
    seen = Counter(tuple(w[p : p + length]) for w in texts for p in range(len(w) - length + 1))
    want, counted = [], []
    for (i, t), s, w in zip(corpus, spans, texts):
        gone = {q for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1 for q in range(p, p + length)}
        cut = {c for q in gone for c in range(*s[q])} | {c for q in gone if q + 1 in gone for c in range(s[q][1], s[q + 1][0])}
        want.append((i, None if t is None else "".join(c for k, c in enumerate(t) if k not in cut)))
        counted += [len(gone)] * bool(gone)
    got = repeats.remove_repeats(frame(spark, corpus), length, window, as_text=True, unit="words").select("doc_id", "text")
    assert rows_of(got) == sorted(want, key=str) and sum(map(bool, counted)) > 20
    found = {r["rid"]: r["n_passage_words"] for r in repeats.passage_words(frame(spark, corpus), length, window).collect()}
    again = len({(i, t) for (i, t), c in zip(corpus, want) if c[1] != t})
    assert len(found) == again and set(found.values()) == set(counted)
    assert repeats.passage_words(frame(spark, [])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 70))) for _ in range(150)]
    b = ["".join(c for c in x if rng.random() > 0.02) + rng.choice(["", "a", "éé"]) for x in a]
    near = lambda d: [x if x <= edits else -1 for x in d]
    assert near(lines.banded_distance(a, b, edits)) == near(map(distance, a, b))


@pytest.mark.parametrize("hot", [1000, 20, 0])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randint(3, 50))) for _ in range(20)]

    def changed(x):
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice(["", "q", "é"]) + x[i + 1 :]
        return x or "a"

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 4)))) for i in range(50)] + [(200, None), (201, "")]
    counted = [(x.strip(lines._STRIP), i, k) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    counted = [c for c in counted if len(c[0]) >= 12]
    distinct = sorted({c[0] for c in counted})
    label = {x: x for x in distinct}
    for x in distinct:
        for y in distinct:
            if label[x] != label[y] and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                a, b = label[x], label[y]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    first = {}
    for x, i, k in counted:
        first.setdefault(label[x], (i, k))
    want = {i: [k for x, j, k in counted if j == i and first[label[x]] != (i, k)] for i, _ in rows}
    got = {r["doc_id"]: r for r in lines.line_dedup(frame(spark, rows), 2, 12).collect()}
    assert {i: sorted(r["gone"] or []) for i, r in got.items()} == want
    for i, t in rows:
        assert got[i]["text"] == (t if not want[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))
    assert lines.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_repeated_rows(spark):
    row = (1, "a line that is long enough to count\nshort")
    out = [r["text"] for r in lines.line_dedup(frame(spark, [row, row, (2, row[1])])).orderBy("doc_id").collect()]
    assert out == [row[1], row[1], "short"]


def lines_gone(rows, per=lines.PER):
    counted = [(x.strip(lines._STRIP), i, k) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(lines._STRIP)]
    distinct = sorted({c[0] for c in counted})
    label = {x: x for x in distinct}
    for x in distinct:
        for y in distinct:
            most = max(2, min(len(x), len(y)) // per)
            if label[x] != label[y] and min(len(x), len(y)) >= 24 and abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                a, b = label[x], label[y]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    first = {}
    for x, i, k in counted:
        first.setdefault(label[x], (i, k))
    return {i: [k for x, j, k in counted if j == i and first[label[x]] != (i, k)] for i, _ in rows}


@pytest.mark.parametrize("edits", [0, 3, 60])
def test_distances_of_long_lines_with_many_edits(edits):
    rng = random.Random(edits)
    base = "".join(rng.choice("abcdefé😀 ") for _ in range(400))
    a, b = [], []
    for n in (0, 1, 2, 3, 4, 40, 58, 60, 61, 80):
        x, y = list(base[rng.randrange(3) :]), list(base)
        for _ in range(n):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(2)] = rng.choice(["", "z", "é"])
        a += ["".join(x), "".join(y)]
        b += ["".join(y), "".join(x)]
    assert lines.banded_distance(a, b, edits).tolist() == [min(distance(x, y), edits + 1) for x, y in zip(a, b)]


def test_copies_into_blocks_grow_slower_than_the_square(spark):
    met = lines._met_windows(spark.range(2500).selectExpr("1L AS bucket", "id AS h", "true AS index"), 25)
    rows = lines._blocks(met, spark.range(2500).selectExpr("id AS h", "'x' AS line"), "lead")
    assert met.count() == 2500 and rows.count() == 2500 * 10  # 100 blocks of 25 would be 250,000 rows
    pairs = rows.groupBy("lo", "hi").agg(F.countDistinct("block").alias("n")).collect()
    assert sorted((r.lo, r.hi, r.n) for r in pairs) == [(i, j, 1 + (i != j)) for i in range(10) for j in range(i, 10)]


@pytest.mark.parametrize("per", [24, 64])
def test_line_dedup_edits_grow_and_short_lines_go(spark, monkeypatch, per):
    monkeypatch.setattr(lines, "FEW", 3)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgé ") for _ in range(n)).strip() for n in (30, 69, 73, 96, 200, 260)]

    def changed(x):
        for _ in range(rng.choice([0, 1, len(x) // per - 1, len(x) // per, len(x) * 6 // 5 // per])):
            i = rng.randrange(1, len(x) - 1)
            x = x[:i] + rng.choice(["", "q", x[i] + "é"]) + x[i + 1 :]
        return x

    rows = [(i, "\n".join([changed(rng.choice(base)), rng.choice(["}", "All rights", " ", "own %d" % i])])) for i in range(90)]
    want = lines_gone(rows, per)
    for bucket in (1000, 4):
        monkeypatch.setattr(lines, "BUCKET", bucket)
        got = {r["doc_id"]: sorted(r["gone"] or []) for r in lines.line_dedup(frame(spark, rows), per=per, exact=True).collect()}
        assert got == want


def test_within():
    rng = random.Random(8)
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 90)))
        b = "".join(rng.choice(["", c, c, c, c, c, "q", c + "b"]) for c in a)
        d = distance(a, b)
        assert [lines.within(a, b, k) for k in (d - 1, d, d + 1)] == [False, True, True]


@pytest.mark.parametrize("packed", [1, 2, 100])
def test_shared_keys_of_a_line_with_its_own_probe(monkeypatch, packed):
    import pyarrow as pa

    monkeypatch.setattr(lines, "PACKED", packed)
    rows = [(6, 1), (6, 2), (7, 2), (8, 3), (9, 3), (10, 4), (6, 1), (12, 5), (13, 6), (12, 5)]

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h")], ["key", "h"])

    for size in (1, 2, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]]), pa.array([r[1] for r in rows[i : i + size]])], ["key", "h"]) for i in range(0, 10, size)]
        for ranges in (1, 3):
            sent = pa.Table.from_batches(list(lines._packed(keys, ranges)(iter(batches)))).sort_by("range").to_batches()
            got = {tuple(x.values()) for b in lines._shared_keys(iter(sent)) for x in b.to_pylist()}
            assert got == {(3, 1, False), (3, 2, False), (3, 2, True), (6, 5, False), (6, 6, True)}


def test_window_keys_of_lines_within_the_edits():
    """Lines within their edits share a key, wherever the edits are: spread evenly, all in one place, or at random."""
    rng = random.Random(5)
    for per in (12, 64):
        least = lines.grown_from(lines.EDITS, per)
        for trial in range(150):
            a = "".join(rng.choice("abcd ") for _ in range(int(least * 2 ** rng.uniform(0, 3.5))))
            k = len(a) // per
            if trial % 3 == 0:
                at = {int(j * len(a) / (k + 1)) for j in range(1, k + 1)}
                b = "".join(("Z" if trial % 2 else "") if i in at else c for i, c in enumerate(a))
            elif trial % 3 == 1:
                b = a[: len(a) // 2] + "q" * k + a[len(a) // 2 :]
            else:
                at = set(rng.sample(range(len(a)), k))
                b = "".join(rng.choice(["", "x", c + "y"]) if i in at else c for i, c in enumerate(a))
            if min(len(a), len(b)) < least or not lines.within(a, b, min(len(a), len(b)) // per):
                continue
            texts = sorted([a, b], key=len)
            line, key = lines.window_keys(texts, per, least)
            assert set(key[line == 0]) & set(key[line == 1])


def test_rules(spark, corpus):
    word = re.compile("[^\x20\x09-\x0d]+")
    got = rules.quality_rules(frame(spark, [(i, t, "a" if (i or 0) % 2 else None) for i, t in corpus], DOC + ", source string"), min_words=5)
    for r in got.collect():
        t = next(t or "" for i, t in corpus if i == r["doc_id"])
        w = word.findall(t)
        where = {}
        for k in range(len(w) - 2):
            where.setdefault(tuple(w[k : k + 3]), []).append(k)
        cover = {k + d for v in where.values() if len(v) > 1 for k in v for d in range(3)}
        real = [x for x in t.split("\n") if word.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), len(cover))
        assert r["base_failed"] == (len(w) < 5 or 100 * len(cover) > 50 * len(w))
    assert got.count() == len(corpus)


def test_rules_remove_common_lines(spark):
    rows = [(i, f"menu home about contact\nonly document {i} has this line" if i < 30 else f"text {i} stands alone here", "h") for i in range(40)]
    out = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, DOC + ", source string"), min_words=3, line_documents=20).collect()}
    assert all(out[i]["n_removed_words"] == (4 if i < 30 else 0) and out[i]["kept"] for i in range(40))
    assert not any(r["kept"] for r in rules.quality_rules(spark.createDataFrame(rows, DOC + ", source string"), min_words=3, line_documents=20, depleted=0.3).where("doc_id < 30").collect())


def test_rules_count_documents(spark):
    schema = DOC + ", source string"
    copies = [(i, "the same page again", "h") for i in range(25)] + [(i, f"own text {i} of other", "h") for i in range(25, 40)]
    repeats = [(50, "one row that is repeated", "h")] * 25 + [(50, "another text of that id", "h")]
    out = rules.quality_rules(spark.createDataFrame(copies + repeats, schema), min_words=3).collect()
    assert len(out) == 66 and all((r["n_removed_words"], r["kept"]) == ((4, False) if r["doc_id"] < 25 else (0, True)) for r in out)
    many = spark.range(30000).selectExpr("id AS doc_id", "concat('own line ', id, if(id < 25, '\\nmenu home about us', '')) AS text", "'h' AS source")
    removed = rules.quality_rules(many, min_words=3).where("n_removed_words > 0").collect()
    assert sorted((r["doc_id"], r["n_removed_words"]) for r in removed) == [(i, 4) for i in range(25)]


def test_language_and_quality(spark):
    rng = random.Random(1)
    make = {"xx": lambda: "".join(rng.choice("abcd ") for _ in range(200)), "yy": lambda: "".join(rng.choice("cdef ") for _ in range(200))}
    rows = [(i, make[c](), c) for i in range(160) for c in [rng.choice(["xx", "yy"])]] + [(500, None, "xx"), (501, "12 3", None), (None, "abab", None)]
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    fold = langid.id_crc() % 4
    learn = docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = langid.predict(docs.withColumn("held_out", fold == 2), langid.fit(learn, learn.where(fold != 1), learn.where(fold == 1))).toPandas().set_index("doc_id")
    held = [(i, c) for i, _, c in rows[:160] if out.loc[i, "held_out"]]
    assert held and all(out.loc[i, "lang_pred"] == c for i, c in held) and out["score"].between(0, 1).all()
    assert out.loc[500, "lang_pred"] == out.loc[501, "lang_pred"] == "und"
    labels = spark.createDataFrame([(i, int(c == "xx")) for i, _, c in rows[:160]], "doc_id bigint, quality int")
    bad = docs.withColumn("text", F.when(F.col("lang") == "yy", F.concat(F.col("text"), F.repeat(F.lit(" spam"), 40))).otherwise(F.col("text")))
    scored = quality.score(bad.select("doc_id", "text"), quality.learn(bad, labels)).toPandas().set_index("doc_id")
    assert all((scored.loc[i, "score"] > 0.5) == (c == "xx") for i, _, c in rows[:160]) and len(scored) == len(rows)
    none = quality.learn(bad, labels.limit(0))
    assert quality.score(bad.select("doc_id", "text"), none).agg(F.min("score")).first()[0] == 0.5


def test_urls_follow_redirects(spark):
    link = '<html><link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.net/x", None), (2, "http://B.org/other", link.format("http://a.net/x#frag")), (3, "http://c.org/fr/ok", link.format("http://a.net/x")),
        (4, "http://d.org/", '<meta http-equiv="refresh" content="0; url=/moved">'), (5, "http://d.org/moved", None), (6, None, None), (7, "nothing", ""),
        (8, "http://e.org/p", link.format("http://sub.example.com/de/1")), (9, "http://www.example.net/en/1?q", ""), (10, "http://net.example.org", ""),
    ]
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.org", "/other", None, "block"), 3: ("c.org", "/fr/ok", "org/fr/", "allow"), 4: ("d.org", "/", None, "allow"), 5: ("d.org", "/moved", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("e.org", "/p", None, "block"), 9: ("www.example.net", "/en/1", "example.net/en/", "allow"), 10: ("net.example.org", "", None, "allow"),
    }


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6)]
    got = rows_of(topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id % 50 = 0", 5).select("query_id", "rank", "id", "score"))
    v = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x in rows[:360]}
    want = []
    for q in range(0, 360, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str)


def test_top_k_repeats_lengths_and_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(220)]
    rows += [rows[50]] * 9 + [rows[7]] * 3 + [(100, rows[3][1]), (50, rows[9][1])] + [(i, [float(x) for x in range(i % 3)]) for i in range(300, 360)] + [(None, [1.0] * 4), (400, None), (450, [])]
    schema = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame(rows, schema).withColumns({"id": F.lit("x"), "v": F.lit(1), "cell": F.lit(2)})
    for most in (1024, 3):
        got = rows_of(topk.top_k(df, "vec_id % 50 = 0", 5, most_pivots=most).select("query_id", "rank", "id", "score"))
        df.select("vec_id", "embedding").write.mode("overwrite").parquet(str(tmp_path / "e"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
        assert got == sorted(con.execute(topk.SQL["op10_topk"]).fetchall(), key=str) and len(got) >= 40
    assert topk.top_k(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0


def test_edge_rows_of_the_other_operators(spark):
    """Nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names."""
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "x " * 200_000, "en", "s"), (4, "z" * 1_000_000, "fr", "s"), (5, "same text\nhere", "fr", "t"), (5, "same text\nhere", "fr", "t"), (None, "un texte", "fr", None)]
    schema = DOC + ", lang string, source string"
    clash = {"score": F.lit("a"), "x": F.lit(1), "quality": F.lit("b"), "lines": F.lit(2), "key": F.lit(3), "host": F.lit(4), "held_out": F.lit(False), "count": F.lit(5)}
    docs = spark.createDataFrame(rows, schema).withColumns(clash)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored) and quality.score(docs.limit(0), model).count() == 0
    learn = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    language = langid.fit(learn, learn, learn)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.select("doc_id", "text", "held_out"), language).collect()}
    assert out[1] == out[2] == "und" and out[5] in ("en", "fr") and langid.predict(docs.select("doc_id", "text", "held_out").limit(0), language).count() == 0
    judged = rules.quality_rules(docs, min_words=2).collect()
    assert len(judged) == len(rows) and {r["n_words"] for r in judged if r["doc_id"] in (1, 2)} == {0} and rules.quality_rules(docs.limit(0)).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_decode(docs, path).collect()}
    assert coded[1] == coded[2] == 0 and coded[4] > 0
    cut = lines.line_dedup(docs, exact=True, per=lines.PER)
    assert cut.columns[: len(docs.columns)] == docs.columns and cut.count() == len(rows)
    pages = spark.createDataFrame([(1, "http://a.net/x", None), (1, "http://a.net/x", None), (None, None, "x")], "page_id bigint, url string, html string").withColumns(clash)
    assert [r["verdict"] for r in urls.judge(pages).orderBy("page_id").collect()] == ["allow", "block", "block"]
    assert urls.judge(pages.limit(0)).count() == 0


def test_pipeline_stages_edge_rows(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a text that comes twice as a row of its own", "en", "s", 43), (3, "a text that comes twice as a row of its own", "en", "s", 43), (4, "another line of text", "en", "s", 20)]
    schema = DOC + ", lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).withColumns({"rid": F.lit("r"), "gone": F.lit(1), "starts": F.lit(2), "_rid": F.lit(3), "h": F.lit(4)})
    for stage, left in ((corpus_pipeline.line_stage, 5), (corpus_pipeline.near_duplicate_stage, 4), (corpus_pipeline.repeat_stage, 5)):
        out = stage(spark, docs, None)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == left and out.where("doc_id = 1").first()["text"] is None
        assert stage(spark, docs.limit(0), None).count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs, None)
    assert packed.count() == 5 and corpus_pipeline.packing_stage(spark, docs.limit(0), None).count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= 4096).all()


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_pipeline_line_stage(spark):
    import corpus_pipeline

    licence = "This work is licensed under the terms given at the end of it."
    rows = [(0, licence), (1, licence), (2, licence + "\n" + "\n".join(f"verse {k} of two" for k in range(9))), (3, " \n" + licence + "\n\t"), (4, " \n"), (5, ""), (6, licence.replace("work", "text") + "\nx = 1\nx = 1")]
    gone, want = lines_gone(rows), []
    for i, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not gone[i] or left.strip(lines._STRIP):
            want.append((i, left, "en", "web", len(left)))
    assert [r[0] for r in want] == [0, 2, 4, 5, 6]
    assert rows_of(corpus_pipeline.line_stage(spark, as_docs(spark, rows), None)) == sorted(want, key=str)


def test_pipeline_near_duplicate_and_repeat_stages(spark, corpus):
    import corpus_pipeline

    rows = [(i, t) for i, t in corpus if i is not None and t is not None]
    kept = {i for i, least, _ in jaccard_brute(rows) if least == i}
    assert rows_of(corpus_pipeline.near_duplicate_stage(spark, as_docs(spark, rows), None)) == sorted({(i, t, "en", "web", len(t)) for i, t in rows if i in kept}, key=str)

    rng = random.Random(6)
    draw = lambda n: [rng.choice("ab bc cd de ef fg gh".split()) + str(rng.randrange(50)) for _ in range(n)]
    shared = draw(60)
    rows = [(0, shared), (1, draw(20) + shared + draw(9)), (2, draw(90)), (3, shared[:51]), (4, []), (5, ["x", *shared[3:52]])]
    seen, want = Counter(tuple(t[p : p + 50]) for _, t in rows for p in range(len(t) - 49)), []
    for i, t in rows:
        gone = {q for p in range(len(t) - 49) if seen[tuple(t[p : p + 50])] > 1 for q in range(p, p + 50)}
        left = " ".join("" if q in gone and q - 1 in gone else "|" if q in gone else c for q, c in enumerate(t) if not (q in gone and q - 1 in gone)).replace("|", "")
        if not gone or left.strip(lines._STRIP):
            want.append((i, left, "en", "web", len(left)))
    assert [r[0] for r in want] == [1, 2, 4, 5]
    assert rows_of(corpus_pipeline.repeat_stage(spark, as_docs(spark, [(i, " ".join(t)) for i, t in rows]), None)) == sorted(want, key=str)


def test_pipeline_quality_and_packing_stages(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    score = quality.score(docs, quality.learn(docs, labels)).select("doc_id", "score").collect()
    out = corpus_pipeline.quality_stage(spark, docs, folder)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in score if r["score"] >= 0.3)
    few = out.orderBy("doc_id").limit(40)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.packing_stage(spark, few, folder).toPandas()
    lengths = Counter({r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in few.collect()})
    assert got.groupby("doc_id")["length"].sum().to_dict() == dict(lengths)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 4096 and list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]


def test_bounded_sample(spark):
    from lithospark.llm.common import bounded_sample

    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    for rows in (1, 300, 4999, 6000):
        assert rows_of(bounded_sample(df, rows, order)) == rows_of(df.orderBy(*order).limit(rows))


def test_components_converge_or_fail(spark):
    from lithospark.llm.common import components

    edges = spark.createDataFrame([(k * 5 % 12, (k + 1) * 5 % 12) for k in range(11)], "src bigint, dst bigint")
    assert {r["root"] for r in components(edges, "path").collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, "path", 1)
