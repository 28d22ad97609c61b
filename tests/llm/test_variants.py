"""Spelling variants against loops over all words, and language identification."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from drivespan.llm import langid, registry, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) - {w}


def expected(n):
    letters = {c for w in n for c in w}
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    form = {}
    for w, xs in near.items():
        top = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(counted(docs))
    assert got(registry.op12_variants(spark, sf_dir)) == want and len(want) > 100


def test_odd_tables(spark):
    texts = [
        (1, None), (2, ""), (None, "Straße straßes " * 6), (3, "ÉCOLES écoles Écoles" * 9), (4, "abcdef abcdeg abcdefg " * 30 + "bbcdef " * 5), (4, "abcdef " * 200), (5, "aaaaaa " * 40 + "aaaaaaa " * 8 + "a" * 70000 + " "), (6, ("x" * 50000 + " ") * 5 + ("x" * 49999 + "y ") * 30),
        (7, "caféine cafeine " * 7 + "caféiné " * 5), (8, "××××××× " * 5 + "ābcdefg " * 9), *((k, "chain0 " * 6 + "chain01 " * 31 * (k % 2) + "chains " * 40) for k in range(100, 120)),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n", "'q' as word", "2 as id")
    want = expected({w: k for w, k in counted(texts).items() if len(w) < 1000})
    out = got(variants.variants(df))
    assert {w: x for w, x in out.items() if len(w) < 1000} == want
    long = {w[-3:]: x for w, x in out.items() if len(w) >= 1000}
    assert set(long) == {"xxx", "xxy"} and long["xxx"][2:] == (5, 1, 30) and long["xxx"][1].endswith("xy") and long["xxy"][0] is None
    assert got(variants.variants(df.limit(0))) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=6, max_size=8), min_size=1, max_size=60, unique=True), st.integers(1, 4))
def test_edits_of_a_vocabulary(words, tiny):
    """Every pair of near words is found whatever the passes, and only once."""
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint8)
    sizes = Counter(map(len, words))
    found = []
    for shards in variants.passes(sizes, 32 * tiny):
        tables = {}
        for s in shards:
            table = np.zeros((s.blocks, 4), np.uint64)
            own = [w for w in words if len(w) == s.length]
            h = variants.mixed(variants.hashes(variants.matrix(own)))
            h = h[s.ours(h)]
            for j, m in enumerate(variants.bits(h)):
                np.bitwise_or.at(table[:, j], s.block(h), m)
            tables.setdefault(s.length, []).append((s, table))
        found += [(words[i], e) for i, e in variants.edits(words, alphabet, tables, 64) if e in set(words)]
    letters = {c for w in words for c in w}
    want = {frozenset((w, x)) for w in words for x in edits(w, letters) if x in words}
    assert len(found) == len(want) and {frozenset(p) for p in found} == want


def test_words_not_listed_seldom_pass():
    rng = np.random.default_rng(1)
    h = variants.mixed(rng.integers(0, 1 << 63, 4000, np.uint64))
    shard = variants.passes({9: 4000})[0][0]
    table = np.zeros((shard.blocks, 4), np.uint64)
    for j, m in enumerate(variants.bits(h)):
        np.bitwise_or.at(table[:, j], shard.block(h), m)
    others = rng.integers(0, 1 << 63, 200000, np.uint64)
    assert len(variants._passed(others, [(shard, table)])) < 0.005 * len(others)


def test_crc_of_parts():
    heads, tails = ["", "12:", "é:"], ["", "word", "ß" * 300]
    a, b = np.meshgrid(np.arange(3), np.arange(3))
    crc = lambda x: np.array([zlib.crc32(x[k].encode()) for k in range(3)], np.uint32)
    out = variants.crc32_after(crc(heads)[a.ravel()], crc(tails)[b.ravel()], np.array([len(tails[k].encode()) for k in b.ravel()]))
    assert out.tolist() == [zlib.crc32((heads[i] + tails[j]).encode()) for i, j in zip(a.ravel(), b.ravel(), strict=True)]


def test_language_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = registry.op11_langid(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = docs.join(out, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.accepted for r in held) > 0.95 * len(held)


def test_language_edges(spark):
    own = ["the cat and the house were there with other people", "der Hund und das Haus waren dort mit anderen Leuten"]
    rows = [(k, f"{own[k % 2]} {'abc'[k % 3]}{k}", ("en", "de")[k % 2]) for k in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (None, "the house", "fr"), (103, own[0], None), (103, own[0], None), (104, own[1].upper() * 4000, None), (105, "q", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"text_read": F.lit("clash"), "Score": F.lit("x")})
    model = langid.fit(df)
    assert model.languages[0] in ("en", "de") and "fr" not in model.languages
    out = langid.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "text_read", "lang_pred", "score", "accepted"]
    said = {}
    for r in out.filter("doc_id >= 100 or doc_id is null").collect():
        said.setdefault(r.doc_id, []).append((r.lang_pred, r.accepted))
    assert [said[k][0] for k in (100, 101, 102)] == [("und", False)] * 3
    assert said[103] == [("en", True)] * 2 and said[104][0] == ("de", True) and said[None][0][0] == "en" and said[105][0] == (model.languages[0], False)
    assert [r.lang_pred for r in langid.predict(df, langid.fit(df.limit(0))).collect()] == ["und"] * len(rows + odd)
    assert langid.predict(df.limit(0), model).count() == 0
    assert len(langid.fit(df, rows=3).contents[0]) <= len(model.contents[0]) and langid.fit(df, most=1).languages == model.languages[:1]


def test_blocks_hold_whole_texts():
    words = langid.reduced(pa.array(["Ein Éin EIN ein2zwei", None, "x" * 10000]))
    assert words[0] == ["ein", "éin", "zwei"] and words[1] == []
    assert langid.reduced(pa.array(["\u0301 12 \u0300", "e\u0301 \u0301a", "", " "])) == [[], ["e\u0301", "\u0301a"], [], []]
    assert b"".join(b.removesuffix(langid.FILLER) for b in langid.blocks(words[2])) == b" " + b"x" * 10000 + b" "
