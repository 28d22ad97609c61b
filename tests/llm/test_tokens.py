"""Wavelet files, byte BPE, media and the language model."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from drivespan.llm import byte_bpe, maxent, media, registry, wavelet

TEXTS = ["Hello, World!  It's 123abc", "", None, "a" * 3000, "  \n\tx y　z\x1c", "ΑΣ Σ ΟΔΟΣ İ é \u0301", "<|endoftext|> and <|startoftext|>", "🙂👍🏽 漢字 don't", "same", "same"]
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "row": F.lit(3), "lang": F.lit(None).cast("string")})


def oracle():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, docs):
    e = oracle()
    back = byte_bpe.decode(byte_bpe.encode(docs, BYTE, P.PATTERN), BYTE, P.PATTERN)
    for r in back.collect():
        assert r.ids == e.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.bytes).decode() == (TEXTS[r.doc_id] or "")
    assert byte_bpe.encode(docs.limit(0), BYTE, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_bpe_on_any_text(texts):
    e, bpe = oracle(), byte_bpe.loaded(BYTE, P.PATTERN)
    ids, n = bpe.encode(texts)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == [e.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids, n) == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abehinst", min_size=1, max_size=400) | st.text(st.characters(min_codepoint=0x3040, max_codepoint=0x30FF), min_size=1, max_size=60) | st.integers(2, 300).map(lambda n: "ab" * n) | st.integers(2, 300).map(lambda n: "a" * n), max_size=4))
def test_long_rows_merge_repeats_together(texts):
    e, bpe = oracle(), byte_bpe.loaded(BYTE, P.PATTERN)
    old, byte_bpe.LONG = byte_bpe.LONG, 8
    try:
        ids, n = bpe.encode(texts)
    finally:
        byte_bpe.LONG = old
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [e.encode_ordinary(t) for t in texts]


def test_words_of_a_megabyte():
    import time

    rng = np.random.default_rng(4)
    e, bpe = oracle(), byte_bpe.loaded(BYTE, P.PATTERN)
    for letters in ("etaoinshrdlu", "a", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
        text = "".join(rng.choice(list(letters), 1 << 20))
        began = time.time()
        ids, _ = bpe.encode([text])
        assert time.time() - began < 120
        if letters != "a":  # the library needs quadratic time for that one
            assert ids[:20000].tolist() == e.encode_ordinary(text[:200000])[:20000]
        assert bpe.decode(ids, np.array([len(ids)])) == [text.encode()]


def test_op6_digests_against_the_library(spark, sf_dir):
    e = oracle()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = registry.QUERIES["op6_byte_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        ids = e.encode_ordinary(r.text or "")
        own = got.loc[r.doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500))
def test_wavelet_against_a_list(ids):
    m = wavelet.WaveletMatrix.build(np.array(ids, np.int64), 6)
    assert m.all().tolist() == ids
    for t in set(ids) | {41}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert m.count(t) == len(places)
        if places:
            assert m.select(t, len(places) - 1) == places[-1] and m.select(t, 0) == places[0]
            assert m.rank(t, len(ids) // 2) == sum(p < len(ids) // 2 for p in places)
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]


def test_wavelet_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)  # as it is: the strings of special tokens are special tokens
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]
    files = wavelet.shards(docs, WORD, file_tokens=20, partitions=3).cache()
    got = sorted(wavelet.read_back(files).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, ids in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token = want[0][0]
    assert sum(r["count"] for r in wavelet.occurrences(files, token).collect()) == sum(ids.count(token) for ids in want)
    assert wavelet.read_back(wavelet.shards(docs.limit(0), WORD)).count() == 0
    # null, repeated and extreme ids, many of them in one range
    rows = [(None, "null one"), (None, "null two"), (-(2**63), "least"), (2**63 - 1, "most"), (5, "five a"), (5, "five b"), (5, None)]
    back = wavelet.read_back(wavelet.shards(spark.createDataFrame(rows, "doc_id long, text string"), WORD, partitions=4)).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, None, -(2**63), 5, 5, 5, 2**63 - 1]
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30) | st.lists(st.sampled_from(["Don't", "<|endoftext|>", "<|ENDOFTEXT|>", "x.", "É***", "ß$'s", "a1b", " ", "\u0301", "fooİ", "###", "'ll", "hello,", "wörld!?"]), max_size=8).map(" ".join), max_size=5))
def test_word_encoder_on_any_text(texts):
    from tokenizers import Tokenizer

    if "t" not in _KEPT:
        _KEPT["t"], _KEPT["e"] = Tokenizer.from_file(WORD), wavelet.WordEncoder(WORD)
    ids, n = _KEPT["e"].encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [_KEPT["t"].encode(t, add_special_tokens=False).ids for t in texts]


_KEPT = {}


def test_word_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(wavelet.WordEncoder, "KEPT", 3)
    e = wavelet.WordEncoder(WORD)
    want = wavelet.WordEncoder(WORD).encode(pa.array(["a b c d e f g, h. i"]))[0].tolist()
    for _ in range(4):
        assert e.encode(pa.array(["a b c d e f g, h. i"]))[0].tolist() == want


def test_wavelet_file_opens_few_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 1 << 10)
    ids = np.random.default_rng(0).integers(0, 50000, 40000)
    blob = wavelet.pack(np.arange(2), np.ones(2, bool), np.array([30000, 10000]), ids, 16)
    who, known, n, m = wavelet.unpack(blob)
    opened, inner = [], m.block
    m.block = lambda level, b: opened.append((level, b)) or inner(level, b)
    assert m.access(777) == ids[777] and len(set(opened)) <= 16
    opened.clear()
    token = int(ids[20000])
    places = np.flatnonzero(ids == token)
    assert m.count(token) == len(places) and m.select(token, len(places) - 1) == places[-1] and len(set(opened)) <= 6 * 16
    assert m.all().tolist() == ids.tolist() and known.all() and n.tolist() == [30000, 10000] and who.tolist() == [0, 1]


def test_media_payloads(spark, docs):
    got = {r.doc_id: r for r in media.stored_features(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.media_bytes == len(media.png(full)) and r.media_sha256 == hashlib.sha256(media.png(full)).hexdigest() and media.samples(media.png(full)) == full
    assert got[8].feature == got[9].feature and got[8].media_sha256 == got[9].media_sha256
    assert media.stored_features(docs.limit(0)).count() == 0


def test_html_sequence_order_and_captions():
    html = '<html><head><title>t</title></head><body><nav>no</nav><p>one <b>two</b></p><figure><img src="digest:aa" alt="x"><figcaption>cap &amp; tion</figcaption></figure>tail<img src="b" alt="alt"><script>var x</script></body></html>'
    got = media.parse(html)
    assert [(x["pos"], x["kind"], x["text"], x["ref"], x["caption"]) for x in got] == [(0, "text", "one two", None, None), (1, "media", None, "digest:aa", "cap & tion"), (2, "text", "tail", None, None), (3, "media", None, "b", "alt")]
    assert media.parse(None) == [] and media.parse("<p>  </p>") == []


def test_interleaved_sequences(spark):
    html = '<h1>top</h1><img src="digest:aa" alt="one">between<figure><img src="digest:none"><figcaption>two</figcaption></figure><img src="http://x/y.png"><p>end</p>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>only text</p>"), (None, '<img src="digest:aa">')], "page_id long, html string").withColumn("items", F.lit("clash"))
    found = spark.createDataFrame([("aa", 7, "f")], "digest string, media_bytes long, feature string")
    got = {r.page_id: r.sequence for r in media.interleaved(media.sequences(pages, "page_id"), found, "page_id").collect()}
    assert [(x.pos, x.kind, x.text, x.ref, x.caption, x.payload and x.payload.media_bytes) for x in got[1]] == [
        (0, "text", "top", None, None, None), (1, "media", None, "digest:aa", "one", 7), (2, "text", "between", None, None, None),
        (3, "media", None, "digest:none", "two", None), (4, "media", None, "http://x/y.png", None, None), (5, "text", "end", None, None, None),
    ]
    assert got[2] == [] and [x.text for x in got[3]] == ["only text"] and set(got) == {1, 2, 3, None}
    assert media.interleaved(media.sequences(pages.limit(0), "page_id"), found, "page_id").count() == 0


def test_interleaved_pages_of_the_table(spark, sf_dir):
    """Real pages: the order of the text items is the order in the HTML."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = spark.createDataFrame([], "digest string, media_bytes long")
    got = {r.page_id: r.sequence for r in media.interleaved(media.sequences(pages, "page_id"), none, "page_id").collect()}
    assert len(got) == pages.select("page_id").distinct().count()
    for r in pages.limit(20).collect():
        want = [x["text"] for x in media.parse(r.html)]
        assert [x.text for x in got[r.page_id]] == want and [x.pos for x in got[r.page_id]] == list(range(len(want)))


def test_language_model(spark):
    say = ["the cat sat on the mat", "der hund läuft über die straße", "THE CAT ran", "", None, "qqq zzz new word", "the the the"]
    rows = [(i, say[i % len(say)]) for i in range(140)] + [(None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = maxent.score_texts(df, epochs=1).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(x for i, t in rows if i not in held for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens(dict(rows)[r.doc_id])
        assert r.held_out == (r.doc_id in held) and r.n_tokens == len(t) and r.train_tokens == n and r.n_known == sum(x in c for x in t)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r.score < 0
    both = [r for r in got if r.held_out]
    assert sum(r.score for r in both) > sum(r.base_score for r in both)
    assert maxent.score_texts(df.limit(0)).count() == 0


def test_tail_words_take_their_counts_from_the_join(spark, monkeypatch):
    rows = [(i, f"common words and rare{i % 7} ones x{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.base_score, r.n_known) for r in maxent.score_texts(df).collect()}
    monkeypatch.setattr(maxent, "HEAD", 3)
    monkeypatch.setattr(maxent, "SINGLES", 2)
    got = {r.doc_id: (r.base_score, r.n_known) for r in maxent.score_texts(df).collect()}
    assert all(math.isclose(got[k][0], want[k][0], rel_tol=1e-9) and got[k][1] == want[k][1] for k in want)


def test_class_probabilities_sum_to_one():
    v = maxent.Vocabulary(10, 3, [(1, 70, 6), (2, 71, 3), (3, 70, 1)], [(70, 7, 2), (71, 3, 1)])
    w = maxent.Weights(v.buckets)
    w.group[:] = np.random.default_rng(0).normal(size=w.group.shape)
    t = maxent.Tokens(pa.array(["a b c a"]), v)
    p, q, _ = w.forward(t.features, t.cls)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(q.sum(axis=1), 1)


def test_scores_against_a_plain_recomputation(spark):
    """Each token's P(group) P(class) P(word) from the trained tables, one token after another."""
    say = ["the cat sat on the mat again", "der hund läuft über", "x1 ### the cat", "", "qqq zzz"]
    df = spark.createDataFrame([(i, say[i % 5]) for i in range(60)], "doc_id long, text string")
    counts = maxent.counted(df).cache()
    v = maxent.vocabulary(counts)
    w = maxent.trained(df, v)
    got = {r.doc_id: r.score for r in maxent.scored(df.withColumn("held_out", F.lit(False)), counts, v, w).collect()}
    c = {r.h: r.c for r in counts.collect()}
    for i in range(5):
        t = maxent.Tokens(pa.array([say[i]]), v)
        total = 0.0
        for k, cls in enumerate(t.cls.tolist()):
            g, f = cls // maxent.MEMBERS, t.features[k]
            a = np.exp(sum(w.group[x].astype(float) for x in f))
            b = np.exp(sum(w.member[x * maxent.GROUPS + g].astype(float) for x in f))
            total += math.log10(a[g] / a.sum()) + math.log10(b[cls % maxent.MEMBERS] / b.sum())
            if cls >= maxent.SINGLES:
                total += math.log10((c.get(int(t.h[t.at[k]]), 0) + 0.5) / (v.class_total[cls] + 0.5 * (v.class_words[cls] + 1)))
        assert math.isclose(got[i], total, rel_tol=1e-4), i


def test_the_table_grows_with_the_counted_words():
    size = lambda n: maxent.Vocabulary(n, n, [], []).buckets
    assert [size(n) for n in (0, 1000, 64 * 4096, 64 * 5000, 64 * 10**4, 10**9)] == [4096, 4096, 4096, 8192, 8192, 8192]


def test_orders_of_wide_keys():
    x = np.random.default_rng(3).integers(0, 1 << 18, 5000)
    assert maxent._order(x).tolist() == np.argsort(x, kind="stable").tolist() and maxent._order(x[:0]).tolist() == []


def test_form_classes_do_not_depend_on_the_batch():
    words = ["straße.", "ñu", "éa", "漢字", "abc!?", "...", "a", "ab", "x###", "*", "word", "ñ$"]
    whole = maxent.form_classes(pa.array(words, pa.large_string()))
    assert [int(maxent.form_classes(pa.array([w], pa.large_string()))[0]) for w in words] == whole.tolist()
    assert (maxent.form_classes(pa.array(["xx", *words], pa.large_string())[1:]) == whole).all()
    assert [x // maxent.MEMBERS for x in whole.tolist()][:4] == [5, 6, 7, 7] and whole[8] // maxent.MEMBERS == 4 and whole[10] // maxent.MEMBERS >= 8 and not len(maxent.form_classes(pa.array([], pa.large_string())))


def test_op1_op6_on_the_smallest_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert registry.QUERIES["op1_wavelet"](spark, sf_dir).count() == n
    assert registry.QUERIES["op6_byte_bpe"](spark, sf_dir).count() == n
