"""Open tags, repeated ids, clashing columns, and passages in repetitive texts."""

import time
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drivespan.llm import byte_bpe, decontam, knn_quality, line_dedup, media, simhash, toxicity


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>T</title><meta x><p>One <img src=a alt=b> two</p><p>three", ["One", ("a", "b"), "two", "three"]),
        ("<html><head><title>T</title>Plain text<p>One", ["Plain text", "One"]),
        ("<body><nav><a>links</a><p>Main text<img src=q></body></html>", ["links", "Main text", ("q", None)]),
        ("<body><div><nav><a>links</a></div><p>Main text</body>", ["Main text"]),
        ("<nav>a<nav>b</nav>c</nav>d", ["d"]),
        ("<figure><img src=1><figcaption>cap <b>bold</b></figure><p>after</p>", [("1", "cap bold"), "after"]),
        ("<figure><img src=1><figcaption>cap<p>later text</p><p>more</p>", [("1", "cap"), "later text", "more"]),
        ("<script>x<b>y</script>t<style>p{}", ["t"]),
    ],
)
def test_open_tags_lose_nothing(html, want):
    got = media.parse(html)
    assert [x["text"] or (x["ref"], x["caption"]) for x in got] == want and [x["pos"] for x in got] == list(range(len(got)))


def test_samples_are_bounded_on_repeated_ids(spark):
    docs = spark.range(400).selectExpr("id % 20 as doc_id", "concat('text number ', id) as text")
    labels = spark.range(20).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    rows = knn_quality.sample(docs, labels.unionByName(labels), "quality", "false", 4).collect()
    assert len(rows) == 4 and len({r.text.split()[-1] for r in rows}) == 4
    assert len(knn_quality.fit(docs, labels, rows=4).y) == 4
    assert toxicity.fit(docs, labels, rows=3).curve is not None


def test_clashing_columns_stay(spark):
    names = ["__text", "text_read", "text_read_", "gone", "id", "hash", "left", "lines_read", "lines_gone", "__gone", "__id", "__hash", "__left", "text_hash", "digest", "fp", "n", "keys"]
    docs = spark.createDataFrame([(1, "one short text of six words"), (2, None), (2, ""), (None, "x")], "doc_id long, text string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, "another item of quite different words altogether")], "item_id long, text string")
    want = [tuple(range(len(names)))]
    for out in (
        knn_quality.score(docs, knn_quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels)), line_dedup.dedup(docs), line_dedup.dedup(docs, copies=0.8),
        simhash.near_dedup(docs), simhash.similar_dedup(docs), decontam.clean(docs, bench), byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    ):
        assert out.select(*(f"`{c}`" for c in names)).distinct().collect() == want


def test_items_in_several_passes(spark, monkeypatch):
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    bench = spark.createDataFrame([(k, say(k)) for k in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {say(k)} after" if k < 5 else None if k == 5 else f"nothing here {k}") for k in range(9)], "doc_id long, text string")
    one = sorted((r.doc_id, r.item_id, r.start) for r in decontam.passages(docs, bench).collect())
    monkeypatch.setattr(decontam, "PASS_ITEMS", 2)
    assert sorted((r.doc_id, r.item_id, r.start) for r in decontam.passages(docs, bench).collect()) == one and len(one) == 5
    assert sorted(r.doc_id for r in decontam.clean(docs.withColumn("digest", F.lit(1)), bench).collect()) == [5, 6, 7, 8]


def test_passages_of_repetitive_texts_in_bounded_memory():
    cycle = [f"c{k}" for k in range(300)]
    index = decontam.Index([(1, " ".join(cycle))])
    text = pa.array([" ".join(cycle * 330)])
    tracemalloc.start()
    began = time.time()
    found = index.hits(text)
    assert tracemalloc.get_traced_memory()[1] < 600 << 20 and time.time() - began < 120
    tracemalloc.stop()
    assert [(i, s) for _, i, s, _ in found] == [(1, 0)] and found[0][3] == pytest.approx(1.0)
    before = decontam.PAIRS
    try:
        decontam.PAIRS = 50  # small turns give the same passages
        rng = np.random.default_rng(2)
        words = [f"c{k}" for k in np.where(rng.random(900) < 0.9, np.arange(900) % 300, rng.integers(0, 300, 900))]
        small = index.hits(pa.array([" ".join(words)]))
        decontam.PAIRS = before
        assert small == index.hits(pa.array([" ".join(words)]))
    finally:
        decontam.PAIRS = before
