"""Quality, toxicity, URL filter and the pipeline."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from drivespan.llm import knn_quality, registry, toxicity, url_filter

TABLES = "documents pages benchmark labels".split()


def duck(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c.execute(sql).df()


def same(spark_df, duck_df):
    cols = sorted(duck_df.columns)
    clean = lambda df: sorted(tuple("null" if x is None or x != x else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert sorted(spark_df.columns) == cols
    assert clean(spark_df.toPandas()) == clean(duck_df)


def test_sql_twins(spark, sf_dir):
    for name, sql in registry.ORACLES.items():
        same(registry.QUERIES[name](spark, sf_dir), duck(sf_dir, sql))


def test_url_parts_and_rules(spark):
    urls = {
        1: "https://a.example.com/en/7x", 2: "http://WWW.Example.COM/en/8?q", 3: "http://example.net/de/81", 4: "http://b.example.net/de/9#x", 5: "no scheme/en/", 6: None, 7: "", 8: "x://Example.org", 9: "http://example.org/es/1", 10: "http://notexample.com/en/7", 11: "http://h?x=http://y/z",
    }
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("u", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("www.example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[4] == ("b.example.net", "/de/9", "net/de/", "allow")
    assert got[5][:3] == ("", "", None) and got[6] == ("", "", None, "allow") and got[7][0] == ""
    assert got[8][:2] == ("example.org", "") and got[9][3] == "block" and got[10][2] == "com/en/" and got[11][:2] == ("h", "")
    assert url_filter.judge(df.limit(0)).count() == 0
    long = "http://a.example.com/en/7" + "x" * 200000
    more = spark.createDataFrame([(1, long), (1, long), (2, "HTTP://www.Bad.net/x.html?y"), (3, None), (None, None), (4, "m.bad.net/x")], "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.net/x/",), (None,), ("no host",)], "url string")
    out = sorted((str(r.page_id), r.verdict, r.listed, len(r.path)) for r in url_filter.judge(more, listed).collect())
    assert out == [("1", "allow", False, 200005), ("1", "allow", False, 200005), ("2", "block", True, 7), ("3", "allow", False, 0), ("4", "allow", False, 0), ("None", "allow", False, 0)]


def test_listed_urls_by_filter_and_join(spark):
    urls = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("u"), "id")
    listed = urls.filter("id % 7 = 0").select("u").unionByName(spark.createDataFrame([(None,), ("u7",), ("gone",)], "u string"))
    got = sorted(r.id for r in url_filter.listed_hits(urls.unionByName(urls.filter("id = 14")), listed).collect())
    assert got == sorted([*range(0, 3000, 7), 14])
    table = url_filter.bloom_filter(listed, 64)
    assert table.count() <= 64 and url_filter.listed_hits(urls, listed.limit(0)).count() == 0


def test_quality_on_held_out(spark, sf_dir):
    got = registry.QUERIES["op9_knn_quality"](spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good words in a row here", "BAD!! BAD!! BAD!!", "", None, "x" * 50000] * 6)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 5 != 1) for i in range(30)] + [(None, True), (1, False)], "doc_id long, quality boolean").withColumn("quality", F.col("quality").cast("int"))
    out = knn_quality.score(docs, knn_quality.fit(docs, labels)).collect()
    assert len(out) == 30 and all(0 <= r.score <= 1 for r in out)
    empty = knn_quality.fit(docs, labels.limit(0))
    assert {r.score for r in knn_quality.score(docs, empty).collect()} == {0.5}
    assert knn_quality.score(docs.limit(0), empty).count() == 0


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, knn_quality.DIMS)).astype(np.float32)
    m = knn_quality.Model(x, rng.integers(0, 2, 60))
    texts = ["some words here", "OTHER!! WORDS!!", ""]
    own = m._unit((knn_quality.vectors(pa.array(texts)) - m.mean) @ m.directions)
    for got, v in zip(m.scores(pa.array(texts)), own, strict=True):
        cos = m.points @ v
        near = sorted(range(60), key=lambda i: -cos[i])[: knn_quality.K]
        w = np.maximum(cos[near], 1e-3).astype(float) ** knn_quality.POWER
        assert abs(got - (w * m.y[near]).sum() / w.sum()) < 1e-4


def test_votes_of_equally_near_neighbours():
    x = np.random.default_rng(1).normal(size=(3, knn_quality.DIMS)).astype(np.float32)
    x = np.concatenate([x, np.repeat(knn_quality.vectors(pa.array(["the same text"])), 60, axis=0)])
    y = np.r_[np.zeros(3), np.ones(30), np.zeros(30)]
    m = knn_quality.Model(x, y)
    assert m.scores(pa.array(["the same text", "the same text"])).tolist() == [1.0, 1.0]  # the first 25 of sixty equals


def test_toxicity_transducers():
    g = toxicity.Grammar({"fool": 4.0, "blarg*": 4.0}, (-4.0, 3.0))
    total = lambda t: round(g.sums(pa.array([t]))[0][0], 9)
    alone, met = 4.0 * toxicity.ALONE, 4.0 * toxicity.TARGET_GAIN
    assert total("a fool walks") == alone and total("blarghens walk") == alone
    assert total("you fool") == met and total("fool, you") == met and total("fool a b c d you") == alone
    assert total("not a fool") == round(alone * toxicity.NEGATION_LOSS, 9)
    said = round(met * toxicity.REPORT_LOSS, 9)
    assert total("he said fool") == said and total("fool, he said") == said and total("a b c fool d e f g h said") == round(alone * toxicity.REPORT_LOSS, 9)
    assert total("never. fool") == alone  # the clause has ended
    assert total("i will kill you") == toxicity.THREAT_WEIGHT and total("i will kill time") == 0
    assert total("she was killing them") == toxicity.THREAT_WEIGHT and total("er zerstörte dich") == toxicity.THREAT_WEIGHT and total("killjoys you") == 0
    assert total("") == 0 and g.sums(pa.array([None], pa.string()))[0][0] == 0
    assert total("you fool. " * 5000) == round(5000 * met, 9)
    assert g.scores(pa.array(["clean text"]))[0] < 0.1 < 0.7 < g.scores(pa.array(["you fool"]))[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14))
def test_composed_transducers_against_their_meaning(symbols):
    """Each arc by looking left and right in the clause."""
    weights = [2.0 if s == toxicity.INSULT else 0.0 for s in symbols]
    total = 0.0
    for i, s in enumerate(symbols):
        left, right = symbols[max(0, i - toxicity.REACH) : i], symbols[i + 1 : i + 1 + toxicity.REACH]
        tamed = (toxicity.NEGATION_LOSS if toxicity.NEGATION in left else 1.0) * (toxicity.REPORT_LOSS if toxicity.REPORT in symbols[:i] + symbols[i + 1 :] else 1.0)
        if s == toxicity.INSULT:
            total += 2.0 * tamed * (toxicity.TARGET_GAIN if toxicity.TARGET in left + right else toxicity.ALONE)
        if s == toxicity.TARGET and toxicity.THREAT in left:
            total += toxicity.THREAT_WEIGHT * tamed
    assert abs(toxicity.clause_score(symbols, weights) - total) < 1e-9


def test_toxicity_on_held_out(spark, sf_dir):
    got = registry.QUERIES["op7_toxicity"](spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.85 and not held[held.toxic == 0].predicted.any()


def test_toxicity_learns_terms(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        w = [f"w{rng.integers(60)}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.integers(30)] = f"zork{rng.integers(9)}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id long, text string").withColumn("matched_clauses", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert all((out[i] >= 0.7) == bool(y) for i, y in labels) and out[900] < 0.7 and out[901] < 0.7
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, marks.limit(0))).count() == 0


def test_clauses_beat_isolated_words(spark):
    """The same insults stand in toxic rows and, negated or reported, in clean ones: without the arcs they tell nothing apart."""
    rng = np.random.default_rng(3)
    insults, filler = toxicity.INSULTS, [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(rng.choice(filler, n))
    rows = []
    for i in range(420):
        word, toxic = insults[i % len(insults)], int(i % 3 == 0)
        clause = [f"you are a {word} and {say(3)}", f"{word} {say(2)} you {say(2)}"][i % 2] if toxic else [f"she said that {say(2)} you {word}", f"he was never a {word} {say(4)}", f"{say(6)} {word} {say(6)}"][i % 3 - 1 if i % 7 else 2]
        rows.append((i, f"{say(12)}. {clause}. {say(9)}.", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    texts, y = pa.array([r[1] for r in held]), np.array([r[2] for r in held])

    def auc(x):
        above, level = (x[y == 1][:, None] > x[y == 0][None, :]).mean(), (x[y == 1][:, None] == x[y == 0][None, :]).mean()
        return above + level / 2

    by_arc, _ = grammar.arc_sums(texts)
    words = by_arc[:, :8].sum(axis=1)
    assert auc(by_arc @ grammar.arcs) > 0.97 > 0.75 > auc(words)
    assert ((grammar.scores(texts) >= 0.7) == y).mean() > 0.9


def test_fitted_arcs_follow_the_labels():
    rng = np.random.default_rng(4)
    x = np.zeros((400, len(toxicity.ARCS)))
    x[np.arange(400), rng.integers(0, 4, 400)] = 3.0
    x[:40] = 0
    y = (x[:, 1] > 0).astype(float)  # only what is reported is toxic, against the weights that arcs begin with
    arcs = toxicity._fitted_arcs(x, y)
    total = x @ arcs
    assert total[y == 1].min() > total[y == 0].max() and (arcs[4:] == toxicity.ARCS[4:]).all()


def test_pipeline_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, n = docs, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, sf_dir)
        assert out.columns == docs.columns
        at = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < at.count() <= n
        n = at.count()
        if k == 1:
            assert at.filter("n_chars <> length(text)").count() == 0
    run = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(run) == n and set(run.doc_id) == {r.doc_id for r in at.collect()}


def test_pipeline_edges(spark, sf_dir):
    rows = [(1, "plain words stand here in a row today", "en", "s", 37), (1, "plain words stand here in a row today", "en", "s", 37), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "plain words stand here in a row today", "en", "s", 37)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 1
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
