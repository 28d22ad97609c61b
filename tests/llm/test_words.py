"""SimHash, decontamination, line dedup and the shared word batches against brute force."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from drivespan.llm import decontam, line_dedup, registry, shared, simhash
from drivespan.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def brute_print(text, width=3):
    w = words(text)
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_word_lists_on_every_slice():
    texts = ["Ab\tC\x0bd é\x1cx ", None, "", "one  two\n\nTHREE ", "Ä ö " * 50] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    seen = 0
    for part in shared.slices(batch, "text", 300):
        flat, counts = shared.word_lists(part.column("text"))
        want = [words(t) for t in texts[seen : seen + part.num_rows]]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.cast(pa.large_binary()).to_pylist() == [x for w in want for x in w]
        seen += part.num_rows
    assert seen == len(texts)


def test_fingerprints_and_groups(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee in a quiet tower by the sea ".split() * 6
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1]), "a b", "A  B", "", None, "x", " ".join(reversed(base)), "one two three"]
    rng = np.random.default_rng(1)
    for _ in range(30):
        t = base.copy()
        t[rng.integers(len(t))] = f"w{rng.integers(9)}"
        texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(7))
    got = simhash.groups(simhash.fingerprints(df)).collect()
    prints = [brute_print(t) for t in texts]
    comp = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert len(got) == len(rows)
    for r in got:
        if r.id is None:
            assert r.component_id is None
        else:
            assert r.fp & (2**64 - 1) == prints[r.id] and r.component_id == comp[r.id]


def test_large_buckets_give_the_same_components(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 300:
        x = centre
        for b in rng.integers(0, 64, size=int(rng.integers(1, 5))):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    old = simhash.SMALL_BUCKET, simhash.SLOT
    simhash.SMALL_BUCKET, simhash.SLOT = 8, 20
    try:
        got = {r.id: r.component_id for r in simhash.groups(spark.createDataFrame([(i, f, 3) for i, f in enumerate(signed)], "id long, fp long, n_words long")).collect()}
    finally:
        simhash.SMALL_BUCKET, simhash.SLOT = old
    comp = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[i] for i in range(len(fps))] == comp


def test_near_dedup_keeps_columns_and_one_of_each(spark):
    rows = [(5, "same text here today", "en", "s", 1), (2, "same text here today", "en", "s", 1), (9, "other words entirely now", None, None, None), (None, "same text here today", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 9, None]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_near_dedup_on_repeated_ids(spark):
    one, two = "one two three four five", "entirely other words stand here"
    rows = [(1, one, None, None, 1), (2, one, None, None, 2), (2, two, None, None, 3), (3, two, None, None, 4), (4, "a row of its own", "x", None, 5), (4, "a row of its own", "x", None, 5), (5, None, None, None, 6), (5, "", None, None, 7)]
    for of in (simhash.near_dedup, simhash.similar_dedup):
        got = sorted((r.doc_id, r.text) for r in of(spark.createDataFrame(rows, DOCS)).collect() if r.doc_id < 5)
        assert got == [(1, one), (2, two), (4, "a row of its own")]
    assert simhash.agreeing(10**6, 3) == 2 and simhash.agreeing(10**10, 3) == 3


def test_links_do_not_depend_on_the_number_of_agreeing_blocks(spark):
    rng = np.random.default_rng(8)
    fps = set()
    for _ in range(60):
        x = int(rng.integers(1 << 63))
        fps |= {x, *(x ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 63, (4, 2)))}
    prints = spark.createDataFrame(list(enumerate(sorted(fps))), "id long, fp long")
    got = [{r.id: r.component_id for r in simhash.groups(prints, agree=k).collect()} for k in (1, 2, 3)]
    assert got[0] == got[1] == got[2] and len(set(got[0].values())) < len(fps)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (300, 300), (None, 5), (1000, 1001)] + [(5000, k) for k in range(5001, 5200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[300] == 200 and got[5100] == 5000 and got[1001] == 1000
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination_finds_planted_passages(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("lin", "tor", "mas", "ped", "x")]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(5, 70, 40))] + [(100, None), (101, ""), (102, "tiny item")]
    docs = [(i, say(300)) for i in range(30)]
    planted = []
    for k in range(40):
        w = say(int(rng.integers(0, 90))).split()
        docs.append((100 + k, " ".join([*w, items[k][1].upper(), *say(40).split()])))
        planted.append((100 + k, k))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (None, items[3][1]), (903, "a tiny item here")]
    got = decontam.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)))
    pairs = [(r.doc_id, r.item_id) for r in got.collect()]
    assert set(planted) <= set(pairs)
    assert not [p for p in pairs if p[0] is not None and p[0] < 100]
    assert pairs.count((902, 3)) == 2 and (None, 3) in pairs and (903, 102) in pairs
    more = [*docs, (901, "another text of this id"), (902, "and a clean one of that")]
    kept = [r.doc_id for r in decontam.clean(spark.createDataFrame(more, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert set(kept) >= set(range(30)) | {900, 901, 902} and not set(kept) & {p[0] for p in planted}
    assert kept.count(901) == 2 and kept.count(902) == 1 and None not in kept
    decontam.PASS_ITEMS, old = 7, decontam.PASS_ITEMS
    try:
        again = decontam.clean(spark.createDataFrame(more, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(r.doc_id for r in again) == sorted(kept)
    finally:
        decontam.PASS_ITEMS = old
    assert decontam.passages(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_items_of_thirty_thousand_words():
    rng = np.random.default_rng(9)
    long = [f"w{i}" for i in rng.integers(0, 5000, 30000)]
    copy = list(long)
    copy[15000:15010] = ["new"] * 12
    got = decontam.Index([(1, " ".join(long))]).hits(pa.array([" ".join(["before", *copy, "after"]), " ".join(long[:20000])]))
    assert [g[:3] for g in got] == [(0, 1, 1)] and got[0][3] > 0.99


def test_every_offset_of_an_item_is_seen():
    for n in range(1, 120):
        size, stride = decontam.window_of(n)
        assert size <= n and (n - size + 1 >= stride)


def test_line_dedup_cases(spark):
    note = "Posted by user 17 on 2024-01-0{} at noon today"
    rows = [(i, f"{chr(97 + i) * 4} alone stands {chr(97 + i) * 5} here\n{note.format(i)}\nshared footer line\n\nlast {chr(97 + i) * 3}") for i in range(6)]
    rows += [(50, None), (51, ""), (None, "shared footer line"), (52, "shared footer line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("other", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert len(got) == len(rows)
    assert got[0].n_dropped == 0 and "shared footer line" in got[0].text
    assert got[1].text == "bbbb alone stands bbbbb here\n\nlast bbb" and got[1].n_lines == 5 and got[1].n_dropped == 2
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == "" and got[52].text == "" and got[None].text == "shared footer line"
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_templates_generalise_words(spark):
    names = "anna bert carl dora emil fred".split()
    rows = [(i, f"dear valued reader of this page {n} thank you for coming back again") for i, n in enumerate(names)] + [(9, "dear valued reader of quite another kind of text that only starts alike here")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 6)}, 9: 0}


def test_op10_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = registry.QUERIES["op10_simhash"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        assert got.loc[r.doc_id, "fingerprint"] == f"{brute_print(r.text):016x}"


def test_similar_dedup_links_by_blocks_of_fingerprints(spark, monkeypatch):
    """Without any band in common, near copies whose fingerprints lie within the blocks' radius still meet, and only those of exact similarity go."""
    rng = np.random.default_rng(6)
    bases = [[f"w{i}" for i in rng.integers(0, 3000, 400)] for _ in range(12)]
    rows = [(k, " ".join(b)) for k, b in enumerate(bases)] + [(100 + k, " ".join([*b, f"z{k}"])) for k, b in enumerate(bases)]
    docs = spark.createDataFrame([*rows, (300, ""), (301, "far away")], "doc_id long, text string")
    near = {r.id: r.fp for r in simhash.shingle_prints(docs).collect()}
    want = {k for k in range(12) if (near[k] ^ near[100 + k]).bit_count() <= simhash.LINKED}
    assert len(want) > 8
    prints = simhash.shingle_prints
    monkeypatch.setattr(simhash, "shingle_prints", lambda *a: prints(*a).withColumn("keys", F.when(F.col("n") > 0, F.array(F.xxhash64("id"))).otherwise(F.col("keys"))))
    gone = {100 + k for k in want}
    assert {r.doc_id for r in simhash.similar_dedup(docs).collect()} == {k for k, _ in rows} - gone | {300, 301}


def test_similar_dedup_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    rows = []
    for k in range(60):  # pairs and chains with one word in about 80 replaced, inserted or deleted: similarity about 0.8
        base = say(int(rng.integers(45, 300)))
        for _ in range(3 if k else 30):
            copy = base.copy()
            for at in rng.choice(len(base), max(1, len(base) // 80), replace=False):
                copy[at] = [f"x{rng.integers(9**6)}", f"{copy[at]} y{rng.integers(9**6)}", ""][int(rng.integers(3))]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, "too short"), (len(rows) + 2, "Too  short")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for _, t in rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = union_find(len(rows), near)
    assert len(near) > 150
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").withColumn("sig", F.lit("clash"))
    want = {i for i in range(len(rows)) if comp[i] == i} | {None}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()} == want
    monkeypatch.setattr(simhash, "SMALL_BAND", 2)
    monkeypatch.setattr(simhash, "SLOT_SHINGLES", 3000)
    assert {r.doc_id for r in simhash.similar_dedup(docs).collect()} == want
    assert simhash.similar_dedup(docs.limit(0)).count() == 0


def test_decontamination_finds_altered_passages():
    rng = np.random.default_rng(6)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghk" for b in "aeiou" for c in ("lin", "tor", "mas", "ped", "x", "rent")]
    say = lambda n: rng.choice(vocabulary, n).tolist()
    items, texts, want = [], [], []
    for k in range(240):
        w = say(int(rng.choice([12, 45, 47, 59, 120, 250])))
        at, copy = int(rng.integers(1, len(w))), list(w)
        run = max(1, int(len(w) * rng.choice([0.01, 0.05, 0.07, 0.1, 0.15])))
        copy[at : at + [0, run, run][k % 3]] = [say(run), say(run), []][k % 3]  # inserted, replaced, deleted
        before = say(int(rng.integers(0, 40)))
        items.append((k, " ".join(w)))
        texts.append(" ".join([*before, *copy, *say(int(rng.integers(0, 40)))]))
        want.append(decontam.similarity(decontam._shingles(w), decontam._shingles(copy)))
    got = {(t, i): (start, sim) for t, i, start, sim in decontam.Index(items).hits(pa.array(texts))}
    assert sum(x >= 0.8 for x in want) > 100 and sum(x < 0.75 for x in want) > 20
    for k, x in enumerate(want):
        if x >= 0.8:
            assert got[k, k][1] >= x
    for (t, i), (start, sim) in got.items():  # all passages by brute force, for the shorter ones
        words_, own = texts[t].split(), decontam._shingles(items[i][1].split())
        n = len(items[i][1].split())
        if n <= 60:
            all_ = [(decontam.similarity(own, decontam._shingles(words_[b : b + m])), -b) for b in range(len(words_)) for m in range(max(5, n - n // 3), n + n // 3 + 1) if b + m <= len(words_)]
            assert (sim, -start) == max(all_)


def test_decontamination_with_repeated_shingles():
    item = ("one two three four five six " * 4 + "seven eight nine ten eleven twelve").split()
    text = ["x"] * 9 + ("one two three four five six " * 9 + "seven eight nine ten eleven twelve").split() + ["y"] * 9
    got = decontam.Index([(7, " ".join(item)), (8, "a b c d e f"), (9, "tiny")]).hits(pa.array([" ".join(text), "", "a b c d e g", None, "A b c d e f tiny"]))
    assert got == [(0, 7, 9 + 30, 1.0), (4, 8, 0, 1.0), (4, 9, 6, 1.0)]


def test_long_lines_recur_from_two_documents_on_in_the_pipeline(spark):
    long, other = " ".join(f"word{chr(97 + i % 26) * (1 + i // 26)}" for i in range(51)), " ".join(f"tok{chr(97 + i % 26) * (1 + i // 26)}" for i in range(60))
    near = " ".join("changed" if i in (20, 30, 40) else w for i, w in enumerate(other.split()))
    unlike = " ".join(w if i < 4 or i % 3 else f"{w}q" for i, w in enumerate(other.split()[:-1]))
    alone = [" ".join(f"own{chr(97 + k)}{chr(97 + i)}" for i in range(26)) for k in range(5)]
    texts = [f"first alone\n{long}\n{other}", f"second by itself\n{long}\nthe same short line", f"third one\nthe same short line\n{near}", f"fourth\n{unlike}", "fifth\n" + " ".join(other.split()[:-1])]
    texts = [f"{t}\n{a}" for t, a in zip(texts, alone, strict=True)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, None).collect()}
    assert got == {0: texts[0], 1: f"second by itself\nthe same short line\n{alone[1]}", 2: f"third one\nthe same short line\n{alone[2]}", 3: texts[3], 4: texts[4]}
    # copies keep what they share; line dedup by itself takes their lines
    copies = [f"{long}\n{other}", f"{long}\n{other}\nmore", f"{long}\n{other}"]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(copies)], DOCS)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, more, None).collect()} == dict(enumerate(copies))
    assert {r.doc_id: r.text for r in line_dedup.dedup(more).collect()} == {0: copies[0], 1: "more", 2: ""}
    # what recurs beyond a group of copies goes from all of them, and a text of nothing but lines of others becomes empty
    parts = [" ".join(f"{a}{chr(97 + i)}{k}" for i in range(20)).replace("1", "x").replace("2", "y").replace("3", "z") for k in (1, 2, 3) for a in ("p", "q", "r", "s")]
    own = [f"{parts[0]}\n{parts[3]} {parts[4]} {parts[5]}", f"{parts[1]}\n{parts[6]}", f"{parts[2]}\n{parts[7]}", "\n".join(parts[:3]), "\n".join(parts[2::-1]), *[f"{parts[8]} {parts[9]} {parts[10]} {parts[11]}\n{parts[0]}\n" + "tail " * k for k in (1, 2)]]
    mixed = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(own)], DOCS)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, mixed, None).collect()} == {**dict(enumerate(own[:3])), 3: "", 4: "", 5: own[5].replace(f"\n{parts[0]}", ""), 6: own[6].replace(f"\n{parts[0]}", "")}
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs, long_words=10**6).collect()} == dict(enumerate(texts))


def test_line_dedup_on_repeated_ids_and_long_lines(spark):
    rows = [(1, "shared line here\nmine"), (2, "shared line here\nother"), (7, "first\nshared line here"), (7, "alpha unique\nbeta only here"), (7, "alpha unique\nbeta only here"), (8, "a " * 20000 + "b\nx"), (9, "a " * 20000 + "b\ny")]
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, rows[0][1], 0), (2, "other", 1), (7, "first", 1), (7, rows[3][1], 0), (7, rows[3][1], 0), (8, rows[5][1], 0), (9, "y", 1)])


def test_several_templates_in_one_leaf(spark):
    one = "dear reader of this page {} thank you for coming back again soon friend"
    two = "dear reader of this shop {} we hope that your parcel came in good"
    three = "dear reader of this list {} click below to leave it at any time"
    names = "anna bert carl dora emil fred gina".split()
    rows = [(k * 10 + i, t.format(n)) for k, t in enumerate((one, two, three)) for i, n in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k * 10 + i: int(i > 0) for k in range(3) for i in range(len(names))}


def test_many_templates_in_one_leaf(spark):
    """Eight groups of four alike lines, in as many documents; no group is left out, and lines that only start alike stay."""
    say = lambda k, i: f"dear reader of this {' '.join(f'w{chr(97 + k)}{chr(97 + j)}' for j in range(9))} {chr(97 + k)}{chr(97 + i)}x"
    rows = [(10 * i + k, say(k, i)) for k in range(8) for i in range(4)] + [(100 + k, "dear reader of this " + " ".join(f"{chr(97 + k)}{chr(97 + j)}y" for j in range(10))) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __gone", "2 as gone", "3 as id", "4 as hash", "5 as __left", "6 as left")
    out = line_dedup.dedup(df)
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {d: int(10 <= d < 100) for d, _ in rows}
    assert out.select("__gone", "gone", "id", "hash", "__left", "left").distinct().collect() == [(1, 2, 3, 4, 5, 6)]
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)


def test_op10_components_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    prints = [brute_print(t) for t in docs.text]
    comp = union_find(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    got = registry.QUERIES["op10_simhash"](spark, sf_dir).toPandas().set_index("doc_id").component_id
    assert [got[d] for d in docs.doc_id] == [docs.doc_id[c] for c in comp]


def brute_lines(docs, min_docs=3, long_words=50, copies=None):
    """Line dedup of (doc_id, text) pairs in plain Python."""
    rows, leaves = [], {}
    for d, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            tokens = [t for t in re.split("[ \t]+", re.sub(r"[^ \t]*[0-9@/=][^ \t]*", "<*>", line)) if t]
            if tokens:
                leaf = (len(tokens), tuple(tokens[:4]))
                rows.append((d, at, leaf, " ".join(tokens)))
                leaves.setdefault(leaf, []).append((d, " ".join(tokens)))
    template = {}
    for leaf, found in leaves.items():
        n = {}
        for _, own in found:
            n[own] = n.get(own, 0) + 1
        least = min(2, min_docs) if leaf[0] > long_words else min_docs
        if len(n) < 2 or len({d for d, _ in found}) < 2 or len(found) < least:
            continue
        left = dict(n)
        for turn in range(len(n) + 1):
            if not left:
                break
            shape = []
            if turn:
                k, top = max((v, k) for k, v in left.items())
                if len(left) < 2 and k < 2:
                    break
                shape = top.split(" ")
            else:
                for pos in range(leaf[0]):
                    votes = {}
                    for own, v in left.items():
                        votes[own.split(" ")[pos]] = votes.get(own.split(" ")[pos], 0) + v
                    v, token = max((v, t) for t, v in votes.items())
                    all_ = sum(votes.values())
                    shape.append(token if v >= (0.5 * all_ if leaf[0] <= long_words or all_ > 2 else 2) else None)
            for own in [o for o in left if sum(a == b for a, b in zip(o.split(" "), shape, strict=True)) >= 0.8 * leaf[0]]:
                template[leaf, own] = turn
                del left[own]
    groups = {}
    for d, at, leaf, own in rows:
        groups.setdefault((leaf, template[leaf, own]) if (leaf, own) in template else (leaf, own), []).append((d, at))
    first, recurs, words = {}, set(), {}
    for (leaf, t), places in groups.items():
        many = len({d for d, _ in places})
        for p in places if many > 1 else ():
            first[p], words[p] = min(places), leaf[0]
            if many >= (min(2, min_docs) if leaf[0] > long_words else min_docs):
                recurs.add(p)
    kin = {}
    if copies is not None:
        size, part, lost = {}, {}, {}
        for d, _, leaf, _ in rows:
            size[d] = size.get(d, 0) + leaf[0]
        for p, f in first.items():
            s = part.setdefault(p[0], {}).setdefault(f[0], [0, 0])
            s[0] += words[p]
            if p in recurs and f[0] != p[0]:
                s[1] += words[p]
                lost[p[0]] = lost.get(p[0], 0) + words[p]
        for d, of in sorted(part.items()):
            got = [(s, -f, r) for f, (s, r) in of.items() if f < d]
            if got:
                s, f, r = max(got)
                if s >= copies * max(size[d] - lost.get(d, 0) + r, size[-f] - lost.get(-f, 0)):
                    kin[d] = kin.get(-f, -f)
    gone = {p for p in recurs if p != first[p] and not (p[0] in kin and first[p][0] != p[0] and kin[p[0]] == kin.get(first[p][0], first[p][0]))}
    return {d: text and "\n".join(x for at, x in enumerate(text.split("\n")) if (d, at) not in gone) for d, text in docs}


def near_copies(docs):
    """The first of each document's near copies, by doc_id, from all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for _, t in docs)]
    comp = union_find(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    return {d: docs[c][0] for (d, _), c in zip(docs, comp, strict=True)}


def test_line_dedup_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == brute_lines(docs)
    assert {r.doc_id: r.text for r in line_dedup.dedup(df, copies=0.8).collect()} == brute_lines(docs, copies=0.8)


def test_pipeline_run_against_brute_force(spark, sf_dir, tmp_path):
    """The whole run over the smallest table: quality by the model's scores, then plain Python."""
    import base64

    import public_tokenizers as P
    import tiktoken

    from drivespan.llm import knn_quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = knn_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = sorted((r.doc_id, r.text) for r in docs.collect() if model.scores(pa.array([r.text], pa.string()))[0] >= knn_quality.THRESHOLD)
    left = sorted(brute_lines(left, copies=line_dedup.COPIES).items())
    first = near_copies(left)
    left = [(d, t) for d, t in left if first[d] == d]
    items = [[w.decode() for w in words(r.text)] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = [(len(w), decontam._shingles(w)) for w in items if w]

    def leaked(text):
        w = [x.decode() for x in words(text)]
        kinds = set(decontam._shingles(w))
        for n, item in own:
            if sum(v for k, v in item.items() if k in kinds) < 0.8 * sum(item.values()):
                continue
            for m in range(max(1, n - n // 3), n + n // 3 + 1):
                if any(decontam.similarity(item, decontam._shingles(w[b : b + m])) >= 0.8 for b in range(len(w) - m + 1)):
                    return True
        return False

    left = [(d, t) for d, t in left if not leaked(t)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: e.encode_ordinary(t or "") for d, t in left} and 0 < len(got) < docs.count()
