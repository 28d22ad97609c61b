"""SimHash near-duplicates: fingerprints in tasks, pigeonhole blocks joined in Spark, Hamming distance verified.

A 64-bit fingerprint is split into blocks. Two fingerprints that differ in at most `radius`
bits agree on all but `radius` of the blocks, so a key for every choice of `agree` =
blocks - radius blocks puts each such pair under at least one common key.

similar_dedup() takes fingerprints of five-word shingles through the same blocks and links, and verifies the texts of each group by exact
similarity. At 0.8 two fingerprints of 64 bits differ in 9.7 bits on average, too many for blocks of their bits, so what lies beyond
the blocks' radius is found by bands of least shingle hashes besides; there a wide Hamming radius sorts out chance meetings, and every link is verified alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from drivespan.llm.components import connected_components
from drivespan.llm.shared import free, ragged, slices, word_lists, written

SEED = 42
#: Text bytes that are fingerprinted at once.
SLICE = 2 << 20
#: A bucket with more fingerprints than this is cut into slots of about SLOT fingerprints.
SMALL_BUCKET, SLOT = 64, 1024
#: Blocks agree such that a bucket of keys spread evenly holds about so many distinct fingerprints at most.
BUCKET = 8

#: Shingle width and Jaccard similarity from which two texts are near copies.
WIDTH, SIMILAR = 5, 0.8
#: Bands of ROWS least hashes each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS, ROWS = 20, 5
#: Bits within which the blocks of fingerprints link texts, as in groups().
LINKED = 3
#: At similarity 0.8 a bit differs with probability acos(1.6 / 1.8) / pi = 0.15, so more than 24 of 64 do in a few of a million pairs.
RADIUS = 24
#: A bucket with more texts than SMALL_BAND is cut into slots of about SLOT texts and SLOT_SHINGLES shingles.
SMALL_BAND, SLOT_SHINGLES = 8, 1 << 20


def shingle_hashes(words: pa.Array, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, and the number of shingles of each text."""
    n = len(words)
    owner = np.repeat(np.arange(len(counts)), counts)
    digest = xxhash.xxh64_intdigest
    binary = words.cast(pa.large_binary())
    if n >= width:
        joined = pc.binary_join_element_wise(*(binary.slice(i, n - width + 1) for i in range(width)), pa.scalar(b" ", pa.large_binary()))
        joined = joined.filter(pa.array(owner[: n - width + 1] == owner[width - 1 :]))
        full = np.fromiter((digest(x, SEED) for x in joined.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(joined))
    else:
        full = np.empty(0, np.uint64)
    per = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return full, per
    starts = np.cumsum(counts) - counts
    own = {int(i): digest(b" ".join(binary.slice(int(starts[i]), int(counts[i])).to_pylist()), SEED) for i in short}
    new = per.copy()
    new[short] = 1
    out = np.empty(int(new.sum()), np.uint64)
    at = np.cumsum(new) - new
    out[at[short]] = [own[int(i)] for i in short]
    kept = np.ones(len(out), bool)
    kept[at[short]] = False
    out[kept] = full
    return out, new


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: a bit is 1 if it is set in over half of them; 0 for no hashes."""
    out = np.zeros(len(per), np.uint64)
    some = np.flatnonzero(per)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, (np.cumsum(per) - per)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > per[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, n_words, text_hash): the SimHash of each whole text over shingles of `width` words, repeats counted.

    A text of fewer words is one shingle; an empty or null text has fingerprint 0. text_hash tells texts of one id apart. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, counts = word_lists(part.column("text"))
                fp = majority(*shingle_hashes(words, counts, width))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64)), pa.array(counts), part.column("text_hash")], ["id", "fp", "n_words", "text_hash"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, "id long, fp long, n_words long, text_hash long")


def agreeing(n: int, radius: int) -> int:
    """The number of blocks that must agree for n distinct fingerprints, two at least: more bits in a key, and more keys, for more fingerprints."""
    agree = 2
    while n > BUCKET * 2.0 ** (64 * agree / (radius + agree)) and agree < 16:
        agree += 1
    return agree


def _block_keys(fp: Column, radius: int, agree: int) -> list[Column]:
    """A key for every choice of `agree` out of radius + agree blocks: the number of the choice and the blocks' bits."""
    n = radius + agree
    edges = [round(64 * i / n) for i in range(n + 1)]
    keys = []
    for k, choice in enumerate(itertools.combinations(range(n), agree)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return keys


def _forest(fp: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect whatever hangs together within the radius: one less than the members of each piece."""
    left = np.arange(len(fp))
    a, b = [], []
    stack: list[int] = []
    while len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
            continue
        i = stack.pop()
        near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
        found = left[near]
        left = left[~near]
        stack.extend(found.tolist())
        a.extend([int(fp[i])] * len(found))
        b.extend(fp[found].tolist())
    return a, b


def links(reps: DataFrame, radius: int = 3, agree: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp) that connect all pairs within `radius` bits.

    Buckets of up to SMALL_BUCKET fingerprints are joined with themselves and each pair is verified.
    A larger bucket is cut into slots of about SLOT fingerprints; every two slots meet in a task of
    bounded size that verifies all their pairs and gives a spanning forest of the links, not the pairs.
    """
    keyed = reps.select("fp", F.explode(F.array(*_block_keys(F.col("fp"), radius, agree))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keyed.join(sizes.hint("merge"), "key"), "simhash-buckets")
    small = members.filter(f"n <= {SMALL_BUCKET}")
    a, b = (small.select("key", F.col("fp").alias(x)) for x in "uv")
    pairs = a.join(b, "key").filter("u < v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")

    slots = F.ceil(F.col("n") / SLOT)
    own = F.pmod(F.xxhash64("fp"), slots)
    large = members.filter(f"n > {SMALL_BUCKET}").select("key", "fp", own.alias("s"), slots.alias("m"))
    met = large.select("key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("o"), "s").select("key", "fp", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))

    def forest(table: pa.Table) -> pa.Table:
        u, v = _forest(table.column("fp").to_numpy(), radius)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return pairs.unionByName(met.groupBy("key", "i", "j").applyInArrow(forest, "u long, v long"))


def _labelled(reps: DataFrame, node: str, value: str, edges: DataFrame) -> DataFrame:
    """(node, value): for each of the distinct nodes of reps the least value of its component."""
    nodes = connected_components(edges).withColumnRenamed("node", node)
    least = nodes.join(reps.select(node, value).hint("merge"), node).groupBy("component").agg(F.min(value).alias("__least"))
    linked = written(nodes.join(least.hint("merge"), "component").select(node, "__least"), "simhash-labels")
    return reps.join(linked.hint("merge"), node, "left").select(node, F.coalesce("__least", value).alias(value))


def groups(prints: DataFrame, radius: int = 3, agree: int | None = None) -> DataFrame:
    """prints (id, fp, ...) with component_id: the least id that links of up to `radius` differing bits reach, itself included.

    Rows with a null id take part in nothing and get a null component. Rows that repeat an id are told apart by their fingerprints,
    each in its own group. agree: how many blocks must agree, by default from the number of distinct fingerprints; the links are the
    same for any. An empty table gives an empty table.
    """
    reps = written(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("component_id")), "simhash-distinct")
    named = _labelled(reps, "fp", "component_id", links(reps, radius, agree or agreeing(reps.count(), radius)))
    return prints.join(named.hint("merge"), "fp", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))


def _first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that are not the first of their group. rows: (id, text_hash, first) of all rows of docs with an id, first being the (id, text_hash) that stays."""
    (text_hash,) = free(docs.columns, "text_hash")
    keys = ["doc_id", text_hash]
    named = rows.select(F.col("id").alias("doc_id"), F.col("text_hash").alias(text_hash), (F.struct("id", "text_hash") == F.col("first")).alias("stays"))
    gone = named.filter("not stays").select(*keys).distinct()
    left = docs.withColumn(text_hash, F.xxhash64("text")).join(gone, keys, "left_anti")
    again = written(named.filter("stays").groupBy(*keys).count().filter("count > 1").drop("count"), "simhash-repeated")
    if again.head(1):  # rows that are equal in id and text: one of them stays
        left = left.join(again, keys, "left_anti").unionByName(left.join(again, keys, "left_semi").dropDuplicates(keys))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(docs: DataFrame, width: int = 3, radius: int = 3, agree: int | None = None) -> DataFrame:
    """docs with one row of each group of linked fingerprints, the one with the least doc_id. Rows with a null doc_id stay.

    Rows that repeat a doc_id are told apart by their texts; of those equal in both one stays.
    """
    prints = written(fingerprints(docs.filter("doc_id is not null"), width), "simhash-prints")
    reps = written(prints.groupBy("fp").agg(F.min(F.struct("id", "text_hash")).alias("first")), "simhash-distinct")
    named = _labelled(reps, "fp", "first", links(reps, radius, agree or agreeing(reps.count(), radius)))
    return _first_of_each(docs, prints.join(named.hint("merge"), "fp"))


def distinct_shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, their number, and a signature: equal for equal sets, 0 for no words."""
    hashes, per = shingle_hashes(*word_lists(texts), width)
    owner = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    kept = np.ones(len(hashes), bool)
    kept[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, per = hashes[kept], np.bincount(owner[kept], minlength=len(per))
    bounds = np.concatenate([[0], np.cumsum(per)])
    flat = hashes.tobytes()
    own = (xxhash.xxh64_intdigest(flat[8 * a : 8 * b], SEED) if b > a else 0 for a, b in zip(bounds, bounds[1:], strict=False))
    return hashes, per, np.fromiter(own, np.uint64, len(per))


def band_keys(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """BANDS keys for each run of hashes, from ROWS least hashes each; runs must not be empty."""
    starts = np.cumsum(per) - per
    rng = np.random.default_rng(SEED)
    top = np.iinfo(np.uint64).max
    out = np.empty((len(per), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(per), k, np.uint64)
        for _ in range(ROWS):
            mask, odd = rng.integers(0, top, 2, np.uint64, endpoint=True)
            key = (key ^ np.minimum.reduceat((hashes ^ mask) * (odd | np.uint64(1)), starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, k] = key
    return out


def shingle_prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, text_hash, sig, fp, n, keys): of each text's distinct shingles the signature, SimHash, number and band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, per, sig = distinct_shingles(part.column("text"), width)
                some = per > 0
                keys = band_keys(hashes, per[some]).ravel() if some.any() else np.empty(0, np.uint64)
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(sig.view(np.int64)), pa.array(majority(hashes, per).view(np.int64)), pa.array(per.astype(np.int64)), keys], ["id", "text_hash", "sig", "fp", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(run, "id long, text_hash long, sig long, fp long, n long, keys array<long>")


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(sig, shingles) of the texts of docs (text): one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, per, sig = distinct_shingles(part.column("text"), width)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["sig", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "sig long, shingles array<long>").groupBy("sig").agg(F.first("shingles").alias("shingles"))


def _similar_forest(sig: np.ndarray, fp: np.ndarray, flat: np.ndarray, per: np.ndarray, radius: int, similar: float) -> tuple[list, list]:
    """Links that connect whatever hangs together by exact Jaccard similarity of the shingle sets (flat, per)."""
    kinds, codes = np.unique(flat, return_inverse=True)
    starts = np.cumsum(per) - per
    held = np.zeros(len(kinds), bool)
    left = np.arange(len(sig))
    a, b = [], []
    stack: list[int] = []
    while len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
            continue
        i = stack.pop()
        own = codes[starts[i] : starts[i] + per[i]]
        held[own] = True
        near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
        met = left[near]
        if len(met):
            both = np.add.reduceat(held[codes[ragged(starts[met], per[met])]], np.cumsum(per[met]) - per[met], dtype=np.int64)
            near[near] = both >= similar * (per[met] + per[i] - both)
        held[own] = False
        found, left = left[near], left[~near]
        stack.extend(found.tolist())
        a.extend([int(sig[i])] * len(found))
        b.extend(sig[found].tolist())
    return a, b


def similar_links(docs: DataFrame, reps: DataFrame, width: int = WIDTH, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between the signatures of reps (sig, first, fp, n, keys) that connect the texts whose shingle sets are similar enough.

    Buckets are the groups of linked fingerprints and the bands. Of buckets with the same members one is kept. The members of small ones are paired, each pair is met once and verified;
    in larger ones every two slots meet in a task of bounded size that gives a spanning forest of the verified links.
    """
    keyed = reps.select("sig", "first", "fp", "n", F.explode("keys").alias("key")).unionByName(fingerprint_groups(reps))
    same = F.struct(F.min("sig"), F.max("sig"), F.bit_xor(F.xxhash64("sig")), F.count("*"))
    sizes = keyed.groupBy("key").agg(same.alias("same"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    buckets = sizes.groupBy("same").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("shingles").alias("shingles")).drop("same")
    members = keyed.drop("n").join(written(buckets, "similar-sizes").hint("merge"), "key")
    members = written(members, "similar-buckets")
    firsts = members.select(F.col("first.id").alias("doc_id"), F.col("first.text_hash").alias("__hash")).distinct()
    sets = written(_shingle_sets(docs.select("doc_id", "text", F.xxhash64("text").alias("__hash")).join(firsts.hint("merge"), ["doc_id", "__hash"], "left_semi"), width), "similar-sets")

    small = members.filter(f"size <= {SMALL_BAND}")
    a, b = (small.select("key", F.col("sig").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "uv")
    pairs = a.join(b, "key").filter("u < v").filter(F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= radius).select("u", "v").distinct()
    for x in "uv":
        pairs = pairs.join(sets.select(F.col("sig").alias(x), F.col("shingles").alias(f"shingles_{x}")).hint("merge"), x)
    pairs = pairs.select("u", "v", F.size(F.array_intersect("shingles_u", "shingles_v")).alias("both"), (F.size("shingles_u") + F.size("shingles_v")).alias("all"))
    pairs = pairs.filter(F.col("both") >= similar * (F.col("all") - F.col("both"))).select("u", "v")

    slots = F.greatest(F.ceil(F.col("size") / SLOT), F.ceil(F.col("shingles") / SLOT_SHINGLES))
    own = F.pmod(F.xxhash64("sig"), slots)
    large = members.filter(f"size > {SMALL_BAND}").select("key", "sig", "fp", own.alias("s"), slots.alias("m"))
    met = large.select("key", "sig", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("o"), "s").select("key", "sig", "fp", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))

    def forest(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        shingles = table.column("shingles").combine_chunks()
        per = pc.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64)
        u, v = _similar_forest(col("sig"), col("fp").view(np.uint64), shingles.flatten().to_numpy(zero_copy_only=False), per, radius, similar)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    forests = met.join(sets.hint("merge"), "sig").groupBy("key", "i", "j").applyInArrow(forest, "u long, v long")
    return pairs.unionByName(forests)


def fingerprint_groups(reps: DataFrame, radius: int = LINKED) -> DataFrame:
    """(sig, first, fp, n, key) of the texts of reps that have words: key names the group that links of up to `radius` bits between fingerprints reach, as in groups()."""
    rows = reps.filter("n > 0").select("sig", "first", "fp", "n")
    fps = written(rows.select("fp").distinct(), "similar-fingerprints")
    kin = connected_components(links(fps, radius, agreeing(fps.count(), radius))).withColumnRenamed("node", "fp")
    key = F.xxhash64(F.lit("fingerprints"), F.coalesce("component", "fp"))
    return written(rows.join(kin.hint("merge"), "fp", "left").select(*rows.columns, key.alias("key")), "similar-kin")


def similar_groups(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, first) of every row with a doc_id: first is the least (id, text_hash) that links of exact shingle similarity, from `similar` up, reach.

    Texts are compared as sets of shingles of `width` words; fewer words are one shingle, texts without words are copies of each other.
    """
    prints = written(shingle_prints(docs.filter("doc_id is not null"), width), "similar-prints")
    place = F.struct("id", "text_hash")
    reps = written(prints.groupBy("sig").agg(F.min(place).alias("first"), F.min_by(F.struct("fp", "n", "keys"), place).alias("r")).select("sig", "first", "r.*"), "similar-distinct")
    named = _labelled(reps, "sig", "first", similar_links(docs.select("doc_id", "text"), reps, width, similar, radius))
    return prints.select("id", "text_hash", "sig").join(named.hint("merge"), "sig").select("id", "text_hash", "first")


def similar_dedup(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """docs with one row, the one with the least doc_id, of each group of similar_groups().

    Rows with a null doc_id stay. Rows that repeat a doc_id are told apart by their texts; of those equal in both one stays.
    """
    return _first_of_each(docs, similar_groups(docs, width, similar, radius))
