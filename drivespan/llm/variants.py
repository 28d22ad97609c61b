"""Spelling variants: words one edit apart, found by looking generated edits up in Bloom filters, and grouped by frequency.

The vocabulary is sharded by length. A shard's filter is a table of blocks of 256 bits; a word's hash picks its block and one bit in each eighth of it. The filters are
broadcast in passes of at most PASS_BYTES. Every word generates its edits: all deletions, to be looked up one length below, and all replacements by a greater character;
insertions and replacements by lesser characters are the same pairs seen from the other word. Hashes are polynomial, so an edit's hash follows from its word's without
building the edit. Only edits that a filter passes are built, and go to an exact join with the vocabulary, which removes what the filter lets through wrongly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from drivespan.llm.shared import slices, written

#: Contract: lengths and occurrences of words, the divisor of damage, and how much more frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, DAMAGE, RATIO = 6, 5, 199, 5
#: Filter bytes of one pass, and hashes that a task computes at once.
PASS_BYTES, AT_ONCE = 32 << 20, 1 << 21
#: Words a block. Longer words have more edits, so their shards have more blocks: one a word for every LONG characters.
WORDS_PER_BLOCK, LONG = 16, 512
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """What n bytes behind it make of a crc32, as four tables by byte of it."""
    zeros = bytes(n)
    none = zlib.crc32(zeros, 0)
    one = [zlib.crc32(zeros, 1 << b) ^ none for b in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            out[k, 1 << b : 2 << b] = out[k, : 1 << b] ^ np.uint32(one[8 * k + b])
    return out


def crc32_after(heads: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of strings put together, from their heads' and tails' and the tails' bytes."""
    out = tails.astype(np.uint32)
    for n in np.unique(lengths).tolist():
        at = lengths == n
        h, t = heads[at].astype(np.uint32), _shift(n)
        out[at] ^= t[0][h & 255] ^ t[1][h >> 8 & 255] ^ t[2][h >> 16 & 255] ^ t[3][h >> 24]
    return out


def _counted(ids: list, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words of some documents after damage, and their counts."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.split_pattern(pc.replace_substring_regex(lower, r"[^a-z\x{C0}-\x{FF}]+", " "), " ")
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    long = pc.greater_equal(pc.utf8_length(flat), LEAST_LENGTH)  # damage only shortens
    flat, owner = flat.filter(long), owner.filter(long).to_numpy(zero_copy_only=False)
    if not len(flat):
        return [], np.empty(0, np.int64)
    coded = flat.dictionary_encode()
    kinds, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw = [w.encode() for w in kinds]
    key, times = np.unique(owner * len(kinds) + at, return_counts=True)
    doc, kind = np.divmod(key, len(kinds))
    heads = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
    tails, sizes = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)), np.fromiter(map(len, raw), np.int64, len(raw))
    h = crc32_after(heads[doc], tails[kind], sizes[kind])
    hit = h % DAMAGE == 0
    n = np.bincount(kind[~hit], times[~hit], minlength=len(kinds)).astype(np.int64)
    more: dict[str, int] = {}
    for k, x, m in zip(kind[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
        w = kinds[k]
        i = x % len(w)
        if len(w) > LEAST_LENGTH:
            w = w[:i] + w[i + 1 :]
            more[w] = more.get(w, 0) + m
    kept = np.flatnonzero(n)
    return [*(kinds[k] for k in kept.tolist()), *more], np.concatenate([n[kept], np.fromiter(more.values(), np.int64, len(more))])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts after damage that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            words, n = _counted(part.column("id").to_pylist(), part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _powers(n: int, of: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, of, np.uint64))
    return out


def matrix(words: list[str]) -> np.ndarray:
    """Words of one length as rows of their characters' codes, all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def hashes(codes: np.ndarray) -> np.ndarray:
    """A word's polynomial hash, before it is mixed."""
    return (codes.astype(np.uint64) * _powers(codes.shape[1], BASE)).sum(axis=1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits(h: np.ndarray) -> list[np.ndarray]:
    """Four masks of a block's words for each mixed hash, with a bit in each half."""
    x = mixed(h + BASE)
    place = lambda k: (x >> np.uint64(5 * k)) & np.uint64(31)
    return [(np.uint64(1) << place(2 * j)) | (np.uint64(1) << (place(2 * j + 1) + np.uint64(32))) for j in range(4)]


class Shard(NamedTuple):
    """Words of one length, or the part of them whose hash leaves this remainder."""

    length: int
    parts: int
    part: int
    blocks: int

    def ours(self, h: np.ndarray) -> np.ndarray:
        return h % np.uint64(self.parts) == np.uint64(self.part)

    def block(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64)


def passes(sizes: dict[int, int], most: int = PASS_BYTES) -> list[list[Shard]]:
    """Shards of words by length (length: number), in passes of at most `most` bytes of filters."""
    shards = []
    for length, n in sorted(sizes.items()):
        blocks = max(-(-n // WORDS_PER_BLOCK), n * length // LONG, 1)
        parts = -(-blocks * 32 // most)
        shards += [Shard(length, parts, k, -(-blocks // parts)) for k in range(parts)]
    out, held = [[]], 0
    for s in shards:
        if out[-1] and held + s.blocks * 32 > most:
            out.append([])
            held = 0
        out[-1].append(s)
        held += s.blocks * 32
    return out if shards else []


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    yield from found.items()


def filters(words: DataFrame, shards: list[Shard]) -> list[np.ndarray]:
    """The shards' filters, one after another: tasks set their words' bits, and equal blocks are or-ed."""
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(shards):
        by_length.setdefault(s.length, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, at in _by_length(words):
                for k in by_length.get(length, ()):
                    h = mixed(hashes(matrix([words[i] for i in at])))
                    h = h[shards[k].ours(h)]
                    columns = [pa.array(np.full(len(h), k, np.int32)), pa.array(shards[k].block(h)), *(pa.array(m.view(np.int64)) for m in bits(h))]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "block", *(f"w{j}" for j in range(4))])

    lengths = sorted(by_length)
    set_bits = words.filter(F.length("word").between(lengths[0], lengths[-1])).mapInArrow(run, "shard int, block long, w0 long, w1 long, w2 long, w3 long")
    got = set_bits.groupBy("shard", "block").agg(*(F.expr(f"bit_or(w{j})").alias(f"w{j}") for j in range(4))).toArrow()  # at most PASS_BYTES
    out = [np.zeros((s.blocks, 4), np.uint64) for s in shards]
    of, block = got.column("shard").to_numpy(), got.column("block").to_numpy()
    masks = np.stack([got.column(f"w{j}").to_numpy() for j in range(4)], axis=1).astype(np.int64).view(np.uint64)
    for k, table in enumerate(out):
        table[block[of == k]] = masks[of == k]
    return out


def _passed(h: np.ndarray, shards: list[tuple[Shard, np.ndarray]]) -> np.ndarray:
    """Places in h (any shape, flattened) of hashes that the filters of a length hold."""
    h = mixed(h.ravel())
    found = []
    for shard, table in shards:
        at = np.arange(len(h)) if shard.parts == 1 else np.flatnonzero(shard.ours(h))
        own = table[shard.block(h[at])]
        maybe = np.flatnonzero(own.any(axis=1))
        at, own = at[maybe], own[maybe]
        good = np.ones(len(at), bool)
        for j, m in enumerate(bits(h[at])):
            good &= own[:, j] & m == m
        found.append(at[good])
    return np.sort(np.concatenate(found))


def edits(words: list[str], alphabet: np.ndarray, shards: dict[int, list[tuple[Shard, np.ndarray]]], at_once: int = AT_ONCE) -> Iterator[tuple[int, str]]:
    """(index of a word, edit) for each deletion and each replacement by a greater character of the alphabet that a filter passes."""
    for length, at in _by_length(words):
        power = _powers(length + 1, BASE)
        if length in shards:
            rows, width = max(1, at_once // (length * len(alphabet))), max(1, at_once // len(alphabet))
            for a in range(0, len(at), rows):
                codes = matrix([words[i] for i in at[a : a + rows]])
                whole = hashes(codes)
                for b in range(0, length, width):
                    own = codes[:, b : b + width]
                    step = alphabet[None, None, :].astype(np.uint64) - own[:, :, None].astype(np.uint64)
                    w, i, c = np.nonzero(alphabet[None, None, :] > own[:, :, None])
                    h = whole[w] + step[w, i, c] * power[b + i]
                    for k in _passed(h, shards[length]).tolist():
                        word, place = words[at[a + w[k]]], b + i[k]
                        yield at[a + w[k]], word[:place] + chr(alphabet[c[k]]) + word[place + 1 :]
        if length - 1 in shards:
            rows = max(1, at_once // length)
            for a in range(0, len(at), rows):
                codes = matrix([words[i] for i in at[a : a + rows]])
                terms = codes.astype(np.uint64) * power[:length]
                before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                after = (terms.sum(axis=1, dtype=np.uint64)[:, None] - before - terms) * UNBASE
                # of a run of equal characters, taking out any gives the same word
                w, i = np.nonzero(np.concatenate([np.ones((len(codes), 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1))
                for k in _passed((before + after)[w, i], shards[length - 1]).tolist():
                    word = words[at[a + w[k]]]
                    yield at[a + w[k]], word[: i[k]] + word[i[k] + 1 :]


def near_words(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, near, n): both directions of every pair of words (word, n) that differ by exactly one inserted, deleted or replaced character. words: a written table of distinct words in characters below 256."""
    spark = words.sparkSession
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()  # 256 at most
    alphabet = np.array(sorted(ord(r.c) for r in letters), np.uint8)
    dealt = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    pairs = None
    for shards in passes(sizes, pass_bytes):
        tables: dict[int, list[tuple[Shard, np.ndarray]]] = {}
        for s, t in zip(shards, filters(words, shards), strict=True):
            tables.setdefault(s.length, []).append((s, t))
        shared = spark.sparkContext.broadcast((alphabet, tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            alphabet, tables = shared.value
            for batch in batches:
                own = batch.column("word").to_pylist()
                found = list(edits(own, alphabet, tables))
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array([e for _, e in found], pa.string())], ["word", "n", "edit"])

        lengths = sorted(tables)
        passed = dealt.filter(F.length("word").between(lengths[0], lengths[-1] + 1)).mapInArrow(run, "word string, n long, edit string")
        met = written(passed.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")).hint("merge"), "edit"), "variant-pairs")
        shared.destroy()
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        pairs = words.select("word", "n", F.lit("").alias("edit"), F.lit(0).cast("long").alias("edit_n")).limit(0)
    return pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("n")).unionByName(pairs.select(F.col("edit").alias("word"), F.col("word").alias("near"), "n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): where following forms (word, form) ends, when no chain has more than `steps` forms. Each round doubles how far a word has gone."""
    at = forms.select("word", F.col("form").alias("root"))
    while steps > 1:
        at = written(at, "variant-roots")
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        steps = -(-steps // 2)
    return at


def group(words: DataFrame, ratio: int = RATIO, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (word, n), which must be a written table.

    A word's form is its near word of largest n, ties to the least in code-point order, if that n is `ratio` times the word's or more; following forms ends at its root. A form has `ratio` times as many occurrences, so chains are short.
    """
    near = near_words(words, pass_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("least"), F.col("near"))).alias("top"))
    good = -F.col("top.least") >= ratio * F.col("n")
    out = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("top.near")).alias("form"), F.when(good, -F.col("top.least")).alias("form_n"))
    out = written(out, "variants")
    most, steps = words.agg(F.max("n")).first()[0] or 0, 0
    while most >= LEAST_COUNT * ratio ** (steps + 1):
        steps += 1
    ends = roots(out.filter("form is not null"), steps)
    return out.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """group() over the vocabulary of whole texts after damage. Null texts have no words, a null doc_id counts as an empty one, rows that repeat count each, no words give an empty table; other columns are not read."""
    return group(written(vocabulary(docs), "variant-words"))
