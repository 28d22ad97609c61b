"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window of `size` words has a 64-bit fingerprint: the signs of its words' summed hash bits, weighted by length. Documents
are read in windows that start at every stride-th word; an item of W words gets a size and stride from its own length,
such that wherever a copy of it starts, one of the document's windows lies wholly inside the copy and equals one of
the item's own windows of that size. Fingerprints are cut into three blocks; two within RADIUS bits have a block
within RADIUS // 3 bits, so tables of all such block values pass every fingerprint within the radius.
What passes is compared bit by bit.

At similarity 0.8 about a quarter of the bits may differ, as a copy may have words inserted, deleted or replaced; no block is
of use at that radius. So a second sieve, which misses nothing, looks for an item's rarest shingles of over a fifth of its weight: a
passage as similar as that holds one of them. Either sieve's pairs of text and item are verified by exact weighted-shingle
similarity, over all passages of the text whatever their length.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from drivespan.llm.shared import coded, free, ragged, slices, word_lists, written

RADIUS = 8
SHINGLE, SIMILAR = 5, 0.8
#: Blocks of a fingerprint: lowest bit and width.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Words of up to SHORT letters weigh 1, longer ones LONG.
SHORT, LONG = 3, 3
#: Items, and bytes of their texts, that one pass holds on every executor; a larger benchmark takes several passes.
PASS_ITEMS, PASS_BYTES = 4096, 64 << 20
#: Begins and ends of passages that are paired at once.
PAIRS = 1 << 20


def window_of(words: int) -> tuple[int, int]:
    """Window size and stride for an item of so many words. Sizes grow by steps of a seventh, so that items of like lengths share them."""
    size = best = 1
    while True:
        stride = max(1, size // 7)
        if size + stride - 1 > words:
            break
        best = size
        size = max(size + 1, size * 8 // 7)
    return best, max(1, best // 7)


def _weights(kinds: list[str], lane: type) -> np.ndarray:
    """For each distinct word 64 lanes of lane's width, packed into 64-bit words: its weight where its hash has a bit set; and a last column, the weight itself."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds), np.uint64, len(kinds))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(lane)
    weight = np.fromiter((1 if len(w) <= SHORT else LONG for w in kinds), lane, len(kinds))
    return np.concatenate([(bits * weight[:, None]).view(np.uint64), weight.astype(np.uint64)[:, None]], axis=1)


class _Running:
    """Running sums of a text's word weights, first row zero.

    Lanes overflow into each other and sums wrap around, yet the difference over a window is exact as long as the window's own
    sums fit their lanes; windows too long for 8-bit lanes get 16-bit or 32-bit ones.
    """

    def __init__(self, kinds: list[str], at: np.ndarray):
        self.kinds, self.at, self.sums = kinds, at, {}

    def prints(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of `size` words from each start: a bit is set where words with it hold over half the weight."""
        lane = np.uint8 if size * LONG < 1 << 8 else np.uint16 if size * LONG < 1 << 16 else np.uint32
        if lane not in self.sums:
            rows = _weights(self.kinds, lane)[self.at]
            self.sums[lane] = np.zeros((len(self.at) + 1, rows.shape[1]), np.uint64)
            np.cumsum(rows, axis=0, out=self.sums[lane][1:])
        sums = self.sums[lane]
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), 1 << 14):
            s = starts[a : a + (1 << 14)]
            own = sums[s + size] - sums[s]
            half = (own[:, -1:] // np.uint64(2)).astype(lane)
            out[a : a + len(s)] = np.packbits(np.ascontiguousarray(own[:, :-1]).view(lane) > half, axis=1).view(">u8").ravel()
        return out


def _shingles(words: list[str]) -> Counter:
    """Shingles of SHINGLE words and their weights: repeats times the letters in them; fewer words are one shingle."""
    parts = [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or [tuple(words)]
    return Counter({s: n * sum(map(len, s)) for s, n in Counter(parts).items()})


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle counters."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _hashes(kinds: list[str], at: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE words from each place on."""
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds), np.uint64, len(kinds))[at]
    n = max(len(own) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The items of one pass: their window fingerprints by size, for each size the block tables, and their rarest shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = [(i, w) for i, t in items if (w := word_lists(pa.array([t]))[0].to_pylist())]
        self.shingles = [_shingles(w) for _, w in self.words]
        by_size: dict[int, list] = {}
        for k, (_, words) in enumerate(self.words):
            size, _ = window_of(len(words))
            kinds, at = coded(pa.array(words, pa.large_string()))
            offsets = np.arange(len(words) - size + 1)
            by_size.setdefault(size, []).append((_Running(kinds, at).prints(offsets, size), np.full(len(offsets), k), offsets))
        self.sizes = {}
        for size, parts in by_size.items():
            fp, item, offset = (np.concatenate([p[i] for p in parts]) for i in range(3))
            self.sizes[size] = (fp, item, offset, [self._table(fp, low, width) for low, width in BLOCKS])
        self._anchor()

    def _anchor(self) -> None:
        """own: each item's shingle hashes in order, their weights and repeats; anchors: hashes of the rarest ones in order, and who has them."""
        self.own = []
        for _, words in self.words:
            kinds, at = coded(pa.array(words, pa.large_string()))
            letters = np.cumsum([0, *map(len, words)])
            h, where, n = np.unique(_hashes(kinds, at), return_index=True, return_counts=True)
            self.own.append((h, n * (letters[where + SHINGLE] - letters[where]), n))
        seen, held = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for h, _, _ in self.own)]), return_counts=True)
        parts = []
        for k, (h, weight, _) in enumerate(self.own):
            order = np.lexsort((-weight, held[np.searchsorted(seen, h)]))
            total = np.cumsum(weight[order])
            most = int((total <= (1 - SIMILAR) * weight.sum() + 1e-6).sum()) + 1
            parts.append((h[order[:most]], np.full(len(order[:most]), k)))
        anchors, item = (np.concatenate([np.empty(0, t), *(p[i] for p in parts)]).astype(t) for i, t in enumerate((np.uint64, np.int64)))
        order = np.argsort(anchors, kind="stable")
        self.anchors, self.anchored = anchors[order], item[order]
        self.held = np.zeros(1 << 22, bool)
        self.held[self.anchors >> np.uint64(42)] = True

    def anchored_pairs(self, hashes: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of all texts that hold one of an item's rarest shingles."""
        open_ = np.flatnonzero(self.held[hashes >> np.uint64(42)])
        low, high = (np.searchsorted(self.anchors, hashes[open_], side) for side in ("left", "right"))
        open_, low, n = open_[high > low], low[high > low], (high - low)[high > low]
        out: set[tuple[int, int]] = set()
        ends = np.cumsum(n)
        a = 0
        while a < len(open_):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
            code = np.unique(np.repeat(text[open_[a:b]], n[a:b]) * len(self.words) + self.anchored[ragged(low[a:b], n[a:b])])
            out.update(zip((code // len(self.words)).tolist(), (code % len(self.words)).tolist(), strict=True))
            a = b
        return out

    def passage(self, k: int, hashes: np.ndarray, letters: np.ndarray, words) -> tuple[float, int] | None:
        """(similarity, first word) of a text's passage most similar to item k, if it is similar enough.

        hashes: of the text's shingles; letters: running sums over its words; words: gives the words of a range. A best
        passage begins and ends with shingles of the item, and where the item's shingles go on, so does it, unless there are more of a kind than the item has.
        """
        own, weight, n = self.own[k]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        match = own[at] == hashes
        all_ = int(weight.sum())
        found = np.bincount(at[match], minlength=len(own))
        if weight[found > 0].sum() < SIMILAR * all_ - 1e-6:
            return None
        inner = match & (found <= n)[at]
        begins = np.flatnonzero(match & ~np.concatenate([[False], inner[:-1]]))
        ends = np.flatnonzero(match & ~np.concatenate([inner[1:], [False]])) + 1
        each = letters[SHINGLE:] - letters[:-SHINGLE]
        whole, met = (np.concatenate([[0], np.cumsum(x)]) for x in (each, each * match))
        low = np.searchsorted(whole[ends], whole[begins] + SIMILAR * all_ - 1e-6)
        high = np.searchsorted(whole[ends], whole[begins] + all_ / SIMILAR + 1e-6, "right")
        n_ends = np.maximum(high - low, 0)
        turn = (np.cumsum(n_ends) - n_ends) // PAIRS  # so many begins and ends are paired at once
        best = None
        for a in np.unique(turn).tolist():
            i, j = np.searchsorted(turn, [a, a + 1])
            b, e = np.repeat(begins[i:j], n_ends[i:j]), ends[ragged(low[i:j], n_ends[i:j])]
            both = np.minimum(met[e] - met[b], all_)
            bound = both / (all_ + whole[e] - whole[b] - both)
            kept = np.flatnonzero(bound >= (best[0] if best else SIMILAR))
            for x in kept[np.lexsort((e[kept], b[kept], -bound[kept]))].tolist():
                if best and bound[x] < best[0]:
                    break
                if best and bound[x] == best[0] and b[x] >= -best[1]:
                    continue
                sim = similarity(self.shingles[k], _shingles(words(int(b[x]), int(e[x]) + SHINGLE - 1)))
                if sim >= SIMILAR and (best is None or (sim, -int(b[x])) > best):
                    best = sim, -int(b[x])
        return best and (best[0], -best[1])

    @staticmethod
    def _table(fp: np.ndarray, low: int, width: int) -> np.ndarray:
        """A bit for every block value, set within RADIUS // 3 bits of an item's."""
        table = np.zeros(1 << width, bool)
        own = np.unique(fp >> np.uint64(low) & np.uint64((1 << width) - 1))
        for n in range(RADIUS // len(BLOCKS) + 1):
            for flips in itertools.combinations(range(width), n):
                table[own ^ np.uint64(sum(1 << f for f in flips))] = True
        return np.packbits(table, bitorder="little")

    def near(self, size: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) of all fingerprints within RADIUS bits of an entry of that size."""
        items, _, _, tables = self.sizes[size]
        passed = np.zeros(len(fp), np.uint8)
        for t, (low, width) in zip(tables, BLOCKS, strict=True):
            value = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.uint32)
            passed |= t[value >> 3] >> (value & 7).astype(np.uint8)
        open_, got = np.flatnonzero(passed & 1), []
        step = max(1, (1 << 21) // len(items))
        for a in range(0, len(open_), step):
            w = open_[a : a + step]
            i, e = np.nonzero(np.bitwise_count(fp[w, None] ^ items[None, :]) <= RADIUS)
            got.append((w[i], e))
        return tuple(np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(2))

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, float]]:
        """(text, item_id, first word, similarity): for each text and item the most similar passage, if it is similar enough."""
        words, counts = word_lists(texts)
        kinds, at = coded(words)
        running = _Running(kinds, at)
        first = np.cumsum(counts) - counts
        best: dict[tuple[int, int], tuple[float, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        pairs: set[tuple[int, int]] = set()
        for size, (_, item, offset, _) in self.sizes.items():
            stride = max(1, size // 7)
            n = np.maximum((counts - size) // stride + 1, 0)
            n[counts < size] = 0
            text = np.repeat(np.arange(len(counts)), n)
            starts = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
            window, entry = self.near(size, running.prints(starts, size))
            for t, s, e in zip(text[window].tolist(), starts[window].tolist(), entry.tolist(), strict=True):
                k = int(item[e])
                if len(self.words[k][1]) >= SHINGLE:
                    pairs.add((t, k))
                    continue
                begin = max(s - int(offset[e]), int(first[t]))
                if (t, k, begin) in seen:
                    continue
                seen.add((t, k, begin))
                end = min(begin + len(self.words[k][1]), int(first[t] + counts[t]))
                sim = similarity(self.shingles[k], _shingles([kinds[i] for i in at[begin:end].tolist()]))
                if sim >= SIMILAR and (sim, -begin) > best.get((t, k), (0.0, 0)):
                    best[t, k] = (sim, -begin)
        hashes = _hashes(kinds, at)
        last = first + counts - SHINGLE + 1
        text = np.repeat(np.arange(len(counts)), counts)[: len(hashes)]
        inside = np.flatnonzero(np.arange(len(hashes)) < last[text])
        pairs |= self.anchored_pairs(hashes[inside], text[inside])
        letters = np.concatenate([[0], np.cumsum(np.fromiter(map(len, kinds), np.int64, len(kinds))[at])])
        for t, k in sorted(pairs):
            a, b = int(first[t]), int(last[t])
            if b > a:
                found = self.passage(k, hashes[a:b], letters[a : b + SHINGLE], lambda i, j, a=a: [kinds[x] for x in at[a + i : a + j].tolist()])
                if found:
                    best[t, k] = (found[0], -found[1] - a)
        return [(t, self.words[k][0], -b - int(first[t]), sim) for (t, k), (sim, b) in sorted(best.items())]


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): for each document and benchmark item the most similar passage, from SIMILAR up.

    start is the passage's first word, counted from 0; a passage may have more or fewer words than the item. Letters A-Z are lower-cased, words are what white space parts.
    Null texts and texts or items without words match nothing; items of fewer than SHINGLE words must match whole; rows that repeat a doc_id give
    rows of their own; an empty table on either side gives none. Items with a null item_id are read like any other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def hits(index: Callable[[], Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = index().hits(part.column("text"))
                    who = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [pc.take(who, pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64())],
                        ["doc_id", "item_id", "start", "similarity"],
                    )

        return rows.mapInArrow(run, "doc_id long, item_id long, start long, similarity double")

    return reduce(DataFrame.unionByName, _passes(docs.sparkSession, benchmark, hits))


def _passes(spark: SparkSession, benchmark: DataFrame, made: Callable[[Callable[[], Index]], DataFrame], alone: Callable[[Callable[[], Index]], DataFrame] | None = None) -> list[DataFrame]:
    """What `made` makes in each pass of a function that gives the pass's index, built once in a task; `alone`, if given, where there is one pass only.

    Of several passes each is written, and its items go before the next one's come.
    """
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    out = []
    for k in range(passes):
        held = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).collect()]
        shared = spark.sparkContext.broadcast(sorted(held, key=lambda x: (x[1], x[0] or 0)))
        loaded: list[Index] = []

        def index(shared=shared, loaded=loaded) -> Index:
            if not loaded:
                loaded.append(Index(shared.value))
            return loaded[0]

        if passes == 1:
            return [(alone or made)(index)]
        out.append(written(made(index), "decontam-pass"))
        shared.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark: each is judged by its own text, whatever its doc_id.

    Where the items fit one pass, rows go as they are read; else each pass writes the digests of the texts that go, and a join takes these out.
    """

    def judged(index: Callable[[], Index], column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for batch in batches:
                for part in slices(batch, column):
                    kept = np.ones(part.num_rows, bool)
                    kept[[f[0] for f in index().hits(part.column(column))]] = False
                    yield part, kept

        return run

    def stay(index: Callable[[], Index]) -> DataFrame:
        run = judged(index, "text")
        return docs.mapInArrow(lambda batches: (part.filter(pa.array(kept)) for part, kept in run(batches)), docs.schema)

    def go(index: Callable[[], Index]) -> DataFrame:
        run = judged(index, "text")
        return rows.mapInArrow(lambda batches: (part.select(["digest"]).filter(pa.array(~kept)) for part, kept in run(batches)), "digest string")

    (digest,) = free(docs.columns, "digest")
    rows = docs.select(F.sha2("text", 256).alias("digest"), F.col("text").cast("string").alias("text"))
    passes = _passes(docs.sparkSession, benchmark, go, stay)
    if len(passes) == 1:
        return passes[0]
    gone = written(reduce(DataFrame.unionByName, passes).distinct().withColumnRenamed("digest", digest), "decontam-gone")
    return docs.withColumn(digest, F.sha2("text", 256)).join(gone, digest, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
