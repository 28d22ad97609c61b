"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | before) = P(group | before) P(class | group, before) P(word | class). The two softmaxes have a weight for each
hashed feature of what stands before: the last word, the one before it (skip), both together (n-gram), and the last
three words' groups. Weights are learned by distributed gradient updates: every task takes Adagrad steps over its own
documents from the shared weights, and the tasks' weights are averaged by shards of the weight table, first within SLOTS groups of tasks. Within a class, words
have smoothed relative frequencies, one share being kept for unknown words, so that all probabilities sum to one.

The commonest words are classes of their own; the others' classes follow from their letters. Counts of the HEAD commonest words are broadcast;
all other words meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from drivespan.llm.shared import slices, word_lists, written

GROUPS, MEMBERS = 16, 16
#: Commonest words with classes of their own; they fill the first groups.
SINGLES = 64
#: Commonest words whose counts every executor holds: 12 bytes each.
HEAD = 1 << 16
#: Rows of the hashed table: one for every WORDS_A_ROW distinct words, a power of two within these bounds. The upper one keeps a task's tables within 9 MB each; twice as many scored better (README), but took too much time.
BUCKETS, WORDS_A_ROW = (1 << 12, 1 << 13), 64
FEATURES = 5
#: Text bytes that a task turns into tokens at once.
SLICE = 3 << 20
RATE, BATCH = 0.3, 1 << 14
#: Shards in which the changes of the weights are averaged.
SHARDS, SLOTS = 32, 32
END = b"\n"
LOG10 = 1 / math.log(10)


def hashes(kinds: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, kinds), np.uint64, len(kinds)).view(np.int64)


def _among(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


SIGNS, PUNCTUATION = _among(b"$%&*#|!"), _among(b".,;:!?")
#: Second bytes of letters, all with a first byte of 0xC3 in UTF-8: the umlauts and sharp s, and Spanish letters.
UMLAUTS, TILDES = _among("äöüß".encode()[1::2]), _among("ñíóáú".encode()[1::2])


def form_classes(words: pa.Array) -> np.ndarray:
    """A class for each word from its letters: its group from rare letters or signs or else its last two letters, its member from its last three."""
    if not len(words):
        return np.empty(0, np.int64)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(1, np.uint8)])
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    tail = np.zeros(len(words), np.int64)
    open_ = np.arange(len(words))
    while len(open_):  # one more sign of punctuation at the end
        at = ends[open_] - tail[open_] - 1
        open_ = open_[(at >= starts[open_]) & PUNCTUATION[data[at]]]
        tail[open_] += 1
    bare = ends - tail
    last = lambda end, k: np.where(end - k >= starts, data[end - k], 0).astype(np.uint64)
    mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    two = last(bare, 1) | last(bare, 2) << np.uint64(8)
    three = two | last(bare, 3) << np.uint64(16)
    first = SINGLES // MEMBERS
    group = first + 4 + (mixed(two) % np.uint64(GROUPS - first - 4)).astype(np.int64)

    def holds(flags: np.ndarray) -> np.ndarray:
        """Words with a flagged byte before their tail."""
        at = np.flatnonzero(flags)
        return np.searchsorted(at, bare) > np.searchsorted(at, starts)

    second = np.append(False, data[:-1] == 0xC3)
    group[holds(data >= 0x80)] = first + 3
    group[holds(second & TILDES[data])] = first + 2
    group[holds(second & UMLAUTS[data])] = first + 1
    group[SIGNS[last(ends, 1).astype(np.uint8)] | SIGNS[last(ends, 2).astype(np.uint8)] | SIGNS[last(ends, 3).astype(np.uint8)]] = first
    return group * MEMBERS + ((mixed(three) % np.uint64(MEMBERS)).astype(np.int64) + 7 * tail) % MEMBERS


def kinds_of(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words and END after them, their hashes, and each word's place among them."""
    coded = words.dictionary_encode()
    kinds = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()), pa.array([END], pa.large_binary())])
    return kinds, hashes(kinds.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(h, cls, c): each word's hash, class by form, and count in all texts; every text has one END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                kinds, h, at = kinds_of(word_lists(part.column("text"))[0])
                c = np.append(np.bincount(at, minlength=len(kinds) - 1), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(form_classes(kinds).astype(np.int16)), pa.array(c.astype(np.int64))], ["h", "cls", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, cls short, c long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


class Vocabulary:
    """Totals, the head's counts, and for each class its total and number of words."""

    def __init__(self, total: int, distinct: int, head: list[tuple[int, int, int]], classes: list[tuple[int, int, int]]):
        self.total, self.distinct = total, distinct
        self.buckets = min(max(1 << max(0, distinct // WORDS_A_ROW - 1).bit_length(), BUCKETS[0]), BUCKETS[1])
        single = sorted((h, k) for k, (h, _, _) in enumerate(head[:SINGLES]))
        self.single, self.place = (np.array([x[i] for x in single], np.int64) for i in range(2))
        order = sorted(head)
        self.h = np.array([x[0] for x in order], np.int64)
        self.c = np.array([x[2] for x in order], np.int64)
        self.class_total, self.class_words = np.zeros(GROUPS * MEMBERS), np.zeros(GROUPS * MEMBERS)
        for cls, c, v in classes:
            self.class_total[cls], self.class_words[cls] = c, v
        for h, cls, c in head[:SINGLES]:
            self.class_total[cls] -= c
            self.class_words[cls] -= 1

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words by hash and whether they are in the head."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        return np.where(found, self.c[at], 0), found

    def classes(self, kinds: pa.Array, h: np.ndarray) -> np.ndarray:
        own = form_classes(kinds)
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            own = np.where(self.single[at] == h, self.place[at], own)
        return own

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def within(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(word | class); a class of a single word has nothing to tell."""
        p = np.log10((c + 0.5) / (self.class_total[cls] + 0.5 * (self.class_words[cls] + 1)))
        return np.where(cls < SINGLES, 0.0, p)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the head is what reaches a count that at most HEAD words reach; a histogram of counts, a few hundred rows, tells which
    level = F.floor(F.log2("c") * 32)
    hist = sorted(((r.k, r["count"]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True)
    least, words = math.inf, 0
    for k, n in hist:
        words += n
        if words > HEAD:
            break
        least = k
    head = sorted((tuple(r) for r in counts.filter(level >= F.lit(float(least))).collect()), key=lambda x: (-x[2], x[0]))
    classes = [tuple(r) for r in counts.groupBy("cls").agg(F.sum("c"), F.count("*")).collect()]
    return Vocabulary(total.n or 0, total.v, head, classes)


class Tokens:
    """A batch of texts as tokens: kinds, each token's place among them, classes and features. Every text ends with END."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        words, counts = word_lists(texts)
        self.kinds, self.h, at = kinds_of(words)
        self.kind_class = vocabulary.classes(self.kinds, self.h)
        self.counts = counts + 1
        self.at = np.insert(at, np.cumsum(counts), len(self.kinds) - 1)
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        self.cls = self.kind_class[self.at]
        n = len(self.at)
        word = (self.h.view(np.uint64) & np.uint64(0xFFFFFFF)).astype(np.int64)[self.at]
        group = self.cls // MEMBERS
        place = np.arange(n) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        back = lambda x, k: np.where(place >= k, np.roll(x, k), -1)
        w1, w2 = back(word, 1), back(word, 2)
        groups = ((back(group, 1) + 1) * (GROUPS + 1) + back(group, 2) + 1) * (GROUPS + 1) + back(group, 3) + 1
        mix = lambda x, k: ((x * 0x5851F42D4C957F2D + k * 0x14057B7EF767814F) >> 33) & (vocabulary.buckets - 1)
        with np.errstate(over="ignore"):
            self.features = np.stack([x.astype(np.int32) for x in (np.zeros(n), mix(w1, 1), mix(w2, 2), mix(w1 * 31 + w2, 3), mix(groups, 4))], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order of keys below 2**32, by their 16-bit halves, which are radix-sorted."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    if len(keys) and keys.max() >> 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Weights:
    """Two tables: features to groups, and features and group to members. Feature 0 is always on."""

    def __init__(self, buckets: int):
        self.group = np.zeros((buckets, GROUPS), np.float32)
        self.member = np.zeros((buckets * GROUPS, MEMBERS), np.float32)

    def forward(self, f: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the groups and of the group's members, and the rows of the features but the first in the second table."""
        own = cls // MEMBERS
        rows = f[:, 1:] * GROUPS + own[:, None]
        a, b = self.group[f[:, 1]], self.member[rows[:, 0]]
        for k in range(2, FEATURES):
            a += self.group[f[:, k]]
            b += self.member[rows[:, k - 1]]
        a += self.group[0]
        b += self.member[own]
        return _softmax(a), _softmax(b), rows

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 P(class | before) of each token."""
        out = np.empty(len(t.cls))
        for x in range(0, len(out), BATCH):
            f, cls = t.features[x : x + BATCH], t.cls[x : x + BATCH]
            p, q, _ = self.forward(f, cls)
            i = np.arange(len(cls))
            out[x : x + len(cls)] = np.log10(np.maximum(p[i, cls // MEMBERS], 1e-30).astype(float) * np.maximum(q[i, cls % MEMBERS], 1e-30))
        return out

    @staticmethod
    def _step(table: np.ndarray, sums: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
        sums[own] += total * total
        table[own] -= RATE * total / np.sqrt(sums[own] + 1e-6)

    def steps(self, t: Tokens, seen: Weights) -> None:
        """Adagrad steps over a batch; seen holds the squared gradients so far."""
        each = FEATURES - 1
        for x in range(0, len(t.cls), BATCH):
            f, cls = t.features[x : x + BATCH], t.cls[x : x + BATCH]
            p, q, rows = self.forward(f, cls)
            i, own, scale = np.arange(len(cls)), cls // MEMBERS, np.float32(1 / math.sqrt(len(cls)))
            p[i, own] -= 1
            q[i, cls % MEMBERS] -= 1
            p *= scale
            q *= scale
            for table, sums, grad, at in ((self.group, seen.group, p, f[:, 1:]), (self.member, seen.member, q, rows)):
                flat = at.ravel()
                order = _order(flat)
                held = flat[order]
                first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
                self._step(table, sums, held[first], np.add.reduceat(grad[order // each], first, axis=0))
            of_group = _order(own)
            held = own[of_group]
            first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            self._step(self.member, seen.member, held[first], np.add.reduceat(q[of_group], first, axis=0))
            self._step(self.group, seen.group, np.zeros(1, np.int64), p.sum(axis=0, keepdims=True))

    def parts(self) -> list[bytes]:
        g = np.array_split(self.group, SHARDS)
        m = np.array_split(self.member, SHARDS)
        return [a.tobytes() + b.tobytes() for a, b in zip(g, m, strict=True)]

    def put(self, shard: int, values: np.ndarray) -> None:
        a, b = np.array_split(self.group, SHARDS)[shard], np.array_split(self.member, SHARDS)[shard]
        a[:] = values[: a.size].reshape(a.shape)
        b[:] = values[a.size :].reshape(b.shape)


def trained(docs: DataFrame, vocabulary: Vocabulary, epochs: int = 1) -> Weights:
    """Weights after `epochs` rounds over all rows of docs. In each, every task learns from its own rows, and the tasks' weights are averaged by the number of their tokens."""
    sc = docs.sparkSession.sparkContext
    weights, shared = Weights(vocabulary.buckets), sc.broadcast(vocabulary)
    rows = docs.select(F.col("text").cast("string").alias("text"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the parts by shard, one at a time; what is held is one weight table."""
        sums: dict[int, list] = {}
        for batch in batches:
            for shard, n, change in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "change")), strict=True):
                x = np.frombuffer(change, np.float32).astype(np.float64) * n
                got = sums.setdefault(shard, [0, np.zeros(len(x))])
                got[0] += n
                got[1] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([(v[1] / max(1, v[0])).astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["shard", "slot", "n", "change"])

    for _ in range(epochs):
        start = sc.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            slot = TaskContext.get().partitionId() % SLOTS
            own, seen, n = Weights(vocabulary.buckets), Weights(vocabulary.buckets), 0
            own.group[:], own.member[:] = start.value.group, start.value.member
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    t = Tokens(part.column("text"), shared.value)
                    own.steps(t, seen)
                    n += len(t.cls)
            if n:
                for k, p in enumerate(own.parts()):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([p], pa.binary())], ["shard", "slot", "n", "change"])

        schema = "shard int, slot int, n long, change binary"
        got = rows.mapInArrow(learn, schema).repartition("shard", "slot").mapInArrow(total, schema).repartition("shard").mapInArrow(total, schema)
        for r in got.collect():
            weights.put(r.shard, np.frombuffer(r.change, np.float32))
    return weights


def scored(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: Weights) -> DataFrame:
    """docs' doc_id and held_out with n_tokens, n_known, base_score, score. Rows keep apart even where doc_ids repeat; null texts are empty and have one token, END."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_type = pa.list_(pa.struct([("h", pa.int64()), ("cls", pa.int16()), ("tf", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                v, w = shared.value
                t = Tokens(part.column("text"), v)
                n = len(t.counts)
                c, head = v.look(t.h)
                known = head[t.at]
                add = lambda x: np.bincount(t.doc, x, minlength=n)
                base = add(np.where(known, v.base(c)[t.at], 0.0))
                word = add(np.where(known, v.within(t.kind_class, c)[t.at], 0.0))
                path = add(w.log10(t))
                rest = np.flatnonzero(~known)
                pair, tf = np.unique(t.doc[rest] * len(t.kinds) + t.at[rest], return_counts=True)
                owner, kind = pair // len(t.kinds), pair % len(t.kinds)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(t.h[kind]), pa.array(t.kind_class[kind].astype(np.int16)), pa.array(tf.astype(np.int32))], fields=list(tail_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in ("row", "doc_id", "held_out")), pa.array(t.counts), pa.array(add(known).astype(np.int64)), pa.array(base), pa.array(path + word), pa.ListArray.from_arrays(pa.array(ends), rows)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_head", "base", "own", "tail"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    got = written(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, own double, tail array<struct<h:long,cls:short,tf:int>>"), "maxent-scores")
    tail = got.select("row", F.inline("tail"))
    v = vocabulary
    whole = v.total + 0.5 * (v.distinct + 1)
    of_class = F.array(*(F.lit(float(x)) for x in v.class_total + 0.5 * (v.class_words + 1)))
    rare = counts.select("h", "c").filter(F.col("c") <= int(v.c.min())) if len(v.h) else counts.select("h", "c")
    c = F.coalesce("c", F.lit(0))
    met = tail.join(rare.hint("merge"), "h", "left").select("row", (F.col("tf") * F.log10((c + 0.5) / whole)).alias("base"), (F.col("tf") * F.log10((c + 0.5) / F.get(of_class, F.col("cls").cast("int")))).alias("own"), F.when(c > 0, F.col("tf")).otherwise(0).alias("known"))
    sums = met.groupBy("row").agg(F.sum("base").alias("t_base"), F.sum("own").alias("t_own"), F.sum("known").alias("t_known"))
    zero = lambda k: F.coalesce(k, F.lit(0))
    return got.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + zero("t_known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + zero("t_base")).alias("base_score"), (F.col("own") + zero("t_own")).alias("score")
    )


def score_texts(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 1", epochs: int = 1) -> DataFrame:
    """Learns from every document that is not held out and scores all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).
    Null ids are not held out. Without training documents every token has the uniform share of an empty vocabulary.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    learn = rows.filter("not held_out")
    counts = written(counted(learn), "maxent-counts")
    v = vocabulary(counts)
    return scored(rows, counts, v, trained(learn, v, epochs))
