"""Token ids in wavelet matrices, one compressed file per shard.

A file holds its documents' ids and lengths and, for each bit of a token from the highest down, a plane of
bits in which the tokens stand ordered by the bits above, with the number of zeros and a directory of ranks. Planes are
compressed in blocks of BLOCK bits and the directory holds the ones before each block, so the token at a place, the count of a
token before a place, and the place of its n-th occurrence open a few blocks of each plane and no others.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zlib
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from drivespan.llm.shared import ragged, slices, word_lists, written

MAGIC = b"WVM2"
#: Bits of a plane that are compressed together.
BLOCK = 1 << 17
#: A shard is cut into files of about this many tokens.
FILE_TOKENS = 4 << 20
END_ID = 2
#: Text bytes that are encoded at once.
SLICE = 8 << 20


class WaveletMatrix:
    """n tokens of `bits` bits; block(level, b) gives the bytes of a plane's block, ranks the ones before each block and in all."""

    def __init__(self, n: int, zeros: list[int], ranks: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.bits, self.zeros, self.ranks, self.block = n, len(zeros), zeros, ranks, block

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        y = np.empty_like(x)
        planes, zeros = [], []
        for level in reversed(range(bits)):
            one = (x & x.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            zeros.append(len(x) - int(np.count_nonzero(one)))
            if level:
                np.compress(~one, x, out=y[: zeros[-1]])
                np.compress(one, x, out=y[zeros[-1] :])
                x, y = y, x
        step = BLOCK // 8
        edges = np.arange(0, len(planes[0]), step)
        ranks = np.zeros((bits, len(edges) + 1), np.int64)
        for level, p in enumerate(planes):
            if len(p):
                np.cumsum(np.add.reduceat(np.bitwise_count(p), edges, dtype=np.int64), out=ranks[level, 1:])
        return cls(len(ids), zeros, ranks, lambda level, b: planes[level][b * step : (b + 1) * step])

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        b, rest = divmod(i, BLOCK)
        ones = int(self.ranks[level, b])
        if rest:
            own = self.block(level, b)[: (rest + 7) // 8]
            ones += int(np.bitwise_count(own[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                ones += (int(own[-1]) & ((1 << rest % 8) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.block(level, i // BLOCK)[i % BLOCK >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before place i."""
        a = 0
        for level, zeros in enumerate(self.zeros):
            one_a, one_i = self._rank1(level, a), self._rank1(level, i)
            a, i = (zeros + one_a, zeros + one_i) if token >> (self.bits - 1 - level) & 1 else (a - one_a, i - one_i)
        return i - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ones = self.ranks[level]
        edges = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        b = int(np.searchsorted(edges, k, side="right")) - 1
        own = np.unpackbits(self.block(level, b), bitorder="little")[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(own == bit)[k - int(edges[b])])

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        a = 0
        for level, zeros in enumerate(self.zeros):
            ones = self._rank1(level, a)
            a = zeros + ones if token >> (self.bits - 1 - level) & 1 else a - ones
        i = a + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """Every token in order: the planes undone from the lowest up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        if not self.n:
            return x
        for k, level in enumerate(reversed(range(self.bits))):
            plane = np.concatenate([self.block(level, b) for b in range(self.ranks.shape[1] - 1)])
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            y = np.empty_like(x)
            y[np.flatnonzero(~one)] = x[:zeros]
            y[np.flatnonzero(one)] = x[zeros:] | (x.dtype.type(1) << x.dtype.type(k))
            x = y
        return x


def pack(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One file: magic and sizes; document ids, which of them are not null, lengths, zeros and ranks, compressed; the places of the planes' blocks; the blocks."""
    m = WaveletMatrix.build(ids, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks = [squeeze(m.block(level, b).tobytes()) for level in range(bits) for b in range(m.ranks.shape[1] - 1)]
    at = np.cumsum([0, *map(len, blocks)])
    parts = [doc_ids.astype("<i8"), np.packbits(known), lengths.astype("<u8"), np.array(m.zeros, "<u8"), m.ranks.astype("<u8"), at.astype("<u8")]
    small = [squeeze(p.tobytes()) for p in parts]
    return b"".join([MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), bits), *(struct.pack("<Q", len(p)) + p for p in small), *blocks])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, which of them are not null, lengths, and the matrix of a file, whose blocks are opened when they are looked into."""
    if blob[:4] != MAGIC:
        raise ValueError("not a wavelet file")
    n_docs, n, bits = struct.unpack_from("<QQI", blob, 4)
    open_ = zstandard.ZstdDecompressor().decompress
    place, parts = 24, []
    for _ in range(6):
        (size,) = struct.unpack_from("<Q", blob, place)
        parts.append(open_(blob[place + 8 : place + 8 + size]))
        place += 8 + size
    at = np.frombuffer(parts[5], "<u8").astype(np.int64) + place
    per = (len(at) - 1) // bits
    last: dict[int, tuple[int, np.ndarray]] = {}  # of each plane the block opened last

    def block(level: int, b: int) -> np.ndarray:
        if level not in last or last[level][0] != b:
            k = level * per + b
            last[level] = b, np.frombuffer(open_(blob[at[k] : at[k + 1]]), np.uint8)
        return last[level][1]

    ranks = np.frombuffer(parts[4], "<u8").astype(np.int64).reshape(bits, per + 1)
    matrix = WaveletMatrix(n, np.frombuffer(parts[3], "<u8").astype(int).tolist(), ranks, block)
    return np.frombuffer(parts[0], "<i8"), np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs).view(bool), np.frombuffer(parts[2], "<u8").astype(np.int64), matrix


class _Tails(dict):
    """Ids of runs of punctuation, encoded when first met."""

    def __init__(self, one: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.one = one

    def __missing__(self, tail: str) -> bytes:
        self[tail] = found = self.one(tail)
        return found


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct word once; the last words are remembered, KEPT at least and twice as many at most.

    The vocabulary's own splitting never joins anything over white space, and it parts a run of letters from the punctuation behind
    it. So a word is encoded as its core and its tail. Cores of letters alone go through the library's model many at a time, one
    text parted by spaces and cut again at the tokens that end words; of the file's normaliser, only lower-casing changes such letters. Whatever
    is not that plain goes through the whole tokenizer by itself, and so does a text that holds the string of a special token.
    """

    KEPT, TOGETHER = 400_000, 200
    #: ASCII punctuation but the apostrophe, which may belong to letters behind it.
    TAIL = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
    #: Letters alone, none beyond the Latin ones with accents: certainly one run of letters, composed, for any version of Unicode.
    PLAIN = "[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # only texts without their strings come here; lower-casing may have made one
        self.bare = Tokenizer(self.t.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.plain = re.compile(self.PLAIN).fullmatch
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.tails = _Tails(lambda tail: self._ids(self.t.encode(tail, add_special_tokens=False)))

    @staticmethod
    def _ids(encoding) -> bytes:
        return np.array(encoding.ids, np.uint16).tobytes()

    def _learn(self, stems: list[str]) -> None:
        """Remembers the ids of all stems: what is not known comes from before, or else from the library."""
        if len(self.known) > self.KEPT:
            self.known, self.before = {}, self.known
        known, before, cores, others = self.known, self.before, [], []
        for s in dict.fromkeys(stems):
            if s in known:
                continue
            if s in before:
                known[s] = before[s]
            elif self.plain(s):
                cores.append(s)
            else:
                others.append(s)
        groups = [cores[a : a + self.TOGETHER] for a in range(0, len(cores), self.TOGETHER)]
        for group, e in zip(groups, self.bare.encode_batch_fast([" ".join(g).lower() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint16)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 2
            if len(ends) == len(group):
                raw, ends = ids.tobytes(), ends.tolist()
                known.update((c, raw[a:b]) for c, a, b in zip(group, [0, *ends], ends, strict=False))
            else:
                others += group
        known.update(zip(others, map(self._ids, self.t.encode_batch_fast(others, add_special_tokens=False)), strict=True))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts = word_lists(texts)  # A-Z are lower-cased by the vocabulary anyway
        coded = words.dictionary_encode()
        kinds, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cores = pc.utf8_rtrim(kinds, self.TAIL)
        stems = pc.if_else(pc.match_substring_regex(cores, f"^{self.PLAIN}$"), cores, kinds).to_numpy(zero_copy_only=False).tolist()
        self._learn(stems)
        known, tails = self.known, self.tails
        got = [known[s] if len(s) == len(k) else known[s] + tails[k[len(s) :]] for s, k in zip(stems, kinds.to_numpy(zero_copy_only=False).tolist(), strict=True)]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 2
        flat = np.frombuffer(b"".join(got), np.uint16)
        start, size_at = (np.cumsum(size) - size)[at], size[at]
        total = np.concatenate([[0], np.cumsum(size_at)])
        ends = np.cumsum(counts)
        return flat[ragged(start, size_at)], total[ends] - total[ends - counts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._words(texts)
        ids, n = self._words(pc.if_else(pa.array(marked), "", texts))
        where = np.flatnonzero(marked)
        whole = [np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint16) for i in where]
        own = np.split(ids, np.cumsum(n)[:-1])
        for i, x in zip(where.tolist(), whole, strict=True):
            own[i] = x
        return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))


_ENCODERS: dict[str, WordEncoder] = {}


def shards(docs: DataFrame, path: str, bits: int = 16, file_tokens: int = FILE_TOKENS, partitions: int | None = None) -> DataFrame:
    """(shard, part, n_docs, n_tokens, file): wavelet files in ascending doc_id order, each document's ids followed by END_ID.

    Null texts are empty; rows with a null doc_id come first, and those that repeat one stand side by side, in the order they are read in. A shard is one range of
    doc_ids and places, so rows of one id, or of none, may fill several; its files hold about file_tokens tokens each (a longer document stays
    whole). Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), F.col("place")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, None) or WordEncoder(path)
        _ENCODERS[path] = encoder
        held, size, part, shard = [], 0, 0, None

        def file() -> pa.RecordBatch:
            who, known, lengths, ids = (np.concatenate([x[i] for x in held]) for i in range(4))
            blob = pack(who, known, lengths, ids, bits)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (part, pa.int32()), (len(who), pa.int64()), (len(ids), pa.int64()), (blob, pa.binary()))], ["shard", "part", "n_docs", "n_tokens", "file"])

        for batch in batches:
            for own in slices(batch, "text", SLICE):
                shard = own.column("shard")[0].as_py()
                ids, n = encoder.encode(own.column("text"))
                ids = np.insert(ids, np.cumsum(n), END_ID)
                who = own.column("doc_id")
                held.append((who.fill_null(0).to_numpy(zero_copy_only=False), who.is_valid().to_numpy(zero_copy_only=False), n + 1, ids))
                size += len(ids)
                if size >= file_tokens:
                    yield file()
                    held, size, part = [], 0, part + 1
        if held:
            yield file()

    return rows.mapInArrow(run, "shard int, part int, n_docs long, n_tokens long, file binary")


def starts(files: DataFrame) -> DataFrame:
    """(shard, part, start): tokens in all files before. Running sums within groups of 1024 shards, then over the groups' totals."""
    own = files.select("shard", "part", "n_tokens", F.floor(F.col("shard") / 1024).alias("g"))
    totals = own.groupBy("g").agg(F.sum("n_tokens").alias("t")).select("g", F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("g").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("within", within).join(totals, "g").select("shard", "part", (F.col("before") + F.col("within")).alias("start"))


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, part) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "file")), strict=True):
                who, known, n, matrix = unpack(blob)
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(n).tolist()
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(who, mask=~known), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(who), shard, np.int32)), pa.array(np.full(len(who), part, np.int32))], ["doc_id", "own", "n_tokens", "ids_crc32", "shard", "part"])

    docs = files.select("shard", "part", "file").mapInArrow(run, "doc_id long, own long, n_tokens long, ids_crc32 long, shard int, part int")
    return docs.join(starts(files), ["shard", "part"]).select("doc_id", (F.col("start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "shard", "part")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """(shard, part, count, first): how often a token stands in each file and its first place there (null if none), from a few blocks of each plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, part, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "file")), strict=True):
                m = unpack(blob)[3]
                n = m.count(token)
                rows.append({"shard": shard, "part": part, "count": n, "first": m.select(token, 0) if n else None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("count", pa.int64()), ("first", pa.int64())]))

    return files.select("shard", "part", "file").mapInArrow(run, "shard int, part int, count long, first long")


def stored(docs: DataFrame, path: str) -> DataFrame:
    """The files of shards(), written to the shared folder and opened again."""
    return written(shards(docs, path), "wavelet")
