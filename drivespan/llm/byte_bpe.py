"""Byte-level BPE: length-bucketed padded matrices, one merge per row and round.

Every distinct piece of a batch is a row of byte tokens in a matrix for its length. In each round all
neighbouring pairs are looked up in a hash table of mergeable pairs, every row merges its leftmost pair of
least rank, and rows close up; rows without a mergeable pair are done. Pieces are cut first between bytes that
stand side by side in no token, as nothing merges there. A row of over LONG bytes is a matrix of its own and merges in each round the leftmost pair of least rank
together with all its repeats up to the first whose merge makes a pair of lesser rank: what the single merges would come to one after another.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from drivespan.llm.shared import free, ragged, slices

#: The characters with Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = np.int32(1 << 30)
#: Rows of more bytes than this merge a pair's repeats together.
LONG = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from pairs of token ids to the merged id, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(8, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 0
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[at] == np.iinfo(np.uint64).max
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], merged[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.iinfo(np.uint64).max))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != np.iinfo(np.uint64).max)]
        return out


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks, and a pattern that splits texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(merged, np.int32))
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.joined = np.zeros((256, 256), bool)
        for token in self.ranks:
            own = np.frombuffer(token, np.uint8)
            self.joined[own[:-1], own[1:]] = True
        self.token_len = np.array([len(x) for x in by_rank], np.int64)
        self.names = [b"%d" % i for i in range(size)]
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        exact = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.pieces = regex.compile(exact).findall
        # runs of white space and what stands between them, each with the space before it: no piece reaches over these
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall

    def _merge(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of a padded matrix of token ids; the merged matrix and the rows' new lengths."""
        lengths = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        m = rows[live]
        while len(live):
            wide = m.shape[1]
            found = self.pairs.get(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), wide - 1)
            found[np.arange(1, wide) >= lengths[live, None]] = NONE
            at = found.argmin(axis=1)
            best = found[np.arange(len(m)), at]
            done = best == NONE
            if done.any():
                rows[live[done], :wide] = m[done]
                live, m, at, best = live[~done], m[~done], at[~done], best[~done]
                if not len(live):
                    break
            m[np.arange(len(m)), at] = best
            shifted = np.arange(wide - 1) > at[:, None]
            m = np.concatenate([np.where(shifted, m[:, 1:], m[:, :-1]), m[:, -1:]], axis=1)
            lengths[live] -= 1
            m = m[:, : max(2, int(lengths[live].max()))]
        return rows, lengths

    def _merge_long(self, row: np.ndarray) -> np.ndarray:
        """All merges of one row of token ids."""
        found = self.pairs.get(row[:-1], row[1:])
        while len(found):
            best = found.min()
            if best == NONE:
                break
            at = np.flatnonzero(found == best)
            first = np.flatnonzero(np.append(True, np.diff(at) > 1))  # of a run of overlapping pairs every other one
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            before, after = np.full(len(at), NONE), np.full(len(at), NONE)
            some = at > 0
            left = np.where(np.append(False, np.diff(at) == 2), best, row[at - 1])  # the repeat before has been merged by then
            before[some] = self.pairs.get(left[some], np.full(int(some.sum()), best))
            some = at + 2 < len(row)
            after[some] = self.pairs.get(np.full(int(some.sum()), best), row[at[some] + 2])
            lesser = np.flatnonzero((before < best) | (after < best))
            if len(lesser):
                at = at[: lesser[0] + 1]
            row[at] = best
            row, found = np.delete(row, at + 1), np.delete(found, at)
            new = at - np.arange(len(at))
            near = np.concatenate([new[new > 0] - 1, new[new < len(found)]])
            found[near] = self.pairs.get(row[near], row[near + 1])
        return row

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and each piece's number of ids."""
        whole = np.fromiter((x in self.ranks for x in pieces), bool, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        if whole.all() or not len(flat):
            return self._encode_parts(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cut = np.zeros(len(flat), bool)  # before a byte that nothing joins to the one before, but not inside whole pieces
        cut[1:] = ~self.joined[flat[:-1], flat[1:]]
        cut &= ~np.repeat(whole, sizes)
        starts = np.cumsum(sizes) - sizes
        cut[starts[sizes > 0]] = True
        at = np.flatnonzero(cut)
        raw, ends = flat.tobytes(), np.append(at[1:], len(flat)).tolist()
        parts = pa.array([raw[a:b] for a, b in zip(at.tolist(), ends, strict=True)], pa.large_binary()).dictionary_encode()
        ids, count = self._encode_parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        of = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(count) - count
        per = np.searchsorted(at, starts + sizes) - np.searchsorted(at, starts)
        return ids[ragged(start[of], count[of])], _sums(count[of], per)

    def _encode_parts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ranks.get(x, -1) for x in pieces), np.int64, len(pieces))
        count[whole >= 0] = 1
        parts = []
        bucket = np.frexp(np.maximum(sizes - 1, 0).astype(float))[1]  # 2**(k-1) < size <= 2**k
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)):
            flat = self._merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)])
            count[i] = len(flat)
            parts.append((np.array([i]), flat, count[[i]]))
        for k in np.unique(bucket[(whole < 0) & (sizes <= LONG)]):
            ix = np.flatnonzero((whole < 0) & (sizes <= LONG) & (bucket == k))
            cells = max(1, (1 << 22) >> int(k))
            for a in range(0, len(ix), cells):
                own = ix[a : a + cells]
                n = sizes[own]
                rows = np.zeros((len(own), max(2, int(n.max()))), np.int32)
                rows[np.arange(rows.shape[1]) < n[:, None]] = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)]
                rows, got = self._merge(rows, n)
                count[own] = got
                parts.append((own, rows[np.arange(rows.shape[1]) < got[:, None]], got))
        start = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[start[whole >= 0]] = whole[whole >= 0]
        for own, flat, got in parts:
            ids[ragged(start[own], got)] = flat
        return ids, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        found = [self.chunks(t) for t in texts]
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array([c for x in found for c in x], pa.large_string()).dictionary_encode()
        at, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        split = [self.pieces(x) for x in kinds]
        per_kind = np.fromiter(map(len, split), np.int64, len(split))
        pieces = pa.array([p for x in split for p in x], pa.large_string()).dictionary_encode()
        ids, count = self.encode_pieces(pieces.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        start = np.cumsum(count) - count
        of = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kind_ids, kind_count = ids[ragged(start[of], count[of])], _sums(count[of], per_kind)
        kind_start = np.cumsum(kind_count) - kind_count
        return kind_ids[ragged(kind_start[at], kind_count[at])], _sums(kind_count[at], per_text)

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        n = self.token_len[ids]
        flat = self.token_bytes[ragged(self.token_start[ids], n)].tobytes()
        ends = np.cumsum(_sums(n, per_text)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of per[i] values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]


def _id_slices(batch: pa.RecordBatch, ids_col: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `most` ids, each with its ids one after another and their number by row."""
    if not batch.num_rows:
        return
    n = batch.column(ids_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1
    starts = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        part = batch.slice(a, b - a)
        yield part, part.column(ids_col).flatten().to_numpy(zero_copy_only=False), n[a:b]


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


#: Text bytes that are encoded at once.
SLICE = 2 << 20


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", digest_col: str | None = None) -> DataFrame:
    """docs with ids_col (array<int>) instead of text_col: the ids of each whole text; null texts have none. Other columns stay, those of the new names are replaced.

    With digest_col, the ids are decoded again in the same pass and the SHA-256 of the bytes is added.
    """
    rest = [c for c in docs.columns if c not in (text_col, ids_col, digest_col)]
    (text,) = free(rest, "text_read")
    kept = docs.select(F.col(f"`{text_col}`").cast("string").alias(text), *(F.col(f"`{c}`") for c in rest))
    new = {ids_col: F.lit(None).cast("array<int>")} | ({digest_col: F.lit(None).cast("string")} if digest_col else {})
    schema = kept.drop(text).withColumns(new).schema
    names = [*rest, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, n = bpe.encode([t or "" for t in part.column(text).to_numpy(zero_copy_only=False)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                more = [pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, n)], pa.string())] if digest_col else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists, *more], names)

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """coded with bytes_col (binary): the bytes that ids_col stands for; null for null ids. ids_col stays."""
    rest = [c for c in coded.columns if c not in (ids_col, bytes_col)]
    kept = coded.select(F.col(ids_col).cast("array<int>").alias(ids_col), *(F.col(c) for c in rest))
    schema = kept.withColumn(bytes_col, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for part, flat, n in _id_slices(batch, ids_col):
                known = part.column(ids_col).is_valid().to_pylist()
                out = bpe.decode(flat, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x if k else None for x, k in zip(out, known, strict=True)], pa.binary())], [*batch.schema.names, bytes_col])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids, and gives the digests of both, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        names = bpe.names
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, n = bpe.encode([t or "" for t in part.column("text").to_numpy(zero_copy_only=False)])
                ends = np.cumsum(n).tolist()
                told = ids.tolist()
                spelt = [hashlib.sha256(b" ".join([names[i] for i in told[a:b]])).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
                back = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(spelt, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
