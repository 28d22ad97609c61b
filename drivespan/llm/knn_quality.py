"""Quality by nearest-neighbour voting in a latent-semantic space.

Labelled rows are turned into hashed term vectors, a truncated SVD gives the latent directions, and the
labelled vectors are broadcast. Every document is projected and compared with all of them in exact blocked
cosine products; its K most similar neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drivespan.llm.shared import coded, free, slices, word_lists

#: The classifier's bound: at most so many labelled rows are learned from, the ones of least hash.
SAMPLE_ROWS = 4096
SHAPES, ENDS, WORDS, STATS = 256, 128, 512, 8
DIMS = SHAPES + ENDS + WORDS + STATS
#: How much each group of columns counts in a vector's length.
GROUP_WEIGHTS = ((SHAPES, 1.0), (ENDS, 0.4), (WORDS, 0.4), (STATS, 1.0))
LATENT, K, POWER = 48, 25, 8
THRESHOLD = 0.3


def _shape(word: str) -> str:
    """Letters as a or A, digits as 0, everything else as it is; runs count once."""
    out = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[:1] + word[1:][-12:])
    return re.sub(r"(.)\1+", r"\1", out)


def vectors(texts: pa.Array) -> np.ndarray:
    """A unit vector of DIMS columns for each text; an empty or null text has only its constant column."""
    words, counts = word_lists(texts, lower=False)
    kinds, at = coded(words)
    n = len(counts)
    shape = np.fromiter((zlib.crc32(_shape(w).encode()) % SHAPES for w in kinds), np.int64, len(kinds))
    end = np.fromiter((zlib.crc32(w[-2:].encode()) % ENDS for w in kinds), np.int64, len(kinds))
    word = np.fromiter((zlib.crc32(w.lower().encode()) % WORDS for w in kinds), np.int64, len(kinds))
    size = np.fromiter(map(len, kinds), np.int64, len(kinds))
    upper = np.fromiter((w.isupper() for w in kinds), bool, len(kinds))
    plain = np.fromiter((w.rstrip(".,;:!?").isalpha() for w in kinds), bool, len(kinds))
    doc = np.repeat(np.arange(n), counts)
    out = np.zeros((n, DIMS), np.float32)
    first = 0
    for of, width in ((shape, SHAPES), (end, ENDS), (word, WORDS)):
        tf = np.bincount(doc * width + of[at], minlength=n * width).reshape(n, width)
        out[:, first : first + width] = np.log1p(tf)
        first += width
    per = np.maximum(counts, 1)
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
    kept = np.zeros(len(at), bool)
    order = np.lexsort((at, doc))
    kept[order[1:]] = (at[order[1:]] == at[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    mean = lambda x: np.bincount(doc, x, minlength=n) / per
    stats = [mean(again), mean(kept), mean(upper[at]), mean(~plain[at]), np.minimum(mean(size[at]) / 12, 2), np.log1p(counts) / 20]
    for i, s in enumerate(stats):
        out[:, first + i] = s
    out[:, first + STATS - 1] = 0.1
    first = 0
    for width, weight in GROUP_WEIGHTS:
        part = out[:, first : first + width]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        first += width
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: str, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents that are not held out, those of least hash of their id. Of rows that repeat an id one is taken, that of least hash of its text."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(f"not ({held_out})").groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return one_each(docs, picked)


def one_each(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(text, y): of picked (doc_id, y; few rows) and docs one row for each doc_id, so that what comes of it is no more than picked."""
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "y")).alias("m")).select("m.text", F.col("m.y").cast("int").alias("y"))


class Model:
    """Latent directions and labelled vectors, all of bounded size."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(DIMS, np.float32)
        centred = x - self.mean
        values, directions = np.linalg.eigh(centred.T @ centred)
        self.directions = np.ascontiguousarray(directions[:, np.argsort(-values)[:LATENT]]).astype(np.float32)
        self.points = self._unit(centred @ self.directions)
        self.y = y.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The share of label 1 among the K nearest labelled vectors, weighted by similarity to the power POWER; 0.5 without labels. Of vectors equally near (to six digits) at the last place those that stand first count."""
        if not len(self.y):
            return np.full(len(texts), 0.5)
        own = self._unit((vectors(texts) - self.mean) @ self.directions)
        out = np.empty(len(own))
        k = min(K, len(self.y))
        for a in range(0, len(own), 512):
            cos = np.round(own[a : a + 512] @ self.points.T, 6)
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(cos, near, axis=1).min(axis=1)
            for i in np.flatnonzero((cos >= last[:, None]).sum(axis=1) > k):
                near[i] = np.argsort(-cos[i], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-3).astype(float) ** POWER
            out[a : a + 512] = (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 0", rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most `rows` labelled documents; only their vectors come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = vectors(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), part.column("y")], ["x", "y"])

    got = sample(docs, labels, label, held_out, rows).select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "x binary, y int").collect()
    got.sort(key=lambda r: (bytes(r.x), r.y))  # whatever order the tasks ended in
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), DIMS)
    return Model(x, np.array([r.y for r in got]))


def score(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """docs with score_col (double, 0 to 1). Null texts are empty texts; a column of that name is replaced, all others stay."""
    rest = [c for c in docs.columns if c != score_col]
    # texts that are strings already cross to Python once, with the other columns
    whole = dict(docs.dtypes)["text"] == "string" and "text" in rest
    text = "text" if whole else free(rest, "text_read")[0]
    kept = docs.select(*(F.col(f"`{c}`") for c in rest), *([] if whole else [F.col("text").cast("string").alias(text)]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(shared.value.scores(part.column(text)))], [*rest, score_col])

    return kept.mapInArrow(run, docs.select(*rest).withColumn(score_col, F.lit(0.5)).schema)
