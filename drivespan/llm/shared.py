"""What the operators share: the shared folder, written cut points, Arrow word batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a task turns into words at once; a longer single text is taken whole.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one in the warehouse where that is unset; on a cluster that must not be a machine's own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = kept.get() if kept.isDefined() else None
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/drivespan-scratch"
        if not spark.sparkContext.master.startswith("local") and at.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Paths of the tables written inside each open removed_after(), innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each query that is made and run inside removes its shuffle files as it ends; otherwise they stay until the driver happens to collect its garbage. A frame of it that runs again deals its rows anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the tables of written()."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN[-1:]:
        paths.append(path)
    return path


def put(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, read again. The shuffles on the way go."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there and lost executors cost nothing."""
    return put(df, shared_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """The tables that written() makes inside go at the end; what is to stay of them must have been written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `most` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        # a copy: some Arrow string functions are wrong on arrays that begin in the middle of another's buffer
        yield batch.take(pa.array(np.arange(a, b)))


def word_lists(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ([^\\x20\\x09-\\x0D]+) of the texts in one array, and each text's word count. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    return flat.filter(full), np.bincount(owner[mask], minlength=len(texts)).astype(np.int64)


def coded(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words, and for each word its place among them."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.dictionary.to_numpy(zero_copy_only=False).tolist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def coded_bytes(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """As coded(), with the distinct words as UTF-8 bytes."""
    d = words.dictionary_encode()
    return d.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
