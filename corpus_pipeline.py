"""A training corpus from raw documents: five stages over all rows, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from drivespan.llm import byte_bpe, decontam, knn_quality, line_dedup, simhash
from drivespan.llm.shared import remove, removed_after, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote them good stay; the votes are learned from labels that are not held out."""
    model = knn_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return knn_quality.score(docs, model, "__score").filter(F.col("__score") >= knn_quality.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts but for each template's first; n_chars follows the text. Copies of a whole document keep what they share with it, so that the next stage sees them."""
    out = line_dedup.dedup(docs, copies=line_dedup.COPIES)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the least doc_id: five-word shingles with similarity 0.8 or more."""
    return simhash.similar_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids instead of its text, their number, and the digest of the text that they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.encode(docs, path, pattern, digest_col="decoded_sha256")
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("byte-level bpe", tokens)]

#: SimHash and the vote of neighbours are not expressible in SQL; tests/llm compares each stage, and the run, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What stands between two of them is a table in the shared folder, which goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with removed_after(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
