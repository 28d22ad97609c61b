"""The numbered operators as queries, and the SQL that DuckDB can run for them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from drivespan.llm import byte_bpe, decontam, knn_quality, langid, line_dedup, maxent, media, simhash, toxicity, turns, url_filter, variants, wavelet


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_back(wavelet.stored(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(_read(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    held = F.expr("pmod(crc32(cast(doc_id as string)), 3) = 1")
    return toxicity.score(docs, grammar).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "matched_clauses")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = knn_quality.fit(docs, _read(spark, sf_dir, "labels"))
    held = F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0")
    return knn_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= knn_quality.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drivespan.llm.shared import written

    prints = written(simhash.fingerprints(_read(spark, sf_dir, "documents"), width=3), "simhash-prints")
    out = simhash.groups(prints, radius=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_words")


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.expr(langid.HELD_OUT)
    return langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_read(spark, sf_dir, "documents"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(_read(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_wavelet, op2_maxent, op3_media, op4_url_filter, op5_decontam, op6_byte_bpe, op7_toxicity, op8_line_dedup, op9_knn_quality, op10_simhash, op11_langid, op12_variants, op13_turns)}
ORACLES = {"op4_url_filter": url_filter.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL}
