"""Language identification by compression with per-language dictionaries.

A language's zstandard raw-content dictionary is made of its most widespread words, the commonest last, where matches cost least. A text is
lower-cased and reduced to its distinct words of letters in order; blocks of them are compressed with each dictionary, and the language
of least total size is chosen. Every block ends with the same run of digits, which no dictionary holds: without it zstandard stores short blocks as
they are, whatever the dictionary. Of languages equally small the one with more rows to learn from is chosen. A choice is accepted if its margin over the
second is wide enough, and rejected otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from drivespan.llm.shared import free, slices

#: The classifier's bounds: languages (those with most rows), rows of each to learn from (those of least hash), and bytes of a dictionary.
MOST_LANGUAGES, SAMPLE_ROWS, DICTIONARY_BYTES = 64, 2000, 32 << 10
#: Longer words tell nothing about a language and are not put into dictionaries.
LONGEST = 40
#: Characters of a text that are compressed together.
BLOCK = 4096
#: Digits behind every block, made by a rule so that they don't repeat: the last digits of squares modulo a prime.
FILLER = "".join(str(k * k % 8191 % 10) for k in range(1, 129)).encode()
LEVEL, LEAST_MATCH = 6, 4
#: A choice is rejected if the second language's size is within this share of the chosen one's.
MARGIN = 0.01
UNKNOWN = "und"
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 3) = 1"


def reduced(texts: pa.Array) -> list[list[str]]:
    """Each text's distinct words of letters and their marks, lower-cased, in order of their first place. Null texts have none, and marks alone are no word."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    letters = pc.replace_substring_regex(lower, r"[^\pL\pM]+", " ")
    return [[w for w in dict.fromkeys(t.split(" ")) if w[:1].isalpha() or any(map(str.isalpha, w))] for t in pc.utf8_trim(letters, " ").to_pylist()]


def blocks(words: list[str]) -> list[bytes]:
    """The words as text in blocks of about BLOCK characters, each with FILLER behind it."""
    text = f" {' '.join(words)} "
    return [text[a : a + BLOCK].encode() + FILLER for a in range(0, len(text), BLOCK)]


class Model:
    """Languages in order of preference among equals, with their dictionaries; of bounded size."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages, self.contents = list(dictionaries), list(dictionaries.values())

    def __getstate__(self):
        return {"languages": self.languages, "contents": self.contents}

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        own = {"min_match": LEAST_MATCH, "strategy": zstandard.STRATEGY_LAZY, "window_log": 17, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, **own)
        return [zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in self.contents]

    def predict(self, texts: pa.Array, margin: float = MARGIN) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, its share among 2 ** -(bytes) of all languages, and whether the margin is wide enough."""
        n = len(texts)
        said, share, wide = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        if not self.languages:
            return said, share, wide
        for i, words in enumerate(reduced(texts)):
            if not words:
                continue
            parts = blocks(words)
            size = np.array([sum(len(c.compress(b)) for b in parts) for c in self.compressors])
            best = int(np.argmin(size))
            said[i] = self.languages[best]
            share[i] = 1 / np.exp2(-np.minimum(size - size[best], 1000.0)).sum()
            wide[i] = len(size) == 1 or np.partition(size, 1)[1] >= (1 + margin) * size[best]
        return said, share, wide


def fit(docs: DataFrame, held_out: str = HELD_OUT, rows: int = SAMPLE_ROWS, most: int = MOST_LANGUAGES) -> Model:
    """A model of the rows with a doc_id, a lang and a text that are not held out: `rows` of each language, those of least hash of id and text.

    Languages count by all their rows. What comes to the driver is at most DICTIONARY_BYTES a language. Without rows the model is empty.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and lang is not null and text is not null").filter(f"not ({held_out})")
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    # a share of each language's rows a little larger than what is needed comes to the exact choice, so that no task ranks a language as a whole
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, min(1.0, 1.2 * rows / r.n + 1e-6)) for r in top), F.lit(0.0))
    place = F.xxhash64("doc_id", "text")
    near = known.filter(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(1 << 30)), place, "doc_id")
    picked = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that hold a word, by language."""
        for part in (p for batch in batches for p in slices(batch, "text")):
            found: dict[str, Counter] = {}
            for lang, words in zip(part.column("lang").to_pylist(), reduced(part.column("text")), strict=True):
                found.setdefault(lang, Counter()).update(w for w in words if len(w) <= LONGEST)
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])

    words = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = words.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= DICTIONARY_BYTES // 3).select("lang", "word", "r").withColumn("size", F.octet_length("word") + 1)
    ahead = F.sum("size").over(Window.partitionBy("lang").orderBy("r"))
    kept = common.withColumn("ahead", ahead).filter(F.col("ahead") < DICTIONARY_BYTES).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word")), asc=False).alias("w")).select("lang", F.concat(F.array_join("w.word", " "), F.lit(" ")).alias("words"))
    found = {r.lang: r.words.encode() for r in kept.collect()}
    return Model({r.lang: found.get(r.lang, b"") for r in top if r.lang in found})


def predict(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred (string), score (double, 0 to 1) and accepted (boolean); columns of those names are replaced, all others stay.

    Null texts, texts without a letter, and all texts if nothing was learned, are UNKNOWN with score 0, and not accepted. Rows that repeat are judged each, alike.
    """
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    (text,) = free(rest, "text_read")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, text)):
            said, share, wide = shared.value.predict(part.column(text), margin)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(said, pa.string()), pa.array(share), pa.array(wide)], [*rest, "lang_pred", "score", "accepted"])

    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.5), "accepted": F.lit(True)}).schema
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string").alias(text)).mapInArrow(run, schema)
