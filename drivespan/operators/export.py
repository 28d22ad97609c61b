"""The canonical event record: stable ids, cleaning, provenance, validation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quantized(seconds: Column) -> Column:
    """Seconds as text with two decimals, rounded half up on the decimal text; -0.00 is 0.00."""
    d = F.round(seconds.cast("string").cast("decimal(20,6)"), 2)
    return F.when(d == 0, "0.00").otherwise(d.cast("decimal(20,2)").cast("string"))


def stable_id(dataset: Column, drive: Column, segment: Column, start: Column, event_type: Column, detector: Column) -> Column:
    """nm_ and 16 hex digits of the SHA-256 of the key's parts, one a line."""
    parts = [dataset, drive, segment.cast("string"), quantized(start), event_type, detector]
    key = F.concat_ws("\n", *parts)
    bad = parts[0].isNull() | parts[1].isNull() | start.isNull() | event_type.isNull() | detector.isNull()
    return F.when(bad, F.raise_error(F.lit("an id needs dataset, drive, start, type and detector")).cast("string")).otherwise(F.concat(F.lit("nm_"), F.substring(F.sha2(key, 256), 1, 16)))


def clean_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when((t == "") | (F.lower(t) == "nan"), None).otherwise(t)


def split_pipe(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), F.trim), lambda x: x != "")


def to_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "1.0", "yes"), True).when(t.isin("false", "0", "0.0", "no"), False)


def utc_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.round(seconds * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def provenance(record: dict[str, tuple[Column, str]]) -> tuple[Column, Column, Column]:
    """From path -> (value, copied / derived / constant): the record's values as text by path, the source of each known one, and the paths that are missing."""
    pairs = [F.struct(F.lit(p).alias("k"), v.cast("string").alias("v"), F.lit(s).alias("s")) for p, (v, s) in record.items()]
    known = F.filter(F.array(*pairs), lambda x: x["v"].isNotNull())
    values = F.map_from_entries(F.transform(known, lambda x: F.struct(x["k"], x["v"])))
    sources = F.map_from_entries(F.transform(known, lambda x: F.struct(x["k"], x["s"])))
    missing = F.transform(F.filter(F.array(*pairs), lambda x: x["v"].isNull()), lambda x: x["k"])
    return values, sources, missing


def pruned_json(groups: dict[str, dict[str, Column]]) -> Column:
    """Nested JSON without null leaves and without groups that have none."""
    parts = []
    for name, leaves in groups.items():
        any_ = F.lit(False)
        for c in leaves.values():
            any_ = any_ | c.isNotNull()
        parts.append(F.when(any_, F.struct(*(c.alias(k) for k, c in leaves.items()))).alias(name))
    return F.to_json(F.struct(*parts))


def containing_candidate(events: DataFrame, candidates: DataFrame, key: str, bucket: float) -> DataFrame:
    """(id, cand) of events (key, id, t_start, t_end) that lie inside exactly one candidate (key, cand, b_start, b_end)."""
    from drivespan.operators.joins import points_in

    met = points_in(events.select(key, "id", "t_start", "t_end"), candidates, key, "t_start", bucket).filter(F.col("t_end") <= F.col("b_end"))
    return met.groupBy("id").agg(F.count("*").alias("n"), F.min("cand").alias("cand")).filter("n = 1").select("id", "cand")


def merge_by_priority(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, conflict): the value of the first table that has the key, and whether a later one disagrees."""
    ranked = None
    for i, t in enumerate(tables):
        own = t.select(key, F.col(value).alias("v"), F.lit(i).alias("p"))
        ranked = own if ranked is None else ranked.unionByName(own)
    return ranked.groupBy(key).agg(F.min_by("v", "p").alias(value), (F.count_distinct("v") > 1).alias("conflict"))


def validation_errors(checks: list[tuple[str, Column, str]]) -> Column:
    """An array of (path, message) of the checks that a record fails; a null check fails."""
    rows = [F.when(~F.coalesce(c, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, c, m in checks]
    return F.array_compact(F.array(*rows))


def missing_report(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys with n, n_ids and the share of nulls of each field."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), *(F.avg(F.col(f).isNull().cast("double")).alias(f"missing_{f}") for f in fields))


def video_frame(t: Column, fps: float, n_frames: int) -> Column:
    """The frame shown at a time, null outside the clip."""
    f = F.floor(t * fps + 1e-9)
    return F.when((f >= 0) & (f < n_frames), f)
