"""Per-drive checks and event physics: clock offsets, dominant bands, coherence, calibration, digests and records."""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column, DataFrame, functions as F

from drivespan.operators import timegrid as tg
from drivespan.operators.joins import points_in


def iso_weight_taps(rate_hz: float, half: int) -> list[float]:
    """Symmetric taps with the gain of the vertical whole-body weighting of ISO 2631-1 (band limits, transition and upward step), by frequency sampling."""

    def gain(f: float) -> float:
        if f == 0:
            return 0.0
        s = 2j * math.pi * f
        w = lambda x: 2 * math.pi * x
        high = s * s / (s * s + math.sqrt(2) * w(0.4) * s + w(0.4) ** 2)
        low = w(100.0) ** 2 / (s * s + math.sqrt(2) * w(100.0) * s + w(100.0) ** 2)
        transition = (1 + s / w(12.5)) / (1 + s / (0.63 * w(12.5)) + (s / w(12.5)) ** 2)
        step = (1 + s / (0.91 * w(2.37)) + (s / w(2.37)) ** 2) / (1 + s / (0.91 * w(3.35)) + (s / w(3.35)) ** 2) * (2.37 / 3.35) ** 2
        return abs(high * low * transition * step)

    n = 2 * half + 1
    grid = [gain(k * rate_hz / n) for k in range(half + 1)]
    return [(grid[0] + 2 * sum(grid[k] * cmath.cos(2 * math.pi * k * m / n).real for k in range(1, half + 1))) / n for m in range(-half, half + 1)]


def drive_lags(df: DataFrame, x: str, y: str, drive: str, order: str, lags: list[int]) -> DataFrame:
    """(drive, lag, r): for each drive the shift of y, in rows, that agrees best with x; the smaller shift of equals."""
    m = tg.lag_correlations(df, x, y, drive, order, lags).withColumn("r", tg.correlation())
    return m.groupBy(drive).agg(F.max_by("lag", F.struct("r", -F.abs("lag"), "lag")).alias("lag"), F.max("r").alias("r"))


def synchronised(df: DataFrame, moved: DataFrame, lags: DataFrame, drive: str, tick: str) -> DataFrame:
    """df joined with another clock's rows moved by the drive's lag."""
    other = moved.join(lags.select(drive, "lag"), drive).withColumn(tick, F.col(tick) - F.col("lag")).drop("lag")
    return df.join(other, [drive, tick])


def dominant_band(rows: DataFrame, keys: list[str], t: str, x: str, bands: list[float]) -> DataFrame:
    """keys with the frequency of greatest power among fixed ones, from sine and cosine sums; the lowest of equals."""
    cell = lambda f: F.sum(F.col(x) * F.cos(2 * math.pi * f * F.col(t))) ** 2 + F.sum(F.col(x) * F.sin(2 * math.pi * f * F.col(t))) ** 2
    g = rows.groupBy(*keys).agg(*(cell(f).alias(f"p{i}") for i, f in enumerate(bands)))
    best = F.array_max(F.array(*(F.struct(F.round(F.col(f"p{i}"), 6).alias("p"), F.lit(-f).alias("f")) for i, f in enumerate(bands))))
    return g.select(*keys, (-best["f"]).alias("hz"), best["p"].alias("power"))


def rebounds(l: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the number of lobes, the largest by area, and how many follow it with alternating sign and falling size."""
    g = l.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t_start", "area"))).alias("a"))
    top = F.array_max(F.transform("a", lambda s: F.struct(F.abs(s["area"]).alias("m"), (-s["t_start"]).alias("t"), s["area"].alias("area"))))
    rest = F.filter("a", lambda s: s["t_start"] > -top["t"])
    start = F.struct(F.lit(0).alias("n"), top["area"].alias("last"), F.lit(True).alias("on"))
    step = lambda acc, s: F.when(acc["on"] & (F.signum(s["area"]) != F.signum(acc["last"])) & (F.abs(s["area"]) < F.abs(acc["last"])), F.struct((acc["n"] + 1).alias("n"), s["area"].alias("last"), F.lit(True).alias("on"))).otherwise(F.struct(acc["n"].alias("n"), acc["last"].alias("last"), F.lit(False).alias("on")))
    return g.select(*keys, F.size("a").alias("lobes"), top["area"].alias("largest"), F.aggregate(rest, start, step)["n"].alias("rebounds"))


def coherence(df: DataFrame, block: str, order: str, x: str, y: str, taps: list[float]) -> DataFrame:
    """(block, var_x, var_y, coherence): variances of two band-passed signals and the square of their correlation."""
    b = df.withColumns({"__x": tg.fir(F.col(x), block, order, taps), "__y": tg.fir(F.col(y), block, order, taps)})
    return b.groupBy(block).agg(F.var_pop("__x").alias("var_x"), F.var_pop("__y").alias("var_y"), (F.corr("__x", "__y") ** 2).alias("coherence"))


def offset_calibration(df: DataFrame, drive: str, x: str, heading: str) -> DataFrame:
    """(drive, n, offset, amplitude): the median of x, and the amplitude of its first harmonic over heading, which a pure offset does not have."""
    med = df.groupBy(drive).agg(F.percentile(x, 0.5).alias("offset"))
    r = df.join(med, drive).withColumns({"c": F.cos(F.radians(heading)), "s": F.sin(F.radians(heading)), "e": F.col(x) - F.col("offset")})
    g = r.groupBy(drive, "offset").agg(F.count("e").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in (("c", "c"), ("c", "s"), ("s", "s"), ("c", "e"), ("s", "e"))))
    det = F.nullif(F.col("cc") * F.col("ss") - F.col("cs") ** 2, F.lit(0.0))
    a, b = (F.col("ce") * F.col("ss") - F.col("se") * F.col("cs")) / det, (F.col("se") * F.col("cc") - F.col("ce") * F.col("cs")) / det
    return g.select(drive, "n", "offset", F.sqrt(a * a + b * b).alias("amplitude"))


def event_physics(events: DataFrame, rows: DataFrame, key: str, t: str, baseline: float, columns: list[str], bucket: float) -> DataFrame:
    """(id, column, during, before, change): means within each event and in the stretch of `baseline` seconds before it."""
    spans = events.select(key, "id", "t_start", "t_end", (F.col("t_start") - baseline).alias("b_start"), F.col("t_end").alias("b_end"))
    m = points_in(rows.select(key, t, *columns), spans, key, t, bucket)
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = m.select("id", (F.col(t) >= F.col("t_start")).alias("__in"), F.expr(f"stack({len(columns)}, {parts}) as (column, x)"))
    g = long.groupBy("id", "column").agg(F.avg(F.when(F.col("__in"), F.col("x"))).alias("during"), F.avg(F.when(~F.col("__in"), F.col("x"))).alias("before"))
    return g.withColumn("change", F.col("during") - F.col("before"))


def quality_row(df: DataFrame, keys: list[str], t: str, flags: dict[str, Column], values: list[str]) -> DataFrame:
    """One row a key: rows, seconds, the share of each flag, and known share, mean and deviation of each value."""
    aggs = [F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("seconds"), *(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f"share_{n}") for n, c in flags.items())]
    for v in values:
        aggs += [(F.count(v) / F.count("*")).alias(f"known_{v}"), F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}")]
    return df.groupBy(*keys).agg(*aggs)


def frame_for_distance(t: Column, v: Column, ahead: float, behind: float, v_min: float = 1.0) -> Column:
    """When the camera was `ahead` metres before a place that the axle, `behind` metres after it, reaches at t."""
    return F.when(v >= v_min, t - (ahead + behind) / v)


def digest(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(table, key, value): several summaries as one long table."""
    out = None
    for name, df in tables.items():
        own = df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def record(dataset: str, detector: str, columns: dict[str, Column]) -> Column:
    """A canonical event as a nested struct: source, time, detection and attributes; what is not given stays null."""
    get = lambda k, kind="double": columns.get(k, F.lit(None).cast(kind))
    source = F.struct(F.lit(dataset).alias("dataset"), get("drive", "string").alias("drive"), get("segment", "int").alias("segment"))
    time = F.struct(get("t_start").alias("start_sec"), get("t_end").alias("end_sec"), (get("t_end") - get("t_start")).alias("duration_sec"))
    detection = F.struct(F.lit(detector).alias("detector"), get("event_type", "string").alias("event_type"), get("peak").alias("peak"))
    rest = [F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in columns.items() if k not in ("drive", "segment", "t_start", "t_end", "event_type", "peak")]
    attributes = F.map_from_entries(F.filter(F.array(*rest), lambda e: e["v"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
    return F.struct(source.alias("source"), time.alias("time"), detection.alias("detection"), attributes.alias("attributes"))


def retention(df: DataFrame, sets: dict, platform: str, grade: str) -> DataFrame:
    """(platform, grade, n, n_kept, share): rows that the condition of their platform keeps, by platform and grade, with totals where these are null. A condition that is null keeps nothing; platforms without one are left out."""
    kept = F.lit(None).cast("boolean")
    for p, c in sets.items():
        kept = F.when(F.col(platform) == p, F.coalesce(c, F.lit(False))).otherwise(kept)
    rows = df.select(platform, grade, kept.alias("__kept")).filter("__kept is not null")
    return rows.rollup(platform, grade).agg(F.count("*").alias("n"), F.count_if("__kept").alias("n_kept")).withColumn("share", F.col("n_kept") / F.col("n"))
