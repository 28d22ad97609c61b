"""Signal quality: profiles, rates, agreement of pairs, signs, noise fits and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.select(*keys, F.expr(f"stack({len(columns)}, {parts}) as (name, x)"))


def column_profile(df: DataFrame, block: str, order: str, columns: list[str], qs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(name, valid, q.., on_ratio, edges) of columns: share of known values, quantiles, share above 0.5, and rises above 0.5."""
    long = unpivot(df.withColumn("__o", F.col(order)), [block, "__o"], columns)
    up = F.col("x") > 0.5
    w = Window.partitionBy(block, "name").orderBy("__o")
    long = long.withColumn("edge", (up & ~F.coalesce(F.lag("x").over(w) > 0.5, F.lit(True))).cast("int"))
    return long.groupBy("name").agg((F.count("x") / F.count("*")).alias("valid"), *(F.percentile("x", q).alias(f"q{round(100 * q):02d}") for q in qs), F.avg(up.cast("double")).alias("on_ratio"), F.coalesce(F.sum("edge"), F.lit(0)).alias("edges"))


def strided_quantiles(df: DataFrame, x: str, tick: str, stride: int, qs: tuple[float, ...]) -> DataFrame:
    """Quantiles of every stride-th tick's value."""
    return df.filter(F.col(tick) % stride == 0).agg(F.count(x).alias("n"), *(F.percentile(x, q).alias(f"q{round(100 * q):02d}") for q in qs))


def availability(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(c for f in flags for c in (F.max(F.col(f).isNotNull().cast("int")).alias(f"{f}_has"), F.max(f).alias(f"{f}_max"))))


def channel_rates(series: DataFrame, key: str, channel: str, t: str, v: str) -> DataFrame:
    """(channel, rate, low, high): the median over keys of samples per second, and the range."""
    per = series.groupBy(key, channel).agg(((F.count("*") - 1) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("rate"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return per.groupBy(channel).agg(F.percentile("rate", 0.5).alias("rate"), F.min("lo").alias("low"), F.max("hi").alias("high"))


def agreement(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys with n, r, slope, rmse and max_abs of y against x over rows where both are known."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.sqrt(F.avg((F.col(y) - F.col(x)) ** 2)).alias("rmse"), F.max(F.abs(F.col(y) - F.col(x))).alias("max_abs"))


def sign_verdict(r: Column, n: Column, least_n: int = 30, least_r: float = 0.3) -> Column:
    return F.when(n < least_n, "unknown").when(r >= least_r, "same").when(r <= -least_r, "opposite").otherwise("unclear")


def range_rate_check(tracks: DataFrame, block: str, t: str) -> DataFrame:
    """(block, episode, n, slope, vrel): the slope of distance over time of each track's episode, which new_track begins, beside its mean relative speed."""
    w = Window.partitionBy(block).orderBy(t)
    return tracks.withColumn("episode", F.sum(F.col("new_track").cast("int")).over(w)).groupBy(block, "episode").agg(F.count("*").alias("n"), F.regr_slope("distance", t).alias("slope"), F.avg("rel_speed").alias("vrel"))


def jitter(series: DataFrame, key: str, t: str) -> DataFrame:
    step = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    return series.withColumn("__d", step).groupBy(key).agg(F.min("__d").alias("least"), F.percentile("__d", 0.5).alias("median"), F.max("__d").alias("most"))


def sign_decision(pairs: DataFrame, vehicle: str, least_n: int = 20, clear: float = 0.5) -> DataFrame:
    """(vehicle, r, n, sign): two stages per vehicle; its own pairs decide if they are enough and clear, else all vehicles' together."""
    own = pairs.groupBy(vehicle).agg(F.corr("reference", "sensor").alias("r"), F.count("*").alias("n"))
    pooled = pairs.agg(F.corr("reference", "sensor").alias("all_r"))
    first = (F.col("n") >= least_n) & (F.abs("r") >= clear)
    sign = F.when(first, F.signum("r")).when(F.abs("all_r") >= clear, F.signum("all_r")).otherwise(0.0)
    return own.join(F.broadcast(pooled), F.lit(True)).select(vehicle, "r", "n", F.coalesce(sign, F.lit(0.0)).cast("int").alias("sign"))


def robust_sigma(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys with n, median and sigma = 1.4826 * median |x - median|."""
    med = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("median"))
    return df.join(med, keys).groupBy(*keys, "median").agg(F.count(x).alias("n"), (1.4826 * F.percentile(F.abs(F.col(x) - F.col("median")), 0.5)).alias("sigma"))


def noise_fit(sigmas: DataFrame, v: str, sigma: str, n: str) -> DataFrame:
    """(a, b): sigma^2 = a^2 + b^2 / v^2 by weighted least squares, neither part below zero."""
    x, y, w = 1.0 / (F.col(v) * F.col(v)), F.col(sigma) ** 2, F.col(n)
    s = sigmas.agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"))
    b = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.col("w") * F.col("xx") - F.col("x") ** 2, F.lit(0.0))
    s = s.withColumn("b2", F.greatest(b, F.lit(0.0))).withColumn("a2", F.greatest((F.col("y") - F.col("b2") * F.col("x")) / F.col("w"), F.lit(0.0)))
    return s.select(F.sqrt("a2").alias("a"), F.sqrt("b2").alias("b"))


def trimmed_fit(df: DataFrame, key: str, x: str, y: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(key, slope, n) through the origin, rows outside the quantiles of y left out."""
    q = df.groupBy(key).agg(F.percentile(y, low).alias("lo"), F.percentile(y, high).alias("hi"))
    kept = df.join(q, key).filter(F.col(y).between(F.col("lo"), F.col("hi")))
    return kept.groupBy(key).agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) ** 2), F.lit(0.0))).alias("slope"), F.count("*").alias("n"))


def threshold_margins(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(rule, reached, threshold, margin) of the immediate rules whose feature is there: the column's extreme in the rule's direction; a positive margin fires."""
    live = {n: r for n, r in rules.items() if r["op"] in ("lt", "gt", "abs_gt") and r["feature"] in df.columns}
    far = {"lt": F.min, "gt": F.max, "abs_gt": lambda c: F.max(F.abs(c))}
    got = df.agg(*(far[r["op"]](r["feature"]).alias(n) for n, r in live.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("reached"), F.lit(float(r["threshold"])).alias("threshold"), ((F.lit(float(r["threshold"])) - F.col(n)) if r["op"] == "lt" else (F.col(n) - F.lit(float(r["threshold"])))).alias("margin")) for n, r in live.items()))
    return got.select(F.inline(rows))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, total, mixed): a digest of the rows that doesn't depend on their order, from 52 bits of the MD5 of each row's columns as text, by name."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(df.columns)))
    h = df.select(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").alias("h"))
    return h.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def references(events: DataFrame, listing: DataFrame, uri: str) -> DataFrame:
    """(state, n): how many events' references are in the listing, missing from it, or null."""
    met = events.select(F.col(uri).alias("u")).join(listing.select(F.col(uri).alias("u"), F.lit(True).alias("hit")).distinct(), "u", "left")
    return met.groupBy(F.when(F.col("u").isNull(), "none").when(F.col("hit"), "found").otherwise("missing").alias("state")).agg(F.count("*").alias("n"))
