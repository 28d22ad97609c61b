"""Alignment of irregular series on a uniform grid, and rolling operators on that grid.

Every operator takes the column that names a block (a stretch without gaps of one drive) and orders by a
tick or a time inside it, so that a chain of them needs one shuffle by block. Missing values are null and stay null;
a predicate on null never holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def clean(c: Column) -> Column:
    """c with NaN as null. Spark orders NaN above every number, so it must go where data come in."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def window_samples(seconds: float, rate_hz: float) -> int:
    """Samples of a window: rounded half to even, at least one, and made odd."""
    n = max(1, round(seconds * rate_hz))
    return n + 1 - n % 2


def by(block: str, order: str) -> WindowSpec:
    return Window.partitionBy(block).orderBy(order)


def common_span(series: DataFrame, block: str, channel: str, t: str, primary: list[str] | None = None) -> DataFrame:
    """(block, t0, t1): from the latest first time to the earliest last time over the primary channels, or over all where a block has none of them."""
    per = series.groupBy(block, channel).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    if primary:
        named = F.col(channel).isin(primary)
        return per.groupBy(block).agg(
            F.coalesce(F.max(F.when(named, F.col("a"))), F.max("a")).alias("t0"), F.coalesce(F.min(F.when(named, F.col("b"))), F.min("b")).alias("t1")
        )
    return per.groupBy(block).agg(F.max("a").alias("t0"), F.min("b").alias("t1"))


def grid(spans: DataFrame, step: float, edge_trim: float = 0.0) -> DataFrame:
    """A row for each whole multiple `tick` of step inside the span, edge_trim taken off either end; t = tick * step."""
    first, last = F.ceil((F.col("t0") + edge_trim) / step), F.floor((F.col("t1") - edge_trim) / step)
    rest = [c for c in spans.columns if c not in ("t0", "t1")]
    return spans.filter(first <= last).select(*rest, F.explode(F.sequence(first, last)).alias("tick")).withColumn("t", F.col("tick") * F.lit(step))


def _beside(ticks: DataFrame, samples: DataFrame, block: str, t: str, v: str) -> tuple[DataFrame, WindowSpec]:
    """Ticks and samples of a block in one order of time, samples before ticks of the same time."""
    a = ticks.select(block, F.col("tick"), F.col("t").alias("__t"), F.lit(1).alias("__is"), F.lit(None).cast("struct<t:double,v:double>").alias("__s"))
    b = samples.filter(F.col(t).isNotNull() & clean(F.col(v)).isNotNull()).select(
        block, F.lit(None).cast("long").alias("tick"), F.col(t).cast("double").alias("__t"), F.lit(0).alias("__is"), F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")).alias("__s")
    )
    return a.unionByName(b), Window.partitionBy(block).orderBy("__t", "__is")


def resample_linear(ticks: DataFrame, samples: DataFrame, block: str, t: str, v: str, max_gap: float) -> DataFrame:
    """(block, tick, t, value): linear between the samples on either side; null outside the data and where these are more than max_gap apart."""
    both, w = _beside(ticks, samples, block, t, v)
    before = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.select(block, "tick", F.col("__t").alias("t"), "__is", before.alias("a"), after.alias("b")).filter("__is = 1")
    on = F.when(F.col("a.t") == F.col("t"), F.col("a.v"))
    between = F.when(F.col("b.t") - F.col("a.t") <= max_gap, F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return got.select(block, "tick", "t", F.coalesce(on, between).alias("value"))


def resample_hold(ticks: DataFrame, samples: DataFrame, block: str, t: str, v: str, max_age: float) -> DataFrame:
    """(block, tick, t, value): the latest sample at or before the tick, if it is not older than max_age."""
    both, w = _beside(ticks, samples, block, t, v)
    before = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = both.select(block, "tick", F.col("__t").alias("t"), "__is", before.alias("a")).filter("__is = 1")
    return got.select(block, "tick", "t", F.when(F.col("t") - F.col("a.t") <= max_age, F.col("a.v")).alias("value"))


def occupancy(ticks: DataFrame, samples: DataFrame, block: str, t: str, step: float) -> DataFrame:
    """(block, tick, t, value): 1.0 where at least one sample lies in [tick, tick + 1) * step, else 0.0."""
    hit = samples.filter(F.col(t).isNotNull()).select(block, F.floor(F.col(t) / step).alias("tick")).distinct().withColumn("value", F.lit(1.0))
    return ticks.join(hit, [block, "tick"], "left").select(block, "tick", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def to_wide(long: DataFrame, block: str, channel: str, value: str, channels: list[str]) -> DataFrame:
    """One row a (block, tick, t) and one column a channel; several values of a cell are averaged."""
    return long.groupBy(block, "tick", "t").pivot(channel, channels).agg(F.avg(value))


def coverage(wide: DataFrame, block: str, channels: list[str]) -> DataFrame:
    """(block, channel, coverage): the share of ticks with a value."""
    parts = ", ".join(f"'{c}', `{c}`" for c in channels)
    return wide.select(block, F.expr(f"stack({len(channels)}, {parts}) as (channel, x)")).groupBy(block, "channel").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"))


def moving_average(x: Column, block: str, order: str, window: int) -> Column:
    """Centred average of the values present; null in the block's first and last half window. An even window is made odd."""
    half = (window + 1 - window % 2) // 2
    w = by(block, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(block))
    inside = (F.row_number().over(w) > half) & (F.row_number().over(w) <= n - half)
    return F.when(inside, F.avg(x).over(w.rowsBetween(-half, half)))


def rolling(x: Column, block: str, order: str, window: int, how: str) -> Column:
    """Centred min, max, mean, median or absmax with at least max(2, half) values present. A median is null in half a window at the block's ends."""
    if window <= 1:
        return F.abs(x) if how == "absmax" else x
    window += 1 - window % 2
    half = window // 2
    w = by(block, order).rowsBetween(-half, half)
    agg = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "median": F.percentile(x, 0.5), "absmax": F.max(F.abs(x))}[how]
    out = F.when(F.count(x).over(w) >= max(2, window // 2), agg.over(w))
    if how == "median":
        row, n = F.row_number().over(by(block, order)), F.count(F.lit(1)).over(Window.partitionBy(block))
        out = F.when((row > half) & (row <= n - half), out)
    return out


def derivative(x: Column, block: str, order: str, dt: float) -> Column:
    """Central difference; null at the ends and beside nulls."""
    w = by(block, order)
    return (F.lead(x).over(w) - F.lag(x).over(w)) / (2 * dt)


def count_reversals(df: DataFrame, x: Column, block: str, t: str, amplitude: float, window_s: float, out: str = "reversals") -> DataFrame:
    """df with the number of changes between above +amplitude and below -amplitude in the window_s seconds up to each row."""
    w = by(block, t)
    sign = F.when(F.abs(x) > amplitude, F.signum(x))
    before = F.last(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.when(sign.isNotNull() & (before != sign), 1).otherwise(0)
    marked = df.withColumn("__changed", changed)
    total = F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__total", total)
    # changes in (t - window_s, t]: those up to t less those up to t - window_s
    micros = F.round(F.col(t) * 1e6).cast("long")
    old = F.max("__total").over(Window.partitionBy(block).orderBy(micros).rangeBetween(Window.unboundedPreceding, -round(window_s * 1e6)))
    return marked.withColumn(out, (F.col("__total") - F.coalesce(old, F.lit(0))).cast("double")).drop("__changed", "__total")


def hold_forward(x: Column, block: str, order: str, most: int) -> Column:
    """The last value present within the last `most` rows."""
    return F.last(x, ignorenulls=True).over(by(block, order).rowsBetween(-most, 0))


def dilate(mask: Column, block: str, order: str, rows: int) -> Column:
    """True within `rows` rows of a true row."""
    return F.coalesce(F.bool_or(mask).over(by(block, order).rowsBetween(-rows, rows)), F.lit(False))


def net_heading(yaw_dps: Column, block: str, order: str, dt: float, half: int) -> Column:
    """Heading change over +-half rows: the sum of yaw * dt, nulls as zero, cut at the block's ends; null where yaw is."""
    w = by(block, order)
    total = F.sum(F.coalesce(yaw_dps, F.lit(0.0)) * dt).over(w.rowsBetween(-half + 1, half))
    return F.when(yaw_dps.isNotNull(), total)


def first_order_lag(x: Column, block: str, order: str, tau_rows: float, taps: int) -> Column:
    """A first-order lag of time constant tau_rows, as a weighted sum over the last `taps` rows; null until that many rows are there."""
    raw = [math.exp(-k / tau_rows) for k in range(taps)]
    w = by(block, order)
    out = F.lit(0.0)
    for k, a in enumerate(raw):
        out = out + F.lit(a / sum(raw)) * (F.lag(x, k).over(w) if k else x)
    return out


def fir(x: Column, block: str, order: str, taps: list[float]) -> Column:
    """A centred filter with the given symmetric taps (an odd number of them); null in half a window at the block's ends and near nulls."""
    half, w = len(taps) // 2, by(block, order)
    out = F.lit(0.0)
    for k, a in enumerate(taps):
        n = k - half
        out = out + F.lit(a) * (F.lag(x, -n).over(w) if n < 0 else F.lead(x, n).over(w) if n else x)
    return out


def lowpass_taps(cut_hz: float, rate_hz: float, half: int) -> list[float]:
    """A windowed-sinc low pass of 2 * half + 1 taps that sum to one."""
    f = cut_hz / rate_hz
    raw = [(2 * f if n == 0 else math.sin(2 * math.pi * f * n) / (math.pi * n)) * (0.54 + 0.46 * math.cos(math.pi * n / half)) for n in range(-half, half + 1)]
    return [a / sum(raw) for a in raw]


def bandpass_taps(low_hz: float, high_hz: float, rate_hz: float, half: int) -> list[float]:
    """The difference of two low passes."""
    return [a - b for a, b in zip(lowpass_taps(high_hz, rate_hz, half), lowpass_taps(low_hz, rate_hz, half), strict=True)]


def moving_rms(x: Column, block: str, order: str, window: int) -> Column:
    half = window // 2
    return F.sqrt(F.avg(x * x).over(by(block, order).rowsBetween(-half, half)))


def lag_correlations(df: DataFrame, x: str, y: str, block: str, order: str, lags: list[int]) -> DataFrame:
    """(block, lag, n, sx, sy, sxx, syy, sxy): moment sums of x and y shifted by each lag in rows. Sums of blocks add up, so leaving one out is a subtraction."""
    w = by(block, order)
    p = df.select(block, *(F.struct(F.lit(k).alias("lag"), F.col(x).alias("x"), (F.lead(y, k).over(w) if k > 0 else F.lag(y, -k).over(w) if k else F.col(y)).alias("y")).alias(f"p{i}") for i, k in enumerate(lags)))
    p = p.select(block, F.inline(F.array(*(F.col(f"p{i}") for i in range(len(lags)))))).filter("x is not null and y is not null")
    return p.groupBy(block, "lag").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))


def correlation(n: str = "n", sx: str = "sx", sy: str = "sy", sxx: str = "sxx", syy: str = "syy", sxy: str = "sxy") -> Column:
    """Pearson correlation from moment sums."""
    c = F.col
    return (c(n) * c(sxy) - c(sx) * c(sy)) / F.sqrt((c(n) * c(sxx) - c(sx) * c(sx)) * (c(n) * c(syy) - c(sy) * c(sy)))


def lag_search(moments: DataFrame, block: str) -> DataFrame:
    """(lag, r, peak, se): the lag of greatest pooled correlation, its parabolic peak, and the block jackknife's standard error of the correlation there."""
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    pooled = moments.groupBy("lag").agg(*(F.sum(c).alias(c) for c in names)).withColumn("r", correlation())
    w = Window.orderBy("lag")
    near = pooled.select("lag", "r", F.lag("r").over(w).alias("a"), F.lead("r").over(w).alias("b"))
    best = near.orderBy(F.desc("r"), "lag").limit(1)
    bend = F.col("a") - 2 * F.col("r") + F.col("b")
    best = best.select("lag", "r", (F.col("lag") + F.coalesce(F.when(bend != 0, 0.5 * (F.col("a") - F.col("b")) / bend), F.lit(0.0))).alias("peak"))
    left = moments.join(pooled.select("lag", *(F.col(c).alias(f"all_{c}") for c in names)), "lag").select(block, "lag", *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in names)).withColumn("r_out", correlation())
    se = left.groupBy("lag").agg((F.sqrt(F.var_pop("r_out") * (F.count("*") - 1))).alias("se"))
    return best.join(se, "lag")


def detrend(x: Column, block: str, order: str, window: int) -> tuple[Column, Column]:
    """(fast, slow): slow is the centred mean, fast the rest."""
    half = window // 2
    slow = F.avg(x).over(by(block, order).rowsBetween(-half, half))
    return x - slow, slow


def quiet_prior(rate: Column, block: str, order: str, rows: int, limit: float) -> Column:
    """True where the largest |rate| of the last `rows` rows and this one is below the limit."""
    return F.max(F.abs(rate)).over(by(block, order).rowsBetween(-rows, 0)) < limit


def quadratic_deviation(y: Column, block: str, order: str, half: int, dt: float) -> Column:
    """y minus the least-squares parabola through the 2 * half + 1 rows around it, from framed moment sums; null at the ends."""
    w = by(block, order)
    frame = w.rowsBetween(-half, half)
    n = 2 * half + 1
    s2 = sum((k * dt) ** 2 for k in range(-half, half + 1))
    s4 = sum((k * dt) ** 4 for k in range(-half, half + 1))
    i = F.row_number().over(w) * dt
    sy, siy, siiy = F.sum(y).over(frame), F.sum(y * i).over(frame), F.sum(y * i * i).over(frame)
    y2 = siiy - 2 * i * siy + i * i * sy
    at_zero = (s4 * sy - s2 * y2) / (n * s4 - s2 * s2)
    return F.when(F.count(y).over(frame) == n, y - at_zero)


def blocks(df: DataFrame, drive: str, index: str) -> DataFrame:
    """df with `block`: the number of the stretch of consecutive indices of a drive that a row belongs to, from 0."""
    w = Window.partitionBy(drive).orderBy(index)
    new = F.when(F.col(index) - F.lag(index).over(w) <= 1, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("block", (F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("__new")


def gap_blocks(df: DataFrame, drive: str, t: str, limit: float) -> DataFrame:
    """df without repeated times of a drive, and `block`, which goes up where the step from the last time exceeds the limit."""
    w = Window.partitionBy(drive).orderBy(t)
    one = df.dropDuplicates([drive, t])
    return one.withColumn("__new", F.when(F.col(t) - F.lag(t).over(w) > limit, 1).otherwise(0)).withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
