"""The cheap window filter: tumbling windows of raw channels, each on its own times, and tests on their extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW_S = 2.0
#: Least speed, braking and lateral acceleration of a passing window, and the range of the slip warning.
BASE = {"v_min": 5.0, "ax": -2.5, "ay": 2.0}
SLIP_WARN_RANGE = (3.5, 4.5)


def window_id(t: Column, t0: Column, width: float = WINDOW_S) -> Column:
    """The number of the window that starts at t0 + id * width and holds t."""
    return F.floor((t - t0) / width).cast("long")


def extremes(series: DataFrame, keys: list[str], channels: list[str], width: float = WINDOW_S, t: str = "t", v: str = "v", channel: str = "channel") -> DataFrame:
    """keys, win, and lo_/hi_ of each channel, windows counted from the earliest time of the keys. One shuffle: the first time travels with partial sums.

    Windows without any sample don't appear; rate() counts them by the span.
    """
    first = series.groupBy(*keys).agg(F.min(t).alias("__t0"))
    rows = series.filter(F.col(v).isNotNull()).join(first, keys)
    aggs = [f(F.when(F.col(channel) == c, F.col(v))).alias(f"{p}_{c}") for c in channels for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return rows.withColumn("win", window_id(F.col(t), F.col("__t0"), width)).groupBy(*keys, "win").agg(*aggs)


def absmax(lo: Column, hi: Column) -> Column:
    return F.greatest(F.abs(lo), F.abs(hi))


def flag_on(hi: Column) -> Column:
    return F.coalesce(hi > 0.5, F.lit(False))


def slip_on(hi: Column) -> Column:
    return F.coalesce((hi > SLIP_WARN_RANGE[0]) & (hi <= SLIP_WARN_RANGE[1]), F.lit(False))


def passes(speed_max: Column, ax_min: Column, ay_absmax: Column, flag: Column, cfg: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(by motion alone, by motion or flag). Unknown values never pass; a flag passes whatever the motion."""
    c = cfg or BASE
    known = lambda x: F.coalesce(x, F.lit(False))
    kin = known(speed_max >= c["v_min"]) & (known(ax_min <= c["ax"]) | known(ay_absmax >= c["ay"]))
    return kin, kin | flag


def steady(df: DataFrame, keys: list[str], lo: str, hi: str, windows: int = 5, delta: float = 1.0, out: str = "steady") -> DataFrame:
    """df with a mark where the speed's range over `windows` windows around is below delta; the ends repeat the edge window, and a window without speed marks none around it."""
    w = Window.partitionBy(*keys).orderBy("win").rowsBetween(-(windows // 2), windows - 1 - windows // 2)
    known = F.count(lo).over(w) == F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.coalesce(known & (F.max(hi).over(w) - F.min(lo).over(w) < delta), F.lit(False)))


def multi_length(series: DataFrame, keys: list[str], widths: list[float], channels: list[str], t: str = "t", v: str = "v", channel: str = "channel") -> DataFrame:
    """keys, width, win and min/max/absmax of each channel for several window lengths in one aggregation."""
    first = series.groupBy(*keys).agg(F.min(t).alias("__t0"))
    rows = series.join(first, keys).withColumn("width", F.explode(F.array(*(F.lit(float(x)) for x in widths))))
    one = lambda c: F.when(F.col(channel) == c, F.col(v))
    aggs = [a for c in channels for a in (F.min(one(c)).alias(f"{c}_min"), F.max(one(c)).alias(f"{c}_max"), F.max(F.abs(one(c))).alias(f"{c}_absmax"))]
    return rows.withColumn("win", F.floor((F.col(t) - F.col("__t0")) / F.col("width"))).groupBy(*keys, "width", "win").agg(*aggs)


def preferred(*columns: str) -> Column:
    """The first of several columns of one quantity that has a value."""
    return F.coalesce(*columns)


def keep_margin(df: DataFrame, keys: list[str], keep: Column, k: int, order: str = "win") -> Column:
    """keep, widened by k windows on both sides inside the keys."""
    return F.coalesce(F.max(keep.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-k, k)) == 1, F.lit(False))
