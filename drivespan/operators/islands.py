"""Runs of rows and the intervals that they span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def runs(df: DataFrame, mask: Column, block: str, t: str, step: float, merge_gap: float = 0.0) -> DataFrame:
    """The rows where mask holds, with `run`: rows of a block share a run while the next begins at most step + merge_gap later.

    A null mask does not hold. step is the spacing of neighbouring rows; gaps are measured from the end of one run of
    rows to the start of the next.
    """
    w = Window.partitionBy(block).orderBy(t)
    own = df.filter(F.coalesce(mask, F.lit(False)))
    far = F.col(t) - F.lag(t).over(w) > max(merge_gap, step * 1.5)
    return own.withColumn("__new", F.when(far, 1).otherwise(0)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def intervals(df: DataFrame, mask: Column, block: str, t: str, step: float, merge_gap: float = 0.0, min_duration: float = 0.0, *aggs: Column) -> DataFrame:
    """(block, run, t_start, t_end, n, ...): the runs' spans; runs shorter than min_duration are left out after merging. One row lasts 0."""
    out = runs(df, mask, block, t, step, merge_gap).groupBy(block, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"), *aggs)
    return out.filter(F.col("t_end") - F.col("t_start") >= min_duration)


def merge_intervals(spans: DataFrame, key: str, start: str, end: str, gap: float = 0.0) -> DataFrame:
    """spans with `group`: intervals of a key share one while each starts at most gap after the latest end so far."""
    w = Window.partitionBy(key).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__new", F.when(F.col(start) - latest <= gap, 0).otherwise(1)).withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def union_seconds(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, seconds): the length of the union of each key's intervals."""
    m = merge_intervals(spans, key, start, end).groupBy(key, "group").agg((F.max(end) - F.min(start)).alias("s"))
    return m.groupBy(key).agg(F.sum("s").alias("seconds"))


def longest_run(df: DataFrame, key: str, index: str) -> DataFrame:
    """(key, first, last, n): the longest stretch of consecutive indices, the earliest of equals."""
    w = Window.partitionBy(key).orderBy(index)
    g = df.select(key, index).distinct().withColumn("g", F.col(index) - F.row_number().over(w)).groupBy(key, "g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))
    return g.groupBy(key).agg(F.max_by(F.struct("first", "last", "n"), F.struct(F.col("n"), -F.col("first"))).alias("x")).select(key, "x.*")


def spaced_peaks(df: DataFrame, block: str, t: str, score: str, spacing: float) -> DataFrame:
    """Rows kept by taking the strongest first and dropping whatever lies within spacing of one kept; ties go to the earlier.

    Peaks are few in a block, so each block's are folded in order of strength; blocks are cut where
    neighbours are more than spacing apart, which changes nothing and keeps each fold short.
    """
    w = Window.partitionBy(block).orderBy(t)
    cut = df.withColumn("__new", F.when(F.col(t) - F.lag(t).over(w) > spacing, 1).otherwise(0)).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    folded = cut.groupBy(block, "__part").agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(t).alias("t")))).alias("p"))
    kept = F.aggregate("p", F.lit(None).cast("array<double>"), lambda acc, x: F.when(F.exists(F.coalesce(acc, F.array().cast("array<double>")), lambda y: F.abs(y - x["t"]) <= spacing), acc).otherwise(F.concat(F.coalesce(acc, F.array().cast("array<double>")), F.array(x["t"].cast("double")))))
    return cut.join(folded.select(block, "__part", F.explode(kept).alias("__t")), [block, "__part"]).filter(F.col(t) == F.col("__t")).drop("__new", "__part", "__t")


def lobes(df: DataFrame, x: str, block: str, t: str, enter: float, merge_gap: float) -> DataFrame:
    """(block, lobe, sign, t_start, t_end, area): stretches that stay beyond +-enter on one side; short lapses up to merge_gap between two of one sign are bridged.

    area is the trapezoid sum of x over the whole stretch, lapses included, nulls as zero.
    """
    w = Window.partitionBy(block).orderBy(t)
    rows = df.select(block, t, F.coalesce(F.col(x), F.lit(0.0)).alias("__x"), F.when(F.abs(F.col(x)) > enter, F.signum(x)).alias("sign"))
    step = (F.col("__x") + F.lag("__x").over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    rows = rows.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("__cum", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__row", F.row_number().over(w))
    big = rows.filter("sign is not null")
    # a lapse is bridged if every row in it is within merge_gap of the last row before it
    lapse = F.when(F.col("__row") - F.lag("__row").over(w) > 1, F.col("__before") - F.lag(t).over(w)).otherwise(0.0)
    big = rows.withColumn("__before", F.lag(t).over(w)).filter("sign is not null")
    new = F.when((F.lag("sign").over(w) == F.col("sign")) & (lapse <= merge_gap), 0).otherwise(1)
    big = big.withColumn("__new", new).withColumn("lobe", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return big.groupBy(block, "lobe").agg(F.first("sign").alias("sign"), F.min(t).alias("t_start"), F.max(t).alias("t_end"), (F.max_by("__cum", t) - F.min_by("__cum", t)).alias("area"))
