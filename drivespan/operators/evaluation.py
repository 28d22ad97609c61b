"""How filters and rules do against labels: interval labels, margins, retention, contributions, thresholds, intervals of confidence."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.operators.joins import overlap_join


def label_intervals(df: DataFrame, labels: DataFrame, key: str, bucket: float) -> DataFrame:
    """df (key, id, a_start, a_end) with risky: true or false by the overlapping labels (key, b_start, b_end, risky), null without any. Any true wins."""
    met = overlap_join(df, labels, key, bucket).groupBy("id").agg(F.bool_or("risky").alias("risky"))
    return df.join(met, "id", "left")


def touched_windows(df: DataFrame, width: float) -> DataFrame:
    """df (a_start, a_end) with a row for each window number that it touches."""
    return df.withColumn("win", F.explode(F.sequence(F.floor(F.col("a_start") / width), F.floor(F.col("a_end") / width))))


def retention(events: DataFrame, windows: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(id, any_kept, all_kept): by the windows (keys, win, keep) that an event touches; null where none is known."""
    met = touched_windows(events, width).join(windows.select(*keys, "win", "keep"), [*keys, "win"], "left")
    return met.groupBy("id").agg(F.bool_or("keep").alias("any_kept"), F.bool_and(F.coalesce("keep", F.lit(False))).alias("all_kept"))


def quiet_rejects(parts: list[Column]) -> Column:
    """True where every known part is quiet and at least one is known: an unknown part is never quiet evidence, and nothing known rejects nothing."""
    known = F.lit(False)
    quiet = F.lit(True)
    for p in parts:
        known = known | p.isNotNull()
        quiet = quiet & F.coalesce(p, F.lit(True))
    return known & quiet


def branch_contributions(df: DataFrame, branches: dict[str, Column]) -> DataFrame:
    """(branch, single, marginal, leave_one_out): pass rates of each branch alone, of what only it passes, and of all others together. Rows become codes first; rates come from the counts of codes."""
    names = list(branches)
    code = sum((F.coalesce(branches[n], F.lit(False)).cast("long") * F.lit(1 << i) for i, n in enumerate(names)), F.lit(0).cast("long"))
    counts = df.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(n).alias("branch"), (F.col("code").bitwiseAND(F.lit(1 << i)) != 0).alias("has"), (F.col("code") == F.lit(1 << i)).alias("only"), (F.col("code").bitwiseAND(F.lit((1 << len(names)) - 1 - (1 << i))) != 0).alias("others")) for i, n in enumerate(names)))
    share = lambda c: F.sum(F.col(c).cast("long") * F.col("n")) / F.sum("n")
    return counts.select("n", "code", F.inline(rows)).groupBy("branch").agg(share("has").alias("single"), share("only").alias("marginal"), share("others").alias("leave_one_out"))


def thresholds_at(df: DataFrame, x: str, rates: list[float]) -> DataFrame:
    """(rate, threshold): the value that the given share of rows reaches or exceeds."""
    got = df.agg(F.percentile(x, F.array(*(F.lit(1 - r) for r in rates))).alias("q"))
    return got.select(F.posexplode("q").alias("i", "threshold")).select(F.element_at(F.array(*(F.lit(r) for r in rates)), F.col("i") + 1).alias("rate"), "threshold")


def condition_grid(df: DataFrame, features: dict[str, list[float]], positive: Column) -> DataFrame:
    """(feature thresholds ..., n, hits): every combination of one threshold a feature, each feature >= its threshold. The grid is a small broadcast table."""
    names = list(features)
    table = df.sparkSession.createDataFrame(list(itertools.product(*features.values())), ", ".join(f"th_{n} double" for n in names))
    # rows are first reduced to how many thresholds of each feature they reach
    level = {n: sum(((F.col(n) >= F.lit(t)).cast("int") for t in sorted(features[n])), F.lit(0)) for n in names}
    counts = df.select(*(F.coalesce(level[n], F.lit(0)).alias(f"k_{n}") for n in names), positive.cast("int").alias("y")).groupBy(*(f"k_{n}" for n in names)).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    reach = F.lit(True)
    for n in names:
        rank = sum(((F.col(f"th_{n}") >= F.lit(t)).cast("int") for t in sorted(features[n])), F.lit(0))
        reach = reach & (F.col(f"k_{n}") >= rank)
    return counts.join(F.broadcast(table), reach).groupBy(*(f"th_{n}" for n in names)).agg(F.sum("n").alias("n"), F.sum("y").alias("hits"))


def rejection_breakdown(df: DataFrame, conditions: dict[str, Column], seconds: str) -> DataFrame:
    """(condition, alone_s, sole_s): seconds that each condition would reject alone, and those that only it blocks in the conjunction of all."""
    names = list(conditions)
    held = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    rows = []
    for n in names:
        others = F.lit(True)
        for m in names:
            others = others & held[m] if m != n else others
        rows.append(F.struct(F.lit(n).alias("condition"), held[n].alias("alone"), (others & ~held[n]).alias("sole")))
    sec = lambda c: F.sum(F.when(F.col(c), F.col("s")).otherwise(0.0))
    return df.select(F.col(seconds).alias("s"), F.inline(F.array(*rows))).groupBy("condition").agg(sec("alone").alias("alone_s"), sec("sole").alias("sole_s"))


#: Chances that a Poisson draw of mean 1 is at most 0, 1, 2, ...; beyond the last one it counts as one more.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a draw in [0, 1)."""
    return sum(((u >= p).cast("int") for p in _POISSON), F.lit(0))


def bootstrap(df: DataFrame, cluster: str, x: str, replicates: int, seed: int, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(mean, low, high) of x by resampling whole clusters: in each replicate a cluster counts a Poisson number of times, drawn by hash. Clusters enter as sums, and a replicate is a conditional sum over them."""
    per = df.groupBy(cluster).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    times = per.select("s", "n", cluster, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    means = times.withColumn("w", poisson(draw(seed, F.col("r"), F.col(cluster)))).groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("mean"))
    ends = means.agg(F.percentile("mean", levels[0]).alias("low"), F.percentile("mean", levels[1]).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ends)


def compare_presence(df: DataFrame, present: Column, outcome: Column) -> DataFrame:
    """(a, b, c, d, rate_with, rate_without, p): outcome rates with and without something, and Fisher's exact p."""
    from drivespan.functions.vehicle import fisher_exact

    n = lambda p, o: F.sum((p & o).cast("long"))
    p, o = F.coalesce(present, F.lit(False)), F.coalesce(outcome, F.lit(False))
    t = df.agg(n(p, o).alias("a"), n(p, ~o).alias("b"), n(~p, o).alias("c"), n(~p, ~o).alias("d"))
    rate = lambda x, y: F.try_divide(F.col(x), F.col(x) + F.col(y))
    return t.select("a", "b", "c", "d", rate("a", "b").alias("rate_with"), rate("c", "d").alias("rate_without"), fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p"))
