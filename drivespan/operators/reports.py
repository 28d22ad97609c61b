"""Report chains over events and drives: re-measurement, controls, recall, residual tables, run comparison, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.operators.joins import points_in


def remeasure(events: DataFrame, rows: DataFrame, key: str, t: str, pad: float, aggs: dict[str, Column], bucket: float) -> DataFrame:
    """events (key, id, t_start, t_end) with aggregates of the rows within pad of each; events without rows keep nulls."""
    spans = events.select(key, "id", (F.col("t_start") - pad).alias("b_start"), (F.col("t_end") + pad).alias("b_end"))
    got = points_in(rows, spans, key, t, bucket).groupBy("id").agg(*(a.alias(n) for n, a in aggs.items()))
    return events.join(got, "id", "left")


def judged(df: DataFrame, checks: dict[str, Column], tolerate: int = 0) -> DataFrame:
    """df with failed (names of the checks that fail; an unknown one fails) and verdict: plausible, doubtful with up to tolerate failures, else implausible."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    n = F.size(failed)
    return df.withColumn("failed", F.array_join(failed, "|")).withColumn("verdict", F.when(n == 0, "plausible").when(n <= tolerate, "doubtful").otherwise("implausible"))


def value_runs(df: DataFrame, block: str, t: str, x: str) -> DataFrame:
    """(block, value, run, t_start, t_end, n): runs of equal values."""
    w = Window.partitionBy(block).orderBy(t)
    r = df.withColumn("__new", F.when(F.col(x).eqNullSafe(F.lag(x).over(w)), 0).otherwise(1)).withColumn("run", F.sum("__new").over(w))
    return r.groupBy(block, F.col(x).alias("value"), "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"))


def control_rates(df: DataFrame, group: str, control: Column, x: str, q: float = 0.95) -> DataFrame:
    """(group, limit, rate, n): the share of each group's non-control rows whose x exceeds the controls' quantile over all groups."""
    limit = df.filter(control).agg(F.percentile(x, q).alias("limit"))
    return df.filter(~control).join(F.broadcast(limit), F.lit(True)).groupBy(group, "limit").agg(F.avg((F.col(x) > F.col("limit")).cast("double")).alias("rate"), F.count("*").alias("n"))


def truth_recall(df: DataFrame, run: str, truth: Column, scope: Column, kept: Column, dt: float) -> DataFrame:
    """(run, truth_s, scope_s, kept_s, recall): seconds of truth, of it in scope, of that kept."""
    sec = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("double")) * dt
    g = df.groupBy(run).agg(sec(truth).alias("truth_s"), sec(truth & scope).alias("scope_s"), sec(truth & scope & kept).alias("kept_s"))
    return g.withColumn("recall", F.try_divide(F.col("kept_s"), F.col("scope_s")))


def error_by_bin(df: DataFrame, model: str, measured: str, edges: list[float]) -> DataFrame:
    """(bin, n, bias, sd, r): model error by size of the measured value."""
    b = sum(((F.abs(measured) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    err = F.col(model) - F.col(measured)
    return df.filter(err.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(err).alias("bias"), F.stddev_samp(err).alias("sd"), F.corr(model, measured).alias("r"))


def residual_table(df: DataFrame, klass: Column, v: str, width: float, residual: str) -> DataFrame:
    """(class, bin, n, p05, p50, p95) of residuals by driving class and speed bin."""
    q = lambda p: F.percentile(residual, p)
    return df.filter(F.col(residual).isNotNull()).groupBy(klass.alias("class"), F.floor(F.col(v) / width).alias("bin")).agg(F.count("*").alias("n"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def blocked_cv(df: DataFrame, fold: str, buffered: Column, x: str, y: str) -> DataFrame:
    """(fold, n, slope, rmse): each fold predicted by a line fitted to all rows outside it, rows of its buffer left out too.

    buffered gives the fold whose buffer a row lies in, or null. Sums are taken once; a fold's fit is the total less its own and its buffer's sums.
    """
    x2 = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__b", buffered)
    sums = lambda p: [F.count("*").alias(f"{p}n"), F.sum(x).alias(f"{p}x"), F.sum(y).alias(f"{p}y"), F.sum(F.col(x) ** 2).alias(f"{p}xx"), F.sum(F.col(x) * F.col(y)).alias(f"{p}xy")]
    total = x2.agg(*sums("t_"))
    own = x2.groupBy(fold).agg(*sums("o_"))
    near = x2.filter(F.col("__b").isNotNull() & (F.col("__b") != F.col(fold))).groupBy(F.col("__b").alias(fold)).agg(*sums("b_"))
    m = own.join(near, fold, "left").join(F.broadcast(total), F.lit(True))
    left = {c: F.col(f"t_{c}") - F.col(f"o_{c}") - F.coalesce(f"b_{c}", F.lit(0)) for c in ("n", "x", "y", "xx", "xy")}
    m = m.select(fold, *(v.cast("double").alias(c) for c, v in left.items()))
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.col("n") * F.col("xx") - F.col("x") ** 2, F.lit(0.0))
    fit = m.select(fold, slope.alias("slope"), F.col("x").alias("__sx"), F.col("y").alias("__sy"), F.col("n").alias("__n"))
    e = F.col(y) - (F.col("__sy") - F.col("slope") * F.col("__sx")) / F.col("__n") - F.col("slope") * F.col(x)
    return x2.join(F.broadcast(fit), fold).groupBy(fold, "slope").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


def coverage_gaps(series: DataFrame, keys: list[str], t: str, k: float) -> DataFrame:
    """keys with segments between gaps of more than k median steps, the longest one, the gaps' total and the covered share."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = series.withColumn("__d", F.col(t) - F.lag(t).over(w))
    med = d.groupBy(*keys).agg(F.percentile("__d", 0.5).alias("__m"))
    d = d.join(med, keys).withColumn("__gap", F.coalesce(F.col("__d") > k * F.col("__m"), F.lit(False))).withColumn("__s", F.sum(F.col("__gap").cast("int")).over(w))
    seg = d.groupBy(*keys, "__s").agg((F.max(t) - F.min(t)).alias("__len"), F.sum(F.when(F.col("__gap"), F.col("__d")).otherwise(0.0)).alias("__lost"))
    g = seg.groupBy(*keys).agg(F.count("*").alias("segments"), F.max("__len").alias("longest"), F.sum("__lost").alias("gap_s"), F.sum("__len").alias("__in"))
    return g.select(*keys, "segments", "longest", "gap_s", F.try_divide(F.col("__in"), F.col("__in") + F.col("gap_s")).alias("covered"))


def updates(series: DataFrame, key: str, t: str, columns: list[str]) -> DataFrame:
    """(key, n, updates, median_s, longest_s): rows at which any of the columns changes, and the time between them."""
    w = Window.partitionBy(key).orderBy(t)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    u = series.withColumn("__same", same & F.lag(F.lit(1)).over(w).isNotNull())
    n = u.groupBy(key).agg(F.count("*").alias("n"))
    only = u.filter(~F.col("__same"))
    gaps = only.withColumn("__d", F.col(t) - F.lag(t).over(w)).groupBy(key).agg(F.count("*").alias("updates"), F.percentile("__d", 0.5).alias("median_s"), F.max("__d").alias("longest_s"))
    return n.join(gaps, key)


def exceedance_groups(df: DataFrame, key: str, t: str, x: str, q: float, gap: float) -> DataFrame:
    """(key, group, t_start, t_end, peak, n): rows whose |x| exceeds the key's own quantile, grouped while at most gap apart."""
    limit = df.groupBy(key).agg(F.percentile(F.abs(x), q).alias("__q"))
    w = Window.partitionBy(key).orderBy(t)
    hit = df.join(limit, key).filter(F.abs(x) > F.col("__q"))
    hit = hit.withColumn("group", F.sum(F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)).over(w))
    return hit.groupBy(key, "group").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.max(F.abs(x)).alias("peak"), F.count("*").alias("n"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, both, changed, only_a, only_b): rows that two runs share and in how many each column differs, nulls equal to nulls."""
    x = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("__a"))
    y = b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("__b"))
    m = x.join(y, key, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    n = lambda c: F.sum(c.cast("long"))
    g = m.agg(n(both).alias("both"), n(F.col("__b").isNull()).alias("only_a"), n(F.col("__a").isNull()).alias("only_b"), *(n(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns))
    return g.select("both", "only_a", "only_b", F.inline(rows)).select("column", "both", "changed", "only_a", "only_b")


def even_selection(df: DataFrame, group: str, order: list[Column], per: int, n: int) -> DataFrame:
    """n rows taken from the groups in turn, at most `per` of each."""
    r = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("turn") <= per)
    return r.orderBy("turn", group).limit(n)


def before_after(events: DataFrame, rows: DataFrame, key: str, t: str, x: str, before: float, after: float, bucket: float) -> DataFrame:
    """(id, rms_before, rms_after, ratio) of x in the stretches before an event's start and after its end."""
    spans = events.select(key, "id", "t_start", "t_end", (F.col("t_start") - before).alias("b_start"), (F.col("t_end") + after).alias("b_end"))
    m = points_in(rows.select(key, t, x), spans, key, t, bucket)
    rms = lambda c: F.sqrt(F.avg(F.when(c, F.col(x) ** 2)))
    g = m.groupBy("id").agg(rms(F.col(t) < F.col("t_start")).alias("rms_before"), rms(F.col(t) > F.col("t_end")).alias("rms_after"))
    return g.withColumn("ratio", F.try_divide(F.col("rms_after"), F.col("rms_before")))


def onset(rows: DataFrame, block: str, t: str, x: str, share: float = 0.5) -> DataFrame:
    """(block, t_peak, t_onset, censored): the last time before the peak of |x| at which it was below the share of it; censored where the block begins above."""
    top = rows.groupBy(block).agg(F.max_by(F.struct(F.col(t).alias("t"), F.abs(x).alias("m")), F.struct(F.abs(x), -F.col(t))).alias("p"))
    m = rows.join(top, block).filter(F.col(t) < F.col("p.t"))
    g = m.groupBy(block).agg(F.max(F.when(F.abs(x) < share * F.col("p.m"), F.col(t))).alias("t_onset"))
    return top.select(block, F.col("p.t").alias("t_peak")).join(g, block, "left").withColumn("censored", F.col("t_onset").isNull())


def span_around(rows: DataFrame, block: str, t: str, x: str, share: float) -> DataFrame:
    """(block, t_start, t_end): from the peak of x outwards while x stays above the share of it."""
    top = rows.groupBy(block).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(x).alias("m")), F.struct(F.col(x), -F.col(t))).alias("p"), F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    m = rows.join(top, block)
    low = F.coalesce(F.col(x) <= share * F.col("p.m"), F.lit(True))
    g = m.groupBy(block, "p", "__lo", "__hi").agg(F.max(F.when(low & (F.col(t) < F.col("p.t")), F.col(t))).alias("a"), F.min(F.when(low & (F.col(t) > F.col("p.t")), F.col(t))).alias("b"))
    inner = m.join(g.select(block, "a", "b"), block).filter((F.col("a").isNull() | (F.col(t) > F.col("a"))) & (F.col("b").isNull() | (F.col(t) < F.col("b"))))
    return inner.groupBy(block).agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"))


def hopping(df: DataFrame, keys: list[str], t: str, width: float, hop: float, aggs: list[Column]) -> DataFrame:
    """keys, win_start and aggregates of windows of `width` that begin at every multiple of hop."""
    last = F.floor(F.col(t) / hop)
    first = F.floor((F.col(t) - width) / hop) + 1
    return df.withColumn("__w", F.explode(F.sequence(first, last))).groupBy(*keys, (F.col("__w") * hop).alias("win_start")).agg(*aggs)


def first_mover(df: DataFrame, block: str, t: str, limits: dict[str, float]) -> DataFrame:
    """(block, first, t_first): which of several signals first exceeds its limit in size; ties in the order given, none if no one does."""
    hit = {c: F.min(F.when(F.abs(c) >= lim, F.col(t))) for c, lim in limits.items()}
    g = df.groupBy(block).agg(*(h.alias(f"__{c}") for c, h in hit.items()))
    best = F.array_min(F.array_compact(F.array(*(F.when(F.col(f"__{c}").isNotNull(), F.struct(F.col(f"__{c}").alias("t"), F.lit(i).alias("i"), F.lit(c).alias("c"))) for i, c in enumerate(limits)))))
    return g.select(block, F.coalesce(best["c"], F.lit("none")).alias("first"), best["t"].alias("t_first"))


def matched_controls(cases: DataFrame, pool: DataFrame, car: str, v: str, width: float, k: int, seed: int) -> DataFrame:
    """(id, control, pick): up to k pool rows of the same car and speed bin for each case, by hash."""
    a = cases.select("id", car, F.floor(F.col(v) / width).alias("bin"))
    b = pool.select(F.col("id").alias("control"), car, F.floor(F.col(v) / width).alias("bin"))
    # a pool is first thinned to what can be picked at all, so a hot bin does not meet itself whole
    b = b.withColumn("__r", F.row_number().over(Window.partitionBy(car, "bin").orderBy(draw(seed, F.col("control")), "control"))).filter(F.col("__r") <= k + 1)
    m = a.join(b, [car, "bin"]).filter("id <> control")
    return m.withColumn("pick", F.row_number().over(Window.partitionBy("id").orderBy("__r"))).filter(F.col("pick") <= k).select("id", "control", "pick")


def gates(scores: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A row for each score row and acceptance gate; an unknown value fails."""
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in tests.items()))
    return scores.select("*", F.inline(rows))


def rate_table(df: DataFrame, rows: list[str], column: str, values: list[str], hit: Column) -> DataFrame:
    """Rates of hit by rows, one column for each of the values."""
    return df.groupBy(*rows).pivot(column, values).agg(F.avg(hit.cast("double")))


def exactly_one(picks: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """picks with the row of df that they name and ok, false where not exactly one row matches."""
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("id").alias("id"))
    return picks.join(n, keys, "left").select(*keys, F.when(F.col("__n") == 1, F.col("id")).alias("id"), F.coalesce(F.col("__n") == 1, F.lit(False)).alias("ok"))


def shift_agreement(a: DataFrame, b: DataFrame, key: str, tick: str, x: str, shifts: list[int]) -> DataFrame:
    """(shift, n, p50, p95) of |a - b| when b is moved by each shift in ticks."""
    moved = b.select(key, F.explode(F.lit(shifts)).alias("shift"), F.col(tick), F.col(x).alias("__y")).withColumn(tick, F.col(tick) + F.col("shift"))
    m = a.select(key, tick, F.col(x).alias("__x")).join(moved, [key, tick])
    d = F.abs(F.col("__x") - F.col("__y"))
    return m.groupBy("shift").agg(F.count(d).alias("n"), F.percentile(d, 0.5).alias("p50"), F.percentile(d, 0.95).alias("p95"))


def levelling(df: DataFrame, drive: str, x: str, y: str, z: str) -> DataFrame:
    """df with its axes turned so that the drive's mean specific force points along z: Rodrigues' rotation from nine sums a drive."""
    m = df.groupBy(drive).agg(F.avg(x).alias("__a"), F.avg(y).alias("__b"), F.avg(z).alias("__c"))
    n = F.sqrt(F.col("__a") ** 2 + F.col("__b") ** 2 + F.col("__c") ** 2)
    m = m.select(drive, *((F.col(c) / n).alias(c) for c in ("__a", "__b", "__c")))
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    k = 1.0 / F.nullif(1.0 + c, F.lit(0.0))
    rx = (1 - a * a * k) * F.col(x) - a * b * k * F.col(y) - a * F.col(z)
    ry = -a * b * k * F.col(x) + (1 - b * b * k) * F.col(y) - b * F.col(z)
    rz = a * F.col(x) + b * F.col(y) + c * F.col(z)
    return df.join(m, drive).withColumns({f"{x}_level": rx, f"{y}_level": ry, f"{z}_level": rz}).drop("__a", "__b", "__c")


def segment_distance(points: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """(id, kind, dist): each point's least distance to segments (kind, x1, y1, x2, y2) no longer than a cell, within one cell; segments are dealt to the cells around both ends."""
    s = segments.select("kind", "x1", "y1", "x2", "y2", F.array_distinct(F.flatten(F.array(*(F.array(*(F.struct((F.floor(F.col(f"x{e}") / cell) + i).alias("cx"), (F.floor(F.col(f"y{e}") / cell) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))) for e in (1, 2))))).alias("cells"))
    s = s.select("kind", "x1", "y1", "x2", "y2", F.inline("cells"))
    p = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    u = F.coalesce(((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    d = F.sqrt((F.col("x") - F.col("x1") - u * dx) ** 2 + (F.col("y") - F.col("y1") - u * dy) ** 2)
    return p.join(s, ["cx", "cy"]).withColumn("dist", d).filter(F.col("dist") <= cell).groupBy("id", "kind").agg(F.min("dist").alias("dist"))
