"""Slip evidence: a coarse sieve on model sideslip, scored runs, direct evidence and their grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators import timegrid as tg
from drivespan.operators.islands import runs
from drivespan.operators.joins import overlap_join

#: The confidence items' weights. The defaults of stage1, signal_sane, confidence, stage2 and sideslip_candidates are fixed values too.
WEIGHTS = {"strong_beta": 1.0, "unexplained": 1.0, "lateral_force": 1.0, "transient": 1.0, "corroborated": 1.0}
GRADES = ["multi", "high", "activation", "physics"]


def _held(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stage1(df: DataFrame, v_min: float = 10.0, beta: float = 1.0, sigma: float = 6.0, ay_residual: float = 1.5, flags: tuple[str, ...] = ("abs_flag", "vsc_flag")) -> DataFrame:
    """df with why_beta, why_latdyn, why_flag and stage1: in range and large sideslip in degrees and in sigmas, or lateral dynamics, or a flag."""
    in_range = F.col("beta_model_deg").isNotNull() & _held(F.col("v_mps") >= v_min)
    out = {
        "why_beta": in_range & _held((F.abs("beta_model_deg") >= beta) & (F.abs("beta_sigma") >= sigma)),
        "why_latdyn": in_range & _held(F.abs("ay_residual_mps2") >= ay_residual),
        "why_flag": in_range & reduce(Column.__or__, (_held(F.col(f) > 0.5) for f in flags)),
    }
    return df.withColumns(out).withColumn("stage1", F.col("why_beta") | F.col("why_latdyn") | F.col("why_flag"))


def signal_sane(ay: Column, ay_kin: Column, least: float = 0.5, low: float = 0.3, high: float = 2.0) -> Column:
    """Both lateral accelerations known, and small or of one sign and like size."""
    small = ~_held(F.abs(ay_kin) >= least)
    ok = _held((ay * ay_kin > 0) & (ay / F.nullif(ay_kin, F.lit(0.0))).between(low, high))
    return ay.isNotNull() & ay_kin.isNotNull() & (small | ok)


def confidence(df: DataFrame, block: str, order: str, rows: int, beta: float = 3.0, excess: float = 0.5, ay: float = 1.5, rate: float = 8.0, flags: tuple[str, ...] = ("abs_flag", "vsc_flag")) -> DataFrame:
    """df with a mask for each confidence item, widened by `rows`."""
    items = {
        "strong_beta": F.abs("beta_model_deg") >= beta,
        "unexplained": F.abs("beta_excess_deg") >= excess,
        "lateral_force": F.abs("ay_kin_mps2") >= ay,
        "transient": F.abs("beta_rate_dps") >= rate,
        "corroborated": reduce(Column.__or__, (_held(F.col(f) > 0.5) for f in flags)),
    }
    return df.withColumns({f"c_{k}": tg.dilate(_held(m), block, order, rows) for k, m in items.items()})


def stage2(df: DataFrame, block: str, t: str, dt: float, merge_gap: float = 0.5, least_s: float = 0.25, least_sane: float = 0.6, least_score: float = 2.0) -> DataFrame:
    """Runs of stage 1, (block, t_start, t_end, score, items, sane_share, verdict): verdict is passed, or the reason for rejection (duration, signal_sane, duration+signal_sane or confidence).

    Rows in a gap that a run bridges count for its share of sane rows and its items.
    """
    core = runs(df, F.col("stage1"), block, t, dt, merge_gap).select(block, F.col(t).alias("__t"), "run")
    spans = core.groupBy(block, "run").agg(F.min("__t").alias("t_start"), F.max("__t").alias("t_end"))
    # the run of a row: the last that began at or before it, if it has not ended
    marks = df.select(block, F.col(t).alias("t"), signal_sane(F.col("ay_mps2"), F.col("ay_kin_mps2")).alias("sane"), *(f"c_{k}" for k in WEIGHTS)).join(core.groupBy(block, F.col("__t").alias("t")).agg(F.max("run").alias("run")), [block, "t"], "left")
    w = Window.partitionBy(block).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("run", F.last("run", ignorenulls=True).over(w)).join(spans, [block, "run"]).filter("t <= t_end")
    agg = rows.groupBy(block, "run", "t_start", "t_end").agg(F.avg(F.col("sane").cast("double")).alias("sane_share"), *(F.max(F.col(f"c_{k}").cast("int")).alias(k) for k in WEIGHTS))
    score = reduce(Column.__add__, (F.col(k) * F.lit(x) for k, x in WEIGHTS.items()))
    items = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) == 1, F.lit(k)) for k in WEIGHTS))), "|")
    long, sane = F.col("t_end") - F.col("t_start") >= least_s, F.col("sane_share") >= least_sane
    verdict = F.when(~long & ~sane, "duration+signal_sane").when(~long, "duration").when(~sane, "signal_sane").when(score < least_score, "confidence").otherwise("passed")
    return agg.select(block, "run", "t_start", "t_end", score.alias("score"), items.alias("items"), "sane_share", verdict.alias("verdict"))


def reject_counts(judged: DataFrame) -> DataFrame:
    """(reason, n): how many runs each reason rejected; a run with two reasons counts for both."""
    return judged.filter("verdict <> 'passed'").select(F.explode(F.split("verdict", "\\+")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def sideslip_candidates(judged: DataFrame, df: DataFrame, block: str, t: str, pad: float = 2.0, merge_gap: float = 2.0, bucket: float = 60.0, high: float = 5.0, review: float = 3.0) -> DataFrame:
    """Passed runs padded and merged: (block, group, t_start, t_end, score, beta_peak, t_peak, grade); the grade follows the peak in degrees. The peak is taken from the cores only, not from the padding."""
    from drivespan.operators.islands import merge_intervals

    cores = judged.filter("verdict = 'passed'").withColumns({"p0": F.col("t_start") - pad, "p1": F.col("t_end") + pad})
    g = merge_intervals(cores, block, "p0", "p1", merge_gap)
    from drivespan.operators.joins import points_in

    rows = points_in(df.select(block, F.col(t).alias("t"), "beta_model_deg"), g.select(block, "group", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end")), block, "t", bucket)
    key = F.when(F.col("beta_model_deg").isNotNull(), F.struct(F.abs("beta_model_deg"), -F.col("t")))
    peaks = rows.groupBy(block, "group").agg(F.max_by("beta_model_deg", key).alias("beta_peak"), F.max_by("t", key).alias("t_peak"))
    out = g.groupBy(block, "group").agg(F.min("p0").alias("t_start"), F.max("p1").alias("t_end"), F.max("score").alias("score"))
    grade = F.when(F.abs("beta_peak") >= high, "high").when(F.abs("beta_peak") >= review, "review").otherwise("low")
    return out.join(peaks, [block, "group"], "left").withColumn("grade", grade)


def direct_evidence(df: DataFrame, block: str, order: str, t: str, dt: float, spread: float = 1.0, decel: float = -8.0, least_rows: int = 2, v_min: float = 3.0) -> DataFrame:
    """df with e_slip_warn, e_abs, e_vsc, e_spread and e_decel. The last two need a speed and must last least_rows rows; slip_warn holds in (3.5, 4.5] only."""
    fast = _held(F.col("v_mps") >= v_min)
    w = tg.by(block, order)
    raw = df.withColumns(
        {
            "e_slip_warn": _held((F.col("slip_warn") > 3.5) & (F.col("slip_warn") <= 4.5)), "e_abs": _held(F.col("abs_flag") > 0.5), "e_vsc": _held(F.col("vsc_flag") > 0.5),
            "__spread": _held(F.col("ws_spread_mps") >= spread) & fast, "__decel": _held(F.col("wheel_decel_mps2") <= decel) & fast,
        }
    )
    for c, name in (("__spread", "e_spread"), ("__decel", "e_decel")):
        raw = raw.withColumn("__run", F.sum(F.when(F.col(c) & F.coalesce(F.lag(c).over(w), F.lit(False)), 0).otherwise(1)).over(w))
        raw = raw.withColumn(name, F.col(c) & (F.sum(F.col(c).cast("int")).over(Window.partitionBy(block, "__run")) >= least_rows)).drop("__run", c)
    return raw


EVIDENCE = ("e_slip_warn", "e_abs", "e_vsc", "e_spread", "e_decel")
DIRECT = ("e_slip_warn", "e_abs", "e_vsc")
#: Which evidence backs which, and the mechanism that each stands for.
BACKS = {"e_slip_warn": ("e_spread", "e_decel", "e_abs"), "e_abs": ("e_decel", "e_spread"), "e_vsc": ("e_spread",)}
MECHANISM = {"e_spread": "wheel", "e_decel": "lock", "e_abs": "brake"}


def direct_slip(df: DataFrame, block: str, t: str, dt: float, pad_rows: int = 5, merge_gap: float = 0.2, multi: int = 2) -> DataFrame:
    """Windows of evidence: (block, t_start, t_end, grade, evidence, corroboration, mechanisms, v_at_peak, v_max).

    Triggers are widened by pad_rows and merged. The grade counts distinct mechanisms behind direct flags: at least
    `multi` are multi, one backed flag is high, an unbacked one activation, none physics.
    """
    trigger = reduce(Column.__or__, (F.col(e) for e in EVIDENCE))
    marked = df.withColumn("__core", trigger).withColumn("__near", tg.dilate(F.col("__core"), block, t, pad_rows))
    g = runs(marked, F.col("__near"), block, t, dt, merge_gap)
    spans = g.groupBy(block, "run").agg(
        F.min(t).alias("t_start"), F.max(t).alias("t_end"), *(F.max(F.col(e).cast("int")).alias(e) for e in EVIDENCE), F.max("v_mps").alias("v_max"), F.max(F.when(F.col("__core"), F.col("v_mps"))).alias("v_at_peak"),
    )
    hit = lambda e: F.col(e) == 1
    pairs = F.array_compact(F.array(*(F.when(hit(d), F.concat(F.lit(f"{d[2:]}:"), F.array_join(F.array_compact(F.array(*(F.when(hit(s), F.lit(s[2:])) for s in BACKS[d]))), "+"))) for d in DIRECT)))
    pairs = F.filter(pairs, lambda p: ~p.endswith(":"))
    mech = F.array_distinct(F.flatten(F.array(*(F.when(hit(d), F.array_compact(F.array(*(F.when(hit(s), F.lit(MECHANISM[s])) for s in BACKS[d])))).otherwise(F.array().cast("array<string>")) for d in DIRECT))))
    spans = spans.withColumns({"pairs": pairs, "mech": mech, "n_direct": sum((F.col(d) for d in DIRECT), F.lit(0))})
    grade = F.when(F.size("mech") >= multi, "multi").when(F.size("pairs") >= 1, "high").when(F.col("n_direct") >= 1, "activation").otherwise("physics")
    evidence = F.array_join(F.array_compact(F.array(*(F.when(hit(e), F.lit(e[2:])) for e in EVIDENCE))), "|")
    return spans.select(block, "t_start", "t_end", grade.alias("grade"), "n_direct", evidence.alias("evidence"), F.array_join("pairs", "|").alias("corroboration"), F.array_join("mech", "|").alias("mechanisms"), "v_at_peak", "v_max")


def grade_rank(grade: Column) -> Column:
    """The grade's place from 1, best first; unknown grades come last."""
    rank = F.array_position(F.lit(GRADES), grade)
    return F.when(rank == 0, 99).otherwise(rank)


def branch_overlap(a: DataFrame, b: DataFrame, key: str, bucket: float) -> DataFrame:
    """Both branches' events (key, a_id, a_start, a_end) and (key, b_id, b_start, b_end): overlapping pairs, and the rows of one side that overlap nothing."""
    both = overlap_join(a, b, key, bucket).select(key, "a_id", "b_id", F.lit("both").alias("side"))
    only_a = a.join(both.select(key, "a_id").distinct(), [key, "a_id"], "left_anti").select(key, "a_id", F.lit(None).cast("long").alias("b_id"), F.lit("a").alias("side"))
    only_b = b.join(both.select(key, "b_id").distinct(), [key, "b_id"], "left_anti").select(key, F.lit(None).cast("long").alias("a_id"), "b_id", F.lit("b").alias("side"))
    return both.unionByName(only_a).unionByName(only_b)


def slip_kind(vsc: Column, ay_peak: Column, counter: Column, abs_on: Column, decel_peak: Column, spread_peak: Column, ax: Column) -> Column:
    """lateral, lock, spin or unclassified, tested in that order."""
    return (
        F.when(_held(vsc | (F.abs(ay_peak) >= 4.0) | (counter > 0.5)), "lateral").when(_held(abs_on | (decel_peak <= -8.0)) & _held(ax < 0), "lock").when(_held((spread_peak >= 1.0) & (ax >= 0)), "spin").otherwise("unclassified")
    )
