"""Declarative event rules.

A rule is a dict: feature, op (lt, gt, abs_gt, rising, agreement, cooccurrence, sequence), threshold, and where they
apply label, gate, conditions, tolerance_s, min_duration_s, merge_gap_s, stage, weight, base, require_any, window_s,
min_count, first, then, min_gap_s, max_gap_s. All immediate rules are judged in one pass: their masks are columns of
one window by block, the rows where any holds are unpivoted, and one ordering by (block, rule) finds the runs of all.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators.joins import overlap_join
from drivespan.operators.timegrid import by, dilate
from drivespan.sources.scratch import checkpointed

DEFERRED = ("cooccurrence", "sequence")
FIELDS = ["event_type", "label", "feature", "op", "threshold", "t_start", "t_end", "duration_s", "peak_value", "exceedance", "stage", "weight", "gate", "rule"]


def condition(x: Column, op: str, threshold: float) -> Column:
    """lt, gt, le, ge, abs_gt or abs_ge; null, NaN and infinities never hold."""
    x = x.cast("double")
    x = F.when(F.abs(x) < float("inf"), x)  # NaN is above every number
    held = {"lt": x < threshold, "gt": x > threshold, "le": x <= threshold, "ge": x >= threshold, "abs_gt": F.abs(x) > threshold, "abs_ge": F.abs(x) >= threshold}[op]
    return F.coalesce(held, F.lit(False))


def gate(columns: list[str], spec: dict) -> tuple[Column, str]:
    """The conjunction of a rule's gate conditions and its text. A missing column blocks the rule; no gate lets everything pass."""
    parts = spec.get("gate") or []
    text = " & ".join(f"{c['feature']} {c['op']} {float(c['threshold'])}" for c in parts)
    if any(c["feature"] not in columns for c in parts):
        return F.lit(False), text
    return reduce(Column.__and__, (condition(F.col(c["feature"]), c["op"], float(c["threshold"])) for c in parts), F.lit(True)), text


def skipped(columns: list[str], rules: dict[str, dict], max_stage: int = 2) -> list[tuple[str, str]]:
    """(rule, reason) of the rules that can't be judged."""
    out = []
    for name, r in rules.items():
        if not r.get("enabled", True):
            continue
        if int(r.get("stage", 1)) > max_stage:
            out.append((name, "stage"))
        elif r["op"] in DEFERRED:
            if lost := sorted({n for n in _named(r) if n not in rules}):
                out.append((name, "unknown_event:" + ",".join(lost)))
        elif lost := sorted({f for f in [r["feature"], *(c["feature"] for c in r.get("conditions", []))] if f not in columns}):
            out.append((name, "missing_feature:" + ",".join(lost)))
    return out


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def catalogue(spark, rules: dict[str, dict]) -> DataFrame:
    """One row a rule, as a table for reports."""
    rows = [(n, r.get("label", n), r.get("feature") or r.get("base") or "/".join(_list(r.get("first", ""))), r["op"], float(r.get("threshold") or 0.0), float(r.get("min_duration_s", 0)), float(r.get("merge_gap_s", 0)), int(r.get("stage", 1)), float(r.get("weight", 1)), gate([], r)[1]) for n, r in rules.items()]
    return spark.createDataFrame(rows, "name string, label string, feature string, op string, threshold double, min_duration_s double, merge_gap_s double, stage int, weight double, gate string")


def _immediate(df: DataFrame, rules: dict[str, dict], block: str, t: str, step: float) -> DataFrame | None:
    marks = []
    for name, r in rules.items():
        op, x = r["op"], F.col(r["feature"]).cast("double")
        allowed, text = gate(df.columns, r)
        primary, threshold, said = op, float(r.get("threshold", 0.5)), ""
        if op == "agreement":
            near = round(float(r.get("tolerance_s", 0.0)) / step)
            own = {c["feature"]: c for c in r["conditions"]}[r["feature"]]
            primary, threshold = own["op"], float(own["threshold"])
            mask = reduce(Column.__and__, (dilate(condition(F.col(c["feature"]), c["op"], float(c["threshold"])), block, t, near) for c in r["conditions"]))
            said = " & ".join(f"{c['feature']} {c['op']} {float(c['threshold'])}" for c in r["conditions"])
        else:
            mask = condition(x, "gt" if op == "rising" else op, threshold)
        mask = mask & allowed
        # the last of the block's rows before a run tells an edge from a flag that was already up
        gap = 0.0 if op == "rising" else float(r.get("merge_gap_s", 0.0))
        marks.append((name, r, mask, x, primary, threshold, gap, text, said))
    if not marks:
        return None
    wide = df.select(block, t, F.row_number().over(by(block, t)).alias("__row"), *(m[2].alias(f"__m{i}") for i, m in enumerate(marks)), *(m[3].alias(f"__x{i}") for i, m in enumerate(marks)))
    # rows in a gap that a run bridges count for its peak, so rows within the gap of a true one travel along
    near = [dilate(F.col(f"__m{i}"), block, t, math.ceil(m[6] / step)) if m[1]["op"] == "agreement" and m[6] else F.col(f"__m{i}") for i, m in enumerate(marks)]
    wide = wide.select("*", *(n.alias(f"__n{i}") for i, n in enumerate(near)))
    cells = F.array(*(F.when(F.col(f"__n{i}"), F.struct(F.lit(i).alias("i"), F.col(f"__m{i}").alias("mask"), F.col(f"__x{i}").alias("x"))) for i in range(len(marks))))
    long = wide.select(block, F.col(t).alias("t"), F.col("__row"), F.inline(F.filter(cells, lambda c: c.isNotNull())))
    gaps = F.element_at(F.array(*(F.lit(max(m[6], 1.5 * step)) for m in marks)), F.col("i") + 1)
    w = Window.partitionBy(block, "i").orderBy("t")
    last = F.max(F.when(F.col("mask"), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("__new", F.when(F.col("mask") & (last.isNull() | (F.col("t") - last > gaps)), 1).otherwise(0))
    long = long.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("run > 0")
    end = F.max(F.when(F.col("mask"), F.col("t"))).over(Window.partitionBy(block, "i", "run"))
    long = long.withColumn("__end", end).filter(F.col("t") <= F.col("__end"))
    spans = long.groupBy(block, "i", "run").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min("__row").alias("__first"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max_by("x", F.struct(F.abs("x"), -F.col("t"))).alias("far")
    )
    meta = F.array(
        *(
            F.struct(
                F.lit(n).alias("event_type"), F.lit(r.get("label", n)).alias("label"), F.lit(r["feature"]).alias("feature"), F.lit(r["op"]).alias("op"), F.lit(thr).alias("threshold"), F.lit(primary).alias("primary"),
                F.lit(float(r.get("min_duration_s", 0.0)) if r["op"] != "rising" else 0.0).alias("least"), F.lit(int(r.get("stage", 1))).alias("stage"), F.lit(float(r.get("weight", 1.0))).alias("weight"), F.lit(text).alias("gate"), F.lit(said).alias("rule"),
            )
            for n, r, _, _, primary, thr, _, text, said in marks
        )
    )
    spans = spans.select(block, "t_start", "t_end", "__first", "lo", "hi", "far", F.element_at(meta, F.col("i") + 1).alias("m")).select(block, "t_start", "t_end", "__first", "lo", "hi", "far", "m.*")
    rising = F.col("op") == "rising"
    peak = F.when(rising, 1.0).when(F.col("primary") == "lt", F.col("lo")).when(F.col("primary") == "gt", F.col("hi")).otherwise(F.col("far"))
    over = F.when(rising, 1.0).when(F.col("primary") == "lt", F.col("threshold") - peak).when(F.col("primary") == "gt", peak - F.col("threshold")).otherwise(F.abs(peak) - F.col("threshold"))
    spans = spans.withColumn("duration_s", F.col("t_end") - F.col("t_start")).filter(F.when(rising, F.col("__first") > 1).otherwise((F.col("duration_s") >= F.col("least")) & F.col("far").isNotNull()))
    return spans.select(block, *(peak.alias("peak_value") if c == "peak_value" else over.alias("exceedance") if c == "exceedance" else F.col(c) for c in FIELDS))


def _meta(rules: dict[str, dict], extra: dict[str, callable]) -> Column:
    """An array with a struct for each rule: what its events say of it, and what `extra` makes of the rule."""
    own = lambda n, r: {"event_type": n, "label": r.get("label", n), "op": r["op"], "stage": int(r.get("stage", 1)), "weight": float(r.get("weight", 1.0)), "gate": ""}
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in own(n, r).items()), *(F.lit(f(r)).alias(k) for k, f in extra.items())) for n, r in rules.items()))


def cooccurrence(events: DataFrame, rules: dict[str, dict], block: str, bucket: float) -> DataFrame:
    """For each rule, base events that overlap at least min_count other types within +-window_s. The base event's own span is kept. One join serves all rules."""
    wanted = {"base": lambda r: r["base"], "types": lambda r: list(r.get("require_any") or [""]), "window": lambda r: float(r.get("window_s", 0.0)), "least": lambda r: float(r.get("min_count", 1))}
    spans = events.select(block, F.col("event_type").alias("type"), "t_start", "t_end")
    a = spans.select(block, F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"), F.explode(F.filter(_meta(rules, wanted), lambda m: m["base"] == F.col("type"))).alias("m")).distinct()
    b = spans.filter(F.col("type").isin(sorted({t for r in rules.values() for t in r.get("require_any") or []}))).select(block, F.col("type").alias("b_type"), F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    met = overlap_join(a, b, block, bucket, pad=F.col("m.window")).filter(F.array_contains("m.types", F.col("b_type")))
    hits = met.groupBy(block, F.col("a_start").alias("t_start"), F.col("a_end").alias("t_end"), "m").agg(F.array_sort(F.collect_set("b_type")).alias("types")).withColumn("n", F.size("types").cast("double")).filter("n >= m.least")
    made = {"feature": F.col("m.base"), "threshold": F.col("m.least"), "duration_s": F.col("t_end") - F.col("t_start"), "peak_value": F.col("n"), "exceedance": F.col("n") - F.col("m.least"), "rule": F.concat(F.col("m.base"), F.lit(" with "), F.array_join("types", "/"))}
    return hits.select(block, *(made[c].alias(c) if c in made else F.col(c) if c in hits.columns else F.col(f"m.{c}") for c in FIELDS))


def sequence(events: DataFrame, rules: dict[str, dict], block: str) -> DataFrame:
    """For each rule, a first event and the next unused then event whose start lies min_gap_s to max_gap_s after its end, greedily in order of time.

    The fold runs inside stretches without a pause of more than max_gap_s, so a long block is never one array.
    """
    wanted = {"first": lambda r: _list(r["first"]), "then": lambda r: _list(r["then"]), "lo": lambda r: float(r.get("min_gap_s", 0.0)), "hi": lambda r: float(r.get("max_gap_s", 0.0))}
    own = events.select(block, F.col("event_type").alias("type"), "t_start", "t_end", F.explode(_meta(rules, wanted)).alias("m"))
    own = own.filter(F.array_contains("m.first", F.col("type")) | F.array_contains("m.then", F.col("type")))
    w = Window.partitionBy(block, "m.event_type").orderBy("t_start", "t_end", "type")
    latest = F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("__new", F.when(F.col("t_start") - latest <= F.col("m.hi"), 0).otherwise(1)).withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("t_start", "t_end", "type")
    pick = lambda side: F.array_sort(F.collect_list(F.when(F.array_contains(f"m.{side}", F.col("type")), item)))
    parts = own.groupBy(block, "m", "part").agg(pick("first").alias("a"), pick("then").alias("b")).filter("size(a) > 0 and size(b) > 0")
    parts = parts.withColumn("b", F.transform("b", lambda x, i: F.struct(i.alias("i"), x["t_start"].alias("s"), x["t_end"].alias("e"), x["type"].alias("k"))))
    kind = "array<struct<t_start:double,a_end:double,a_type:string,b_start:double,t_end:double,b_type:string,i:int>>"

    def step(acc: Column, a: Column) -> Column:
        gap = lambda b: b["s"] - a["t_end"]
        free = F.filter("b", lambda b: (gap(b) >= F.col("m.lo")) & (gap(b) <= F.col("m.hi")) & ~F.exists(acc, lambda u: u["i"] == b["i"]))
        b = F.get(free, F.lit(0))
        made = F.struct(a["t_start"].alias("t_start"), a["t_end"].alias("a_end"), a["type"].alias("a_type"), b["s"].alias("b_start"), b["e"].alias("t_end"), b["k"].alias("b_type"), b["i"].alias("i"))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(made))).otherwise(acc)

    met = parts.select(block, "m", F.inline(F.aggregate("a", F.array().cast(kind), step))).withColumn("gap", F.col("b_start") - F.col("a_end"))
    made = {"feature": F.col("a_type"), "threshold": F.col("m.hi"), "duration_s": F.col("t_end") - F.col("t_start"), "peak_value": F.col("gap"), "exceedance": F.greatest(F.col("m.hi") - F.col("gap"), F.lit(0.0)), "rule": F.concat_ws(" ", "b_type", F.lit("after"), "a_type")}
    return met.select(block, *(made[c].alias(c) if c in made else F.col(c) if c in met.columns else F.col(f"m.{c}") for c in FIELDS))


def _named(r: dict) -> list[str]:
    """The event types that a deferred rule looks at."""
    return [r["base"], *(r.get("require_any") or [])] if r["op"] == "cooccurrence" else [*_list(r["first"]), *_list(r["then"])]


def levels(rules: dict[str, dict]) -> list[dict[str, dict]]:
    """Deferred rules in rounds: a rule comes after those given before it whose events it looks at."""
    at: dict[str, int] = {}
    for n, r in rules.items():
        at[n] = 1 + max((at[k] for k in _named(r) if k in at), default=-1)
    return [{n: r for n, r in rules.items() if at[n] == k} for k in range(max(at.values(), default=-1) + 1)]


def detect(df: DataFrame, rules: dict[str, dict], block: str = "drive", t: str = "t", step: float = 0.05, max_stage: int = 2, bucket: float = 60.0) -> DataFrame:
    """All events (block, *FIELDS) of a rule set. Deferred rules see the events of those given before them; skipped() tells which rules can't be judged.

    Where there are deferred rules, the immediate events are found once and kept; each round of deferred rules is then one join, and one ordering, over the events so far. A rule set that
    judges nothing gives an empty table of the same columns.
    """
    left_out = {n for n, _ in skipped(df.columns, rules, max_stage)} | {n for n, r in rules.items() if not r.get("enabled", True)}
    live = {n: r for n, r in rules.items() if n not in left_out}
    events = _immediate(df, {n: r for n, r in live.items() if r["op"] not in DEFERRED}, block, t, step)
    if events is None:
        kinds = {"stage": "int"} | dict.fromkeys(("threshold", "t_start", "t_end", "duration_s", "peak_value", "exceedance", "weight"), "double")
        return df.select(block, *(F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in FIELDS)).limit(0)
    rounds = levels({n: r for n, r in live.items() if r["op"] in DEFERRED})
    if rounds:
        events = checkpointed(events)
    for k, own in enumerate(rounds):
        found = [f({n: r for n, r in own.items() if r["op"] == op}) for op, f in (("cooccurrence", lambda x: cooccurrence(events, x, block, bucket)), ("sequence", lambda x: sequence(events, x, block))) if any(r["op"] == op for r in own.values())]  # noqa: B023
        events = reduce(DataFrame.unionByName, found, events)
        if k + 1 < len(rounds):
            events = checkpointed(events)
    return events


def _gate(**least: float) -> list[dict]:
    """Gate conditions: v_mps above its value, net_heading_win_deg below its."""
    op = {"v_mps": "gt", "net_heading_win_deg": "lt"}
    return [{"feature": f, "op": op[f], "threshold": x} for f, x in least.items()]


_RISKY = ["short_thw", "cut_in_candidate", "closing_fast", "low_ttc"]
#: The shipped rules over the feature table, in order of judgement.
SHIPPED: dict[str, dict] = {
    "hard_brake": {"feature": "ax_mps2", "op": "lt", "threshold": -2.5, "min_duration_s": 0.3, "merge_gap_s": 1.0, "stage": 1, "weight": 1.0},
    "hard_accel": {"feature": "ax_mps2", "op": "gt", "threshold": 2.5, "min_duration_s": 0.3, "merge_gap_s": 1.0, "stage": 1, "weight": 0.4, "gate": _gate(v_mps=8.0)},
    "hard_steer": {
        "feature": "ay_kin_mps2", "op": "agreement", "tolerance_s": 0.3, "min_duration_s": 0.15, "merge_gap_s": 1.0, "stage": 2, "weight": 0.3, "gate": _gate(net_heading_win_deg=15.0, v_mps=5.0),
        "conditions": [{"feature": "steer_rate_dps", "op": "abs_gt", "threshold": 25.0}, {"feature": "ay_kin_mps2", "op": "abs_gt", "threshold": 2.0}, {"feature": "ay_can_mps2", "op": "abs_gt", "threshold": 1.4}],
    },
    "lateral_accel": {"feature": "ay_kin_mps2", "op": "abs_gt", "threshold": 3.0, "min_duration_s": 0.2, "merge_gap_s": 1.0, "stage": 2, "weight": 0.3, "gate": _gate(net_heading_win_deg=15.0, v_mps=5.0)},
    "weaving": {"feature": "weave_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.5, "merge_gap_s": 2.0, "stage": 2, "weight": 0.5},
    "short_thw": {"feature": "thw_s", "op": "lt", "threshold": 0.6, "min_duration_s": 0.5, "merge_gap_s": 1.0, "stage": 1, "weight": 1.0},
    "low_ttc": {"feature": "ttc_s", "op": "lt", "threshold": 2.0, "min_duration_s": 0.3, "merge_gap_s": 1.0, "stage": 1, "weight": 1.5},
    "yaw_instability": {"feature": "yaw_residual_sigma", "op": "abs_gt", "threshold": 6.0, "min_duration_s": 0.3, "merge_gap_s": 1.0, "stage": 2, "weight": 1.5, "gate": _gate(v_mps=10.0, net_heading_win_deg=15.0)},
    "s_evasion": {"feature": "s_evasion_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.3, "merge_gap_s": 1.0, "stage": 2, "weight": 2.0},
    "panic_brake": {"feature": "panic_brake_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.2, "merge_gap_s": 1.0, "stage": 1, "weight": 0.4},
    "panic_brake_with_lead": {"op": "cooccurrence", "base": "panic_brake", "require_any": _RISKY, "window_s": 2.0, "min_count": 1, "stage": 2, "weight": 2.0},
    "closing_fast": {"feature": "closing_fast_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.5, "merge_gap_s": 1.0, "stage": 2, "weight": 1.2, "gate": _gate(v_mps=15.0)},
    "brake_and_steer": {"op": "cooccurrence", "base": "hard_brake", "require_any": ["hard_steer", "s_evasion"], "window_s": 1.0, "min_count": 1, "stage": 2, "weight": 2.0},
    "brake_after_evasion": {"op": "sequence", "first": ["s_evasion", "hard_steer"], "then": "hard_brake", "min_gap_s": 0.0, "max_gap_s": 3.0, "stage": 2, "weight": 2.0},
    "cut_in_candidate": {"feature": "cut_in_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.3, "merge_gap_s": 1.0, "stage": 2, "weight": 1.5},
    "lane_change_candidate": {"feature": "lc_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.5, "merge_gap_s": 0.5, "stage": 2, "weight": 0.0},
    "risky_lane_change": {
        "op": "cooccurrence", "base": "lane_change_candidate", "window_s": 2.0, "min_count": 1, "stage": 2, "weight": 2.0,
        "require_any": [*_RISKY, "hard_steer", "lateral_accel", "hard_brake", "abs_active", "vsc_active", "aeb_active", "wheel_speed_anomaly"],
    },
    "abs_active": {"feature": "abs_active_flag", "op": "rising", "threshold": 0.5, "min_duration_s": 0.0, "merge_gap_s": 1.0, "stage": 2, "weight": 2.0},
    "vsc_active": {"feature": "vsc_active_flag", "op": "rising", "threshold": 0.5, "min_duration_s": 0.0, "merge_gap_s": 1.0, "stage": 2, "weight": 2.5},
    "slip_warn_active": {"feature": "slip_warn", "op": "gt", "threshold": 3.5, "min_duration_s": 0.0, "merge_gap_s": 1.0, "stage": 2, "weight": 2.0},
    "aeb_active": {"feature": "precollision_active", "op": "rising", "threshold": 0.5, "min_duration_s": 0.0, "merge_gap_s": 1.0, "stage": 2, "weight": 2.5},
    "panic_brake_pedal": {"feature": "panic_brake_pedal_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.2, "merge_gap_s": 1.0, "stage": 2, "weight": 1.0},
    "counter_steer": {"feature": "counter_steer_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.2, "merge_gap_s": 1.0, "stage": 2, "weight": 0.3, "gate": _gate(v_mps=10.0, net_heading_win_deg=15.0)},
    "wheel_speed_anomaly": {"feature": "ws_anomaly_active", "op": "gt", "threshold": 0.5, "min_duration_s": 0.2, "merge_gap_s": 0.3, "stage": 2, "weight": 1.5},
}
