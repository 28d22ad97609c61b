"""Queries of the window filter, the event rules and the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import candidates as cd, rules as ru, windows as wf
from drivespan.plans.base import DT, SIG, TICKS, query, rounded, signals, ticks

DAY = 86400.0
_WIN = """w AS (SELECT drive, CAST(floor((t - t0) / 86400.0) AS BIGINT) AS win, min(v) FILTER (WHERE channel = 'click') AS lo_click, max(v) FILTER (WHERE channel = 'click') AS hi_click, min(v) FILTER (WHERE channel = 'view') AS lo_view, max(v) FILTER (WHERE channel = 'view') AS hi_view,
max(v) FILTER (WHERE channel = 'error') AS hi_error, min(v) FILTER (WHERE channel = 'purchase') AS lo_purchase, max(v) FILTER (WHERE channel = 'purchase') AS hi_purchase FROM sig JOIN (SELECT drive, min(t) AS t0 FROM sig GROUP BY drive) USING (drive) GROUP BY ALL)"""
CHANNELS = ["click", "view", "error", "purchase"]
#: Thresholds on the stand-in values: click as speed, view as braking, purchase as lateral acceleration, error as flag.
CFG = {"v_min": 100.0, "ax": 60.0, "ay": 400.0}
_PASS = "p AS (SELECT *, coalesce(hi_click >= 100, false) AND (coalesce(lo_view <= 60, false) OR coalesce(greatest(abs(lo_purchase), abs(hi_purchase)) >= 400, false)) AS kin, coalesce(hi_error > 480, false) AS flag FROM w)"


def _windows(spark, sf):
    return wf.extremes(signals(spark, sf), ["drive"], CHANNELS, DAY)


def _passing(spark, sf):
    w = _windows(spark, sf)
    flag = F.coalesce(F.col("hi_error") > 480, F.lit(False))
    kin, full = wf.passes(F.col("hi_click"), F.col("lo_view"), wf.absmax(F.col("lo_purchase"), F.col("hi_purchase")), flag, CFG)
    return w.select("drive", "win", kin.alias("kin"), flag.alias("flag"), full.alias("keep"), "lo_click", "hi_click")


@query(f"WITH {SIG}, {_WIN} SELECT drive, win, lo_click, hi_click, lo_view, hi_view, hi_error, lo_purchase, hi_purchase FROM w")
def window_extremes(spark, sf):
    return _windows(spark, sf).drop("lo_error")


@query(f"WITH {SIG}, {_WIN}, {_PASS} SELECT drive, win, kin, flag, kin OR flag AS keep FROM p")
def window_pass(spark, sf):
    return _passing(spark, sf).select("drive", "win", "kin", "flag", "keep")


@query(f"WITH {SIG}, {_WIN}, {_PASS} SELECT drive, count(*) AS windows, CAST(sum((kin OR flag)::INT) AS BIGINT) AS kept, round(sum((kin OR flag)::INT) * 24.0, 3) AS hours FROM p GROUP BY drive")
def window_hours(spark, sf):
    """Which windows are kept, and how many hours that is per drive."""
    kept = F.sum(F.col("keep").cast("int"))
    return _passing(spark, sf).groupBy("drive").agg(F.count("*").alias("windows"), kept.alias("kept"), F.round(kept * 24.0, 3).alias("hours"))


@query(f"""WITH {SIG}, {_WIN} SELECT drive, win, coalesce(count(lo_click) OVER x = count(*) OVER x AND max(hi_click) OVER x - min(lo_click) OVER x < 250, false) AS steady FROM w WINDOW x AS (PARTITION BY drive ORDER BY win ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def steady_windows(spark, sf):
    return wf.steady(_windows(spark, sf), ["drive"], "lo_click", "hi_click", 3, 250.0).select("drive", "win", "steady")


@query(f"""WITH {SIG}, r AS (SELECT s.*, x.width, floor((t - t0) / x.width) :: BIGINT AS win FROM sig s JOIN (SELECT drive, min(t) AS t0 FROM sig GROUP BY drive) USING (drive) CROSS JOIN (SELECT unnest([86400.0 :: DOUBLE, 432000.0 :: DOUBLE]) AS width) x)
SELECT drive, width, win, min(v) FILTER (WHERE channel = 'click') AS click_min, max(v) FILTER (WHERE channel = 'click') AS click_max, max(abs(v)) FILTER (WHERE channel = 'click') AS click_absmax, min(v) FILTER (WHERE channel = 'view') AS view_min, max(v) FILTER (WHERE channel = 'view') AS view_max, max(abs(v)) FILTER (WHERE channel = 'view') AS view_absmax FROM r GROUP BY drive, width, win""")
def multi_length_windows(spark, sf):
    return wf.multi_length(signals(spark, sf), ["drive"], [DAY, 5 * DAY], ["click", "view"])


@query(f"WITH {SIG}, {_WIN}, {_PASS} SELECT drive, win, coalesce(max((kin OR flag)::INT) OVER (PARTITION BY drive ORDER BY win RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1, false) AS kept FROM p")
def keep_margin(spark, sf):
    return _passing(spark, sf).select("drive", "win", wf.keep_margin(None, ["drive"], F.col("keep"), 2).alias("kept"))


#: A rule set over the ticks, one of each operator.
RULES = {
    "hard_brake": {"feature": "ax_mps2", "op": "lt", "threshold": -3.0, "min_duration_s": 0.1, "merge_gap_s": 0.3, "gate": [{"feature": "v_mps", "op": "gt", "threshold": 3.0}], "weight": 1.0},
    "side_pull": {"feature": "ay_mps2", "op": "abs_gt", "threshold": 4.0, "min_duration_s": 0.1, "merge_gap_s": 0.2, "weight": 1.5},
    "hard_accel": {"feature": "ax_mps2", "op": "gt", "threshold": 5.0, "min_duration_s": 0.05, "merge_gap_s": 0.2},
    "abs_active": {"feature": "abs_flag", "op": "rising", "threshold": 0.5, "weight": 2.0},
    "agree": {"feature": "steer_deg", "op": "agreement", "tolerance_s": 0.1, "min_duration_s": 0.1, "merge_gap_s": 0.2, "conditions": [{"feature": "steer_deg", "op": "abs_gt", "threshold": 60.0}, {"feature": "yaw_dps", "op": "abs_gt", "threshold": 12.0}]},
    "pull_and_more": {"op": "cooccurrence", "base": "side_pull", "require_any": ["hard_brake", "hard_accel", "agree"], "window_s": 0.2, "min_count": 1, "stage": 2, "weight": 2.0},
    "turn_then_brake": {"op": "sequence", "first": "agree", "then": ["hard_brake", "side_pull"], "min_gap_s": 0.0, "max_gap_s": 1.0, "stage": 2, "weight": 2.0},
    "no_column": {"feature": "not_there", "op": "lt", "threshold": 0.0},
}


def _events(spark, sf, *names):
    """The events of the rule set, or of the named rules of it."""
    return ru.detect(ticks(spark, sf), {n: RULES[n] for n in names or RULES})


def _islands(name: str, mask: str, gap: float, least: float, peak: str, over: str) -> str:
    return f"""{name}_h AS (SELECT * FROM ticks WHERE {mask}), {name}_g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive ORDER BY tick) > {max(gap, 0.075)} THEN 1 ELSE 0 END AS nw FROM {name}_h),
{name}_i AS (SELECT *, sum(nw) OVER (PARTITION BY drive ORDER BY tick) AS run FROM {name}_g), {name} AS (SELECT drive, '{name}' AS event_type, min(t) AS t_start, max(t) AS t_end, {peak} AS peak_value, {over} AS exceedance FROM {name}_i GROUP BY drive, run HAVING max(t) - min(t) >= {least})"""


_BRAKE = _islands("hard_brake", "coalesce(ax_mps2 < -3 AND v_mps > 3, false)", 0.3, 0.1, "min(ax_mps2)", "-3 - min(ax_mps2)")
_LATERAL = _islands("side_pull", "coalesce(abs(ay_mps2) > 4, false)", 0.2, 0.1, "arg_max(ay_mps2, (abs(ay_mps2), -t))", "max(abs(ay_mps2)) - 4")
_ACCEL = _islands("hard_accel", "coalesce(ax_mps2 > 5, false)", 0.2, 0.05, "max(ax_mps2)", "max(ax_mps2) - 5")
_OUT = "drive, event_type, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, round(peak_value, 6) AS peak_value, round(exceedance, 6) AS exceedance"


def _rounded(df):
    return df.select("drive", "event_type", *(F.round(c, 6).alias(c) for c in ("t_start", "t_end", "peak_value", "exceedance")))


@query(f"WITH {TICKS}, {_BRAKE}, {_LATERAL}, {_ACCEL} SELECT {_OUT} FROM (FROM hard_brake UNION ALL FROM side_pull UNION ALL FROM hard_accel)")
def threshold_events(spark, sf):
    return _rounded(_events(spark, sf, "hard_brake", "side_pull", "hard_accel"))


@query(f"""WITH {TICKS}, e AS (SELECT *, abs_flag > 0.5 AS high, lag(abs_flag > 0.5) OVER (PARTITION BY drive ORDER BY tick) AS before FROM ticks), r AS (SELECT *, sum(CASE WHEN high AND before IS DISTINCT FROM true THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY tick) AS run FROM e)
SELECT drive, 'abs_active' AS event_type, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, 1.0 :: DOUBLE AS peak_value, 1.0 :: DOUBLE AS exceedance FROM r WHERE high GROUP BY drive, run HAVING min(tick) > 0""")
def rising_events(spark, sf):
    return _rounded(_events(spark, sf, "abs_active"))


_AGREE = """ag_m AS (SELECT *, coalesce(bool_or(abs(steer_deg) > 60) OVER x, false) AND coalesce(bool_or(abs(yaw_dps) > 12) OVER x, false) AS m FROM ticks WINDOW x AS (PARTITION BY drive ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
ag_g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive ORDER BY tick) > 0.2 THEN 1 ELSE 0 END AS nw FROM ag_m WHERE m), ag_i AS (SELECT *, sum(nw) OVER (PARTITION BY drive ORDER BY tick) AS run FROM ag_g), ag_s AS (SELECT drive, run, min(t) AS t_start, max(t) AS t_end FROM ag_i GROUP BY drive, run HAVING max(t) - min(t) >= 0.1),
agree AS (SELECT s.drive, 'agree' AS event_type, s.t_start, s.t_end, arg_max(k.steer_deg, (abs(k.steer_deg), -k.t)) AS peak_value, max(abs(k.steer_deg)) - 60 AS exceedance FROM ag_s s JOIN ticks k ON k.drive = s.drive AND k.t BETWEEN s.t_start AND s.t_end GROUP BY s.drive, s.run, s.t_start, s.t_end)"""


@query(f"WITH {TICKS}, {_AGREE} SELECT {_OUT} FROM agree")
def agreement_events(spark, sf):
    return _rounded(_events(spark, sf, "agree"))


@query(f"""WITH {TICKS}, {_BRAKE}, {_LATERAL}, {_ACCEL}, {_AGREE}, o AS (SELECT drive, event_type AS b_type, t_start AS s, t_end AS e FROM hard_brake UNION ALL SELECT drive, event_type, t_start, t_end FROM hard_accel UNION ALL SELECT drive, event_type, t_start, t_end FROM agree),
j AS (SELECT b.drive, b.t_start, b.t_end, count(DISTINCT o.b_type) AS n FROM side_pull b JOIN o ON o.drive = b.drive AND o.s <= b.t_end + 0.2 AND o.e >= b.t_start - 0.2 GROUP BY b.drive, b.t_start, b.t_end)
SELECT drive, 'pull_and_more' AS event_type, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, n :: DOUBLE AS peak_value, n - 1.0 :: DOUBLE AS exceedance FROM j""")
def cooccurrence_events(spark, sf):
    return _rounded(_events(spark, sf, "hard_brake", "side_pull", "hard_accel", "agree", "pull_and_more").filter("event_type = 'pull_and_more'"))


@query()
def sequence_events(spark, sf):
    """The greedy matching of a first and a then event, compared by tests with a loop."""
    return _rounded(_events(spark, sf, "hard_brake", "side_pull", "agree", "turn_then_brake").filter("event_type = 'turn_then_brake'"))


@query()
def all_events(spark, sf):
    """Every event of the rule set, one row an event with all its fields."""
    return _events(spark, sf)


@query("SELECT 'no_column' AS rule, 'missing_feature:not_there' AS reason, count(*) AS ticks FROM events")
def skipped_rules(spark, sf):
    t = ticks(spark, sf)
    lost = spark.createDataFrame(ru.skipped(t.columns, RULES), "rule string, reason string")
    return lost.join(F.broadcast(t.agg(F.count("*").alias("ticks"))), F.lit(True))


#: Padding and gap fitted to drives of a few seconds.
SCORING = {"window_pad_s": 0.3, "merge_gap_s": 0.2, "max_severity_per_event": 1.4, "cooccurrence_bonus": 0.5}
_THREE = "ev AS (SELECT *, 1.0 AS weight, 3.0 AS threshold FROM hard_brake UNION ALL SELECT *, 1.5, 4.0 FROM side_pull UNION ALL SELECT *, 1.0, 5.0 FROM hard_accel)"
_CAND = f"""{_BRAKE}, {_LATERAL}, {_ACCEL}, {_THREE}, pe AS (SELECT *, t_start - 0.3 AS s, t_end + 0.3 AS e FROM ev), me AS (SELECT *, max(e) OVER (PARTITION BY drive ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM pe),
gr AS (SELECT *, sum(CASE WHEN s - le <= 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM me), ty AS (SELECT drive, g, event_type, max(weight * least(1 + greatest(exceedance, 0) / threshold, 1.4)) AS sev, count(*) AS n, min(s) AS s, max(e) AS e, max(ROW(weight * (1 + greatest(exceedance, 0) / threshold), -t_start, (t_start + t_end) / 2)) AS best FROM gr GROUP BY drive, g, event_type),
cand AS (SELECT drive, g, greatest(min(s), t0) AS t_start, least(max(e), t1) AS t_end, sum(sev) + 0.5 * (count(*) - 1) AS severity, sum(n) AS n_events, list_sort(list(event_type)) AS types, max(best) AS best FROM ty JOIN (SELECT drive, min(t) AS t0, max(t) AS t1 FROM ticks GROUP BY drive) USING (drive) GROUP BY drive, g, t0, t1)"""


def _candidates(spark, sf):
    t = ticks(spark, sf)
    ev = _events(spark, sf, "hard_brake", "side_pull", "hard_accel")
    return cd.build(ev, t.groupBy("drive").agg(F.min("t").alias("t0"), F.max("t").alias("t1")), "drive", SCORING)


@query(f"WITH {TICKS}, {_CAND} SELECT drive, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, round(severity, 6) AS severity, n_events :: BIGINT AS n_events, array_to_string(types, '|') AS event_types, round(best[3], 6) AS t_peak FROM cand")
def candidate_intervals(spark, sf):
    return _candidates(spark, sf).select("drive", *(rounded(c, 6).alias(c) for c in ("t_start", "t_end", "severity")), "n_events", F.array_join("event_types", "|").alias("event_types"), rounded("t_peak", 6).alias("t_peak"))


@query(f"""WITH {TICKS}, {_CAND} SELECT c.drive, round(c.t_start, 6) AS t_start, round(avg(v_mps), 6) AS v_mps_mean, min(ax_mps2) AS ax_mps2_min, round(arg_max(yaw_dps, (abs(yaw_dps), -t)) FILTER (WHERE yaw_dps IS NOT NULL), 6) AS yaw_dps_absmax FROM cand c JOIN ticks k ON k.drive = c.drive AND k.t BETWEEN c.t_start AND c.t_end GROUP BY c.drive, c.g, c.t_start""")
def candidate_context(spark, sf):
    c = _candidates(spark, sf)
    x = cd.context(c, ticks(spark, sf), "drive", "t", [("v_mps", "mean"), ("ax_mps2", "min"), ("yaw_dps", "absmax"), ("not_there", "max")], 1.0)
    return x.join(c.select("drive", "group", "t_start"), ["drive", "group"]).select("drive", rounded("t_start", 6).alias("t_start"), rounded("v_mps_mean", 6).alias("v_mps_mean"), "ax_mps2_min", rounded("yaw_dps_absmax", 6).alias("yaw_dps_absmax"))


@query(f"""WITH {TICKS}, {_CAND} SELECT drive, round(t_start, 6) AS t_start, CASE WHEN list_contains(types, 'hard_brake') THEN 0 WHEN len(list_filter(types, lambda x: x <> 'hard_accel')) = 0 THEN 3 WHEN len(types) > 1 THEN 1 ELSE 2 END AS tier, len(types) * (len(types) - 1) // 2 AS n_pairs FROM cand""")
def candidate_priority(spark, sf):
    return cd.priority(_candidates(spark, sf), ["hard_brake"], ["hard_accel"]).select("drive", rounded("t_start", 6).alias("t_start"), "tier", F.size("pairs").cast("long").alias("n_pairs"))


@query(f"WITH {TICKS}, {_BRAKE}, {_LATERAL}, {_ACCEL}, {_THREE} SELECT a.event_type AS a, b.event_type AS b, count(DISTINCT (a.drive, a.t_start, a.t_end)) AS n FROM ev a JOIN ev b ON a.drive = b.drive AND a.event_type <> b.event_type AND b.t_start <= a.t_end + 0.2 AND b.t_end >= a.t_start - 0.2 GROUP BY 1, 2")
def event_pair_counts(spark, sf):
    return cd.pair_counts(_events(spark, sf, "hard_brake", "side_pull", "hard_accel"), "drive", 0.2, 1.0)


@query(f"""WITH {TICKS}, {_CAND}, h AS (SELECT *, severity > 3 AS big, n_events >= 2 AND (severity > 2 OR t_end - t_start > 1.2) AS many FROM cand)
SELECT drive, round(t_start, 6) AS t_start, concat_ws('|', CASE WHEN big THEN 'strong' END, CASE WHEN many AND (list_contains(types, 'side_pull')) THEN 'busy' END) AS reasons, big OR (many AND list_contains(types, 'side_pull')) AS keep FROM h""")
def priority_rules(spark, sf):
    c = _candidates(spark, sf).withColumn("strong", (F.col("severity") > 3).cast("double")).withColumn("length", F.col("t_end") - F.col("t_start"))
    r = [{"name": "busy", "all_of": [{"feature": "n_events", "op": "ge", "threshold": 2}], "any_of": [{"feature": "severity", "op": "gt", "threshold": 2}, {"feature": "length", "op": "gt", "threshold": 1.2}]}]
    return cd.apply_rules(c, ["strong"], r, ["side_pull"]).select("drive", rounded("t_start", 6).alias("t_start"), "reasons", "keep")


_CODES = "r AS (SELECT value > 250 AS a, event_type = 'click' AS b, event_id % 3 = 0 AS c, event_id % 7 = 0 AS y FROM events), x AS (SELECT 'big' AS rule, a AS m, y FROM r UNION ALL SELECT 'click', b, y FROM r UNION ALL SELECT 'third', c, y FROM r UNION ALL SELECT 'big & click', a AND b, y FROM r UNION ALL SELECT 'big & third', a AND c, y FROM r UNION ALL SELECT 'click & third', b AND c, y FROM r UNION ALL SELECT 'big & click & third', a AND b AND c, y FROM r)"


@query(f"WITH {_CODES} SELECT rule, count(*) AS n, CAST(sum(y::INT) AS BIGINT) AS hits, round(avg(y::INT), 6) AS precision, round(sum(y::INT) / (SELECT sum((event_id % 7 = 0)::INT) FROM events), 6) AS recall FROM x WHERE m GROUP BY rule")
def rule_search(spark, sf):
    s = signals(spark, sf)
    parts = {"big": F.col("v") > 250, "click": F.col("channel") == "click", "third": F.col("event_id") % 3 == 0}
    out = cd.rule_search(s, parts, F.col("event_id") % 7 == 0)
    return out.select("rule", "n", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH c AS (SELECT event_id, value, event_type FROM events), t AS (SELECT 'high' AS "case", event_id, value FROM c WHERE value > 400 UNION ALL SELECT 'buy', event_id, value FROM c WHERE event_type = 'purchase')
SELECT "case", event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY value DESC, event_id) AS r FROM t) WHERE r <= 5""")
def top_per_case(spark, sf):
    s = signals(spark, sf)
    return cd.top_per_case(s, {"high": F.col("v") > 400, "buy": F.col("channel") == "purchase"}, 5, [F.desc("v"), F.col("event_id")]).select("case", "event_id", "rank")


@query(f"""WITH {TICKS}, {_CAND}, rare AS (SELECT event_type, count(*) AS n FROM ev GROUP BY event_type), m AS (SELECT c.drive, c.t_start, min(ROW(r.n, e.t_start, e.event_type, (e.t_start + e.t_end) / 2)) AS b FROM cand c JOIN ev e ON e.drive = c.drive AND e.t_start <= c.t_end AND e.t_end >= c.t_start JOIN rare r ON r.event_type = e.event_type GROUP BY c.drive, c.g, c.t_start)
SELECT drive, round(t_start, 6) AS t_start, round(b[4], 6) AS focus, b[3] AS focus_type FROM m""")
def focus_points(spark, sf):
    ev = _events(spark, sf, "hard_brake", "side_pull", "hard_accel")
    c = _candidates(spark, sf)
    return cd.focus_points(ev, c, "drive", 1.0).join(c.select("drive", "group", "t_start"), ["drive", "group"]).select("drive", rounded("t_start", 6).alias("t_start"), rounded("focus", 6).alias("focus"), "focus_type")


@query("""WITH a AS (SELECT event_type, count(*) AS n_a FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type, count(*) AS n_b FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS channel, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_b, 0) - coalesce(n_a, 0) AS delta FROM a FULL JOIN b ON a.event_type = b.event_type""")
def run_difference(spark, sf):
    s = signals(spark, sf)
    return cd.run_diff(s.filter("event_id % 2 = 0 and channel <> 'view'"), s.filter("event_id % 3 = 0"), ["channel"])


@query("""WITH o AS (SELECT event_id, event_type, user_id % 5 AS g, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY value DESC, event_id) AS turn FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY turn, g) AS pick FROM o)
SELECT event_type AS channel, event_id, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 12""")
def round_robin_samples(spark, sf):
    s = signals(spark, sf).withColumn("g", F.col("drive") % 5)
    return cd.round_robin(s, "channel", ["g"], 12, [F.desc("v"), F.col("event_id")]).select("channel", "event_id", "pick")


@query("""WITH r AS (SELECT epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e, value > 100 AS a, value > 250 AS b, event_type = 'error' AS c, event_id % 5 = 0 AS y FROM events)
SELECT 'rules' AS stage, count(*) AS n, round(sum(e - s) / 3600, 4) AS hours, CAST(sum(y::INT) AS BIGINT) AS positives FROM r WHERE a UNION ALL SELECT 'severity', count(*), round(sum(e - s) / 3600, 4), CAST(sum(y::INT) AS BIGINT) FROM r WHERE a AND b UNION ALL SELECT 'priority', count(*), round(sum(e - s) / 3600, 4), CAST(sum(y::INT) AS BIGINT) FROM r WHERE a AND b AND c""")
def stage_funnel(spark, sf):
    s = signals(spark, sf).select(F.col("t").alias("t_start"), (F.col("t") + F.col("v")).alias("t_end"), "v", "channel", "event_id")
    out = cd.funnel(s, {"rules": F.col("v") > 100, "severity": F.col("v") > 250, "priority": F.col("channel") == "error"}, F.col("event_id") % 5 == 0)
    return out.select("stage", "n", F.round("hours", 4).alias("hours"), "positives")


@query()
def shipped_rules(spark, sf):
    """The shipped rule set over the ticks, their columns renamed to the feature table's; rules whose features the ticks lack are skipped."""
    t = ticks(spark, sf).withColumnsRenamed({"ay_mps2": "ay_can_mps2", "abs_flag": "abs_active_flag", "vsc_flag": "vsc_active_flag", "yaw_dps": "yaw_rate_dps"})
    t = t.withColumns({"ay_kin_mps2": F.col("v_mps") * F.radians("yaw_rate_dps"), "net_heading_win_deg": F.abs("yaw_rate_dps") / 2, "steer_rate_dps": F.col("steer_deg"), "thw_s": F.col("lead_m") / F.greatest("v_mps", F.lit(1.0))})
    return ru.detect(t, ru.SHIPPED).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("exceedance"), 6).alias("most"))
