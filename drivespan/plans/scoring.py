"""Queries of scores and flags of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import islands, scoring as sc
from drivespan.plans.align import _PLACES
from drivespan.plans.base import DT, SIG, TICKS, query, rounded, signals, ticks
from drivespan.plans.chains import _EVENTS, _brakes
from drivespan.plans.places import _points

_H, _R, _P = "abs(ax_mps2)", "abs(yaw_dps) / 5", "abs(ay_mps2)"
_A = f"sqrt(coalesce({_H}, 0) * greatest(coalesce({_R}, 0), coalesce({_P}, 0)))"


def _marks(spark, sf):
    """Signals as events of two seconds: (drive, id, t_start, t_end, score)."""
    return signals(spark, sf).select("drive", F.col("event_id").alias("id"), F.col("t").alias("t_start"), (F.col("t") + 2.0 + F.col("v")).alias("t_end"), F.col("v").alias("score"))


_MARKS = "marks AS (SELECT user_id AS drive, event_id AS id, epoch_us(ts) / 1e6 AS t_start, epoch_us(ts) / 1e6 + 2.0 + value AS t_end, value AS score FROM events)"


@query(f"WITH {TICKS} SELECT drive, tick, round({_A}, 5) AS a FROM ticks")
def disturbance_score(spark, sf):
    a = sc.disturbance(F.abs("ax_mps2"), F.abs("yaw_dps") / 5, F.abs("ay_mps2"))
    return ticks(spark, sf).select("drive", "tick", F.round(a, 5).alias("a"))


@query(f"""WITH RECURSIVE {_MARKS}, o AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY t_start, t_end, score) AS i FROM marks),
k AS (SELECT drive, i, i AS kept, t_end, score FROM o WHERE i = 1 UNION ALL
SELECT o.drive, o.i, CASE WHEN o.t_start > k.t_end + 30 OR o.score > k.score THEN o.i ELSE k.kept END, CASE WHEN o.t_start > k.t_end + 30 OR o.score > k.score THEN o.t_end ELSE k.t_end END, CASE WHEN o.t_start > k.t_end + 30 OR o.score > k.score THEN o.score ELSE k.score END FROM k JOIN o ON o.drive = k.drive AND o.i = k.i + 1),
n AS (SELECT k.drive, k.kept, lead(k.kept) OVER (PARTITION BY k.drive ORDER BY k.i) AS nxt, lead(o.t_start) OVER (PARTITION BY k.drive ORDER BY k.i) AS s, k.t_end FROM k JOIN o ON o.drive = k.drive AND o.i = k.i)
SELECT o.drive, o.id, round(o.score, 5) AS score FROM n JOIN o ON o.drive = n.drive AND o.i = n.kept WHERE n.nxt IS NULL OR (n.nxt <> n.kept AND n.s > n.t_end + 30)""")
def strongest_of_overlaps(spark, sf):
    return sc.strongest_of_overlaps(_marks(spark, sf), "drive", "score", 30.0).select("drive", "id", F.round("score", 5).alias("score"))


@query(f"""WITH RECURSIVE {TICKS}, z AS (SELECT 'along' AS set, drive, t, tick, least(ay_mps2 / 2, yaw_dps / 8) AS z FROM ticks WHERE v_mps > 10 AND ay_mps2 IS NOT NULL UNION ALL SELECT 'against', drive, t, tick, least(-ay_mps2 / 2, -yaw_dps / 8) FROM ticks WHERE v_mps > 10 AND ay_mps2 IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN tick - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY set, drive ORDER BY tick) AS run FROM (SELECT *, lag(tick) OVER (PARTITION BY set, drive ORDER BY tick) AS p FROM z WHERE z >= 0.6)),
r AS (SELECT set, drive, min(t) AS t_start, max(t) AS t_end, arg_max(t, (z, -t)) AS t_peak, max(z) AS z FROM g GROUP BY set, drive, run), o AS (SELECT *, row_number() OVER (PARTITION BY set, drive ORDER BY t_start) AS i FROM r),
k AS (SELECT set, drive, i, t_end AS e, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.set, o.drive, o.i, CASE WHEN o.t_start > k.e + 1 THEN o.t_end ELSE k.e END, o.t_start > k.e + 1 FROM k JOIN o ON o.set = k.set AND o.drive = k.drive AND o.i = k.i + 1)
SELECT o.set, o.drive, round(o.t_start, 5) AS t_start, round(o.t_peak, 5) AS t_peak, round(o.t_end, 5) AS t_end, round(o.z, 5) AS z FROM k JOIN o ON o.set = k.set AND o.drive = k.drive AND o.i = k.i WHERE k.kept""")
def gust_peaks(spark, sf):
    t = ticks(spark, sf).withColumns({"z1": F.col("ay_mps2") / 2, "z2": F.col("yaw_dps") / 8})
    fast = F.col("v_mps") > 10
    out = sc.gust_peaks(t, "drive", "t", "z1", "z2", {"along": (fast, F.lit(1)), "against": (fast, F.lit(-1))}, 0.6, 1.0, DT)
    return out.select("set", "drive", *(rounded(c, 5).alias(c) for c in ("t_start", "t_peak", "t_end", "z")))


@query(f"""WITH {TICKS}, {_EVENTS}, g AS (SELECT *, sum(CASE WHEN tick - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY tick) AS run FROM (SELECT *, lag(tick) OVER (PARTITION BY drive ORDER BY tick) AS p FROM ticks WHERE ax_mps2 < 1 AND abs(ay_mps2) - abs(v_mps * radians(yaw_dps)) >= 0.5)),
r AS (SELECT drive, min(t) AS a, max(t) AS b, count(*) AS n FROM g GROUP BY drive, run HAVING max(t) - min(t) >= 0.1) SELECT r.drive, round(a, 5) AS t_start, round(b, 5) AS t_end, r.n, (SELECT count(*) FROM ev WHERE ev.drive = r.drive AND ev.t_start <= r.b AND ev.t_end >= r.a) AS events FROM r""")
def divergence_windows(spark, sf):
    c = F.col
    out = sc.divergence_windows(ticks(spark, sf), _brakes(spark, sf), "drive", "t", c("ax_mps2") < 1, c("ay_mps2"), c("v_mps") * F.radians("yaw_dps"), 0.5, DT, 0.1, 5.0)
    return out.select("drive", F.round("t_start", 5).alias("t_start"), F.round("t_end", 5).alias("t_end"), "n", "events")


@query(f"WITH {TICKS} SELECT drive, round(avg(vsc_flag), 9) AS engaged FROM ticks GROUP BY drive")
def engagement_ratio(spark, sf):
    return sc.engagement_ratio(ticks(spark, sf), ["drive"], ["op_engaged", "vsc_flag"]).select("drive", F.round("engaged", 9).alias("engaged"))


@query(f"WITH {_MARKS} SELECT a.drive, a.id AS a, b.id AS b, round(greatest(a.t_start, b.t_start) - least(a.t_end, b.t_end), 4) AS gap FROM marks a JOIN marks b ON b.drive = a.drive AND a.id < b.id AND greatest(a.t_start, b.t_start) - least(a.t_end, b.t_end) <= 20")
def linked_positives(spark, sf):
    return sc.linked_positives(_marks(spark, sf), "drive", 20.0, 120.0).withColumn("gap", F.round("gap", 4))


@query(f"""WITH {TICKS}, {_EVENTS}, c AS (SELECT e.id, avg(k.v_mps) AS v_mean, min(k.ax_mps2) AS ax_min, max(k.gas_pct) AS gas_max, max(k.abs_flag) AS abs_max FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start AND e.t_end GROUP BY e.id),
f AS (SELECT id, coalesce(v_mean >= 12, false) AS speed_ok, coalesce(ax_min < -5.5, false) OR coalesce(gas_max > 0, false) AS reaction, coalesce(abs_max > 0.5, false) AS safety FROM c) SELECT *, true AS forward, speed_ok AND (reaction OR safety) AS t1, speed_ok AS t2 FROM f""")
def target_flags(spark, sf):
    from drivespan.operators.joins import points_in

    e = _brakes(spark, sf).select("drive", "id", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    c = points_in(ticks(spark, sf), e, "drive", "t", 1.0).groupBy("id").agg(F.avg("v_mps").alias("v_mean"), F.min("ax_mps2").alias("ax_min"), F.max("gas_pct").alias("gas_max"), F.max("abs_flag").alias("abs_max"))
    out = sc.target_flags(c.withColumn("event_types", F.array(F.lit("hard_brake"))), 12.0, -5.5, 100.0, ["abs_max", "vsc_max"], ["hard_brake"])
    return out.select("id", "speed_ok", "reaction", "safety", "forward", "t1", "t2")


@query(f"""WITH {TICKS}, {_EVENTS} SELECT e.id, round(min(k.ax_mps2), 5) AS ax_min, round(max(k.ax_mps2), 5) AS ax_max, round(max(abs(k.ay_mps2)), 5) AS ay_absmax, round(max(abs(k.yaw_dps)), 5) AS yaw_absmax, round(max(k.steer_deg) - min(k.steer_deg), 5) AS steer_range, round(max(abs(k.steer_deg)), 5) AS steer_absmax
FROM ev e LEFT JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start AND e.t_end GROUP BY e.id""")
def label_reactions(spark, sf):
    out = sc.label_reactions(ticks(spark, sf), _brakes(spark, sf), "drive", "t", 1.0, "ax_mps2", "ay_mps2", "yaw_dps", "steer_deg")
    return out.select("id", *(F.round(c, 5).alias(c) for c in out.columns if c != "id"))


_IMPULSE = f"""{TICKS}, {_EVENTS}, rt AS (SELECT drive, t, round(ax_mps2, 4) AS ax_mps2, round(yaw_dps, 4) AS yaw_dps, round(v_mps, 4) AS v_mps FROM ticks), n AS (SELECT e.id, e.drive, arg_max(k.t, (abs(k.ax_mps2), -k.t)) AS tp, max(abs(k.ax_mps2)) AS heave_peak FROM ev e JOIN rt k ON k.drive = e.drive AND k.t BETWEEN e.t_start - 0.5 AND e.t_start + 1.0 WHERE k.ax_mps2 IS NOT NULL GROUP BY e.id, e.drive),
w AS (SELECT n.*, k.t, k.ax_mps2 AS h, k.yaw_dps AS r, k.v_mps AS e, (SELECT v_mps FROM rt x WHERE x.drive = n.drive AND x.t = n.tp) AS ep FROM n JOIN rt k ON k.drive = n.drive AND k.t BETWEEN n.tp - 1.5 AND n.tp + 1.5),
f AS (SELECT id, heave_peak, max(abs(r)) AS roll_peak, arg_max(t, (abs(r), -t)) - tp AS dt, least(sum(CASE WHEN abs(t - tp) <= 0.3 THEN h * h END) / sum(h * h), sum(CASE WHEN abs(t - tp) <= 0.3 THEN r * r END) / sum(r * r)) AS concentration, coalesce(tp - max(CASE WHEN t < tp AND e <= 0.25 * ep THEN t END), 1.5) AS rise FROM w GROUP BY id, heave_peak, tp)"""


def _impulse(spark, sf):
    hits = _brakes(spark, sf).select("drive", "id", F.col("t_start").alias("t_hit"))
    t = ticks(spark, sf).select("drive", "t", *(F.round(c, 4).alias(c) for c in ("ax_mps2", "yaw_dps", "v_mps")))  # equal peaks are then equal in both engines
    return sc.impulsive_response(t, hits, "drive", "t", "ax_mps2", "yaw_dps", 1.5, 0.3, (-0.5, 1.0), 0.25, "v_mps", 2.0)


@query(f"WITH {_IMPULSE} SELECT id, round(heave_peak, 5) AS heave_peak, round(roll_peak, 5) AS roll_peak, round(dt, 5) AS dt, round(concentration, 6) AS concentration, round(rise, 5) AS rise FROM f")
def impulsive_response(spark, sf):
    out = _impulse(spark, sf)
    return out.select("id", *(F.round(c, 6 if c == "concentration" else 5).alias(c) for c in out.columns if c != "id"))


@query(f"""WITH {_IMPULSE}, p AS (SELECT *, (rank() OVER (ORDER BY heave_peak) + (count(*) OVER (PARTITION BY heave_peak) - 1) / 2) / count(*) OVER () AS hp, (rank() OVER (ORDER BY roll_peak) + (count(*) OVER (PARTITION BY roll_peak) - 1) / 2) / count(*) OVER () AS rp FROM f)
SELECT id, round(hp, 8) AS heave_pct, round(rp, 8) AS roll_pct, round(100 * sqrt(hp * rp) * least(greatest(concentration, 0), 1) * CASE WHEN roll_peak >= 18 THEN 1.0 ELSE 0.5 END, 5) AS score FROM p""")
def impulsive_score(spark, sf):
    out = sc.impulsive_score(_impulse(spark, sf).withColumn("wheel", F.col("roll_peak")), "wheel", 18.0, 0.5)
    return out.select("id", F.round("heave_pct", 8).alias("heave_pct"), F.round("roll_pct", 8).alias("roll_pct"), F.round("score", 5).alias("score"))


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2) / count(*) OVER ()"


@query(f"""WITH s AS (SELECT user_id AS site, max(value) AS peak, count(*) AS n, avg((event_type = 'error')::INT) AS errors FROM events GROUP BY 1), p AS (SELECT *, 100 * ({_RANK.format("peak")} + {_RANK.format("n")}) / 2 AS vibration FROM s),
f AS (SELECT *, peak >= 200 AND NOT errors > 0.25 AS flag_a, n >= 66 AS flag_b, errors >= 0.2 AS flag_c FROM p)
SELECT site, flag_a, flag_b, flag_c, flag_a::INT + flag_b::INT + flag_c::INT AS n_flags, round(vibration, 6) AS vibration, row_number() OVER (ORDER BY flag_a::INT + flag_b::INT + flag_c::INT DESC, vibration DESC, site) AS rank FROM f""")
def flagged_sites(spark, sf):
    s = signals(spark, sf).groupBy(F.col("drive").alias("site")).agg(F.max("v").alias("peak"), F.count("*").alias("n"), F.avg((F.col("channel") == "error").cast("int")).alias("errors"))
    s = sc.mean_percent(s, ["peak", "n"], "vibration")
    c = F.col
    out = sc.flag_and_rank(s, {"flag_a": c("peak") >= 200, "flag_b": c("n") >= 66, "flag_c": c("errors") >= 0.2}, c("errors") > 0.25, ["flag_a"], [F.desc("vibration"), F.asc("site")])
    return out.select("site", "flag_a", "flag_b", "flag_c", "n_flags", F.round("vibration", 6).alias("vibration"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TICKS}, b AS (SELECT drive, tick, CASE WHEN sign(ay_mps2) = sign(steer_deg) THEN least(abs(ay_mps2), 6) ELSE 0 END + CASE WHEN sign(yaw_dps / 4) = sign(steer_deg) THEN 0.5 * least(abs(yaw_dps / 4), 6) ELSE 0 END AS b, abs(yaw_dps) > 15 AS turning, lead_id, lead_m / 60 AS share, sign(steer_deg) * ax_mps2 / 8 AS w FROM ticks)
SELECT drive, tick, round(b * CASE WHEN turning THEN 0.5 ELSE 1 END * CASE WHEN lead_id >= 5 THEN 1 - coalesce(share, 0.5) ELSE 0.5 END * coalesce(least(greatest(w, 0), 1), 0), 10) AS score FROM b""")
def wind_score(spark, sf):
    c = F.col
    s = sc.wind_score(F.signum("steer_deg"), [(c("ay_mps2"), 1.0), (c("yaw_dps") / 4, 0.5)], F.abs("yaw_dps") > 15, c("lead_id"), c("lead_m") / 60, c("ax_mps2"))
    return ticks(spark, sf).select("drive", "tick", F.round(s, 10).alias("score"))


@query(f"""WITH {TICKS}, {_EVENTS}, c AS (SELECT id, drive, t_start AS tp, 1.0 - 2 * (drive % 2) AS pol FROM ev), m AS (SELECT c.id, c.pol, k.steer_deg AS s, k.t - c.tp AS d FROM c JOIN ticks k ON k.drive = c.drive AND k.t BETWEEN c.tp - 2 AND c.tp + 1.5)
SELECT id, round(max(pol * s) FILTER (WHERE d BETWEEN 0.3 AND 1.5) - any_value(pol) * quantile_cont(s, 0.5) FILTER (WHERE d BETWEEN -2 AND -0.5), 5) AS steer_back FROM m GROUP BY id""")
def corrective_steer(spark, sf):
    c = _brakes(spark, sf).select("drive", "id", F.col("t_start").alias("t_peak"), (1.0 - 2 * (F.col("drive") % 2)).alias("polarity"))
    return sc.corrective_steer(ticks(spark, sf), c, "drive", "t", "steer_deg", (-2.0, -0.5), (0.3, 1.5), 2.0).withColumn("steer_back", F.round("steer_back", 5))


_LISTS = "list_filter([CASE WHEN event_type IN ({0}) THEN 'country=' || event_type END, CASE WHEN 'u' || user_id IN ({1}) THEN 'region=u' || user_id END, CASE WHEN value >= {2} THEN 'altitude=' || CAST(round(value) AS BIGINT) END, CASE WHEN abs(value / 5) >= {3} THEN 'latitude=' || CAST(round(abs(value / 5)) AS BIGINT) END], lambda x: x IS NOT NULL)"


@query(f"""WITH t AS (SELECT event_id, {_LISTS.format("'error'", "'u1', 'u2'", 120, 30)} AS a, {_LISTS.format("'view'", "'u3'", 60, 15)} AS b FROM events) SELECT event_id, CASE WHEN len(a) > 0 THEN 'heavy' WHEN len(b) > 0 THEN 'moderate' ELSE 'low' END AS tier, coalesce(array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, '+'), '') AS reasons FROM t""")
def cold_tiers(spark, sf):
    tier, reasons = sc.cold_tier(F.col("channel"), F.concat(F.lit("u"), "drive"), F.col("v"), F.col("v") / 5, {"countries": ["error"], "regions": ["u1", "u2"], "altitude": 120, "latitude": 30}, {"countries": ["view"], "regions": ["u3"], "altitude": 60, "latitude": 15})
    return signals(spark, sf).select("event_id", tier.alias("tier"), reasons.alias("reasons"))


_C = "least(greatest({}, 0), 1)"


@query(f"""WITH {TICKS}, p AS (SELECT drive, tick, v_mps / 31 AS w, abs(ay_mps2) / 30 AS c, gas_pct / 150 AS b, lead_m / 200 AS k, abs(yaw_dps) / 100 AS s, abs(steer_deg) / 150 AS v FROM ticks)
SELECT drive, tick, round(w * {_C.format("1 - c / 0.12")}, 6) AS snow, round(({_C.format("1 - c / 0.20")} + {_C.format("1 - b / 0.10")} + {_C.format("1 - k / 0.20")}) / 3, 6) AS gloom, round({_C.format("1 - s / 0.15")} * {_C.format("(v - 0.28) / 0.15")}, 6) AS wet, round({_C.format("c / 0.15")} * {_C.format("b / 0.25")} * {_C.format("k / 0.20")}, 6) AS clear, v < 0.25 AS dark FROM p WHERE c IS NOT NULL AND k IS NOT NULL""")
def appearance_scores(spark, sf):
    c = F.col
    s = sc.appearance_scores(c("v_mps") / 31, F.abs("ay_mps2") / 30, c("gas_pct") / 150, c("lead_m") / 200, F.abs("yaw_dps") / 100, F.abs("steer_deg") / 150)
    t = ticks(spark, sf).filter("ay_mps2 is not null and lead_m is not null")
    return t.select("drive", "tick", *(x.alias(n) if n == "dark" else F.round(x, 6).alias(n) for n, x in s.items()))


@query(f"""WITH {TICKS}, r AS (SELECT drive, tick, 2 * 1500 * abs(ay_mps2) / (1.2 * 2.2 * 2.5 * v_mps) / 0.9 AS lo, 2 * 1500 * abs(ay_mps2) / (1.2 * 2.2 * 1.5 * v_mps) / 0.6 AS hi, ax_mps2 * 20 AS w, 12.0 + gas_pct AS s, yaw_dps / 20 AS b FROM ticks WHERE v_mps > 5),
v AS (SELECT *, list_filter([CASE WHEN b BETWEEN 0.7 AND 1.3 THEN 'bank' END, CASE WHEN w + s < 0 THEN 'opposite' END, CASE WHEN w + s < lo / 3 THEN 'weak' END], lambda x: x IS NOT NULL) AS a FROM r)
SELECT drive, tick, round(lo, 4) AS least, round(hi, 4) AS most, CASE WHEN w IS NULL THEN 'unknown' WHEN len(a) > 0 THEN 'refute' WHEN coalesce(w > 0 AND w + s >= lo AND abs(b) < 0.3, false) THEN 'support' ELSE 'unknown' END AS verdict, CASE WHEN w IS NULL THEN 'no wind' ELSE coalesce(array_to_string(a, '+'), '') END AS reasons, CASE WHEN s < 30 THEN 'refute' ELSE 'unknown' END AS gust FROM v""")
def wind_judgements(spark, sf):
    c = F.col
    lo, hi = sc.required_wind(c("ay_mps2"), c("v_mps"), 1500, 1.2, 2.2, (1.5, 2.5), (0.6, 0.9))
    wind, spread = c("ax_mps2") * 20, c("gas_pct") + 12.0
    verdict, reasons = sc.judge_sustained(wind, spread, c("yaw_dps") / 20, lo, (0.7, 1.3), 0.3, 1 / 3)
    return ticks(spark, sf).filter("v_mps > 5").select("drive", "tick", F.round(lo, 4).alias("least"), F.round(hi, 4).alias("most"), verdict.alias("verdict"), reasons.alias("reasons"), sc.judge_gust(spread, 30.0).alias("gust"))
