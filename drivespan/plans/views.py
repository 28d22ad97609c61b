"""Queries of views of drives and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import drive_checks as ck, views as vw
from drivespan.plans.align import _PLACES
from drivespan.plans.base import DRAW, DT, RATE, SIG, TICKS, fir_sql, query, signals, ticks
from drivespan.plans.chains import _EVENTS, _brakes
from drivespan.plans.places import _points


@query(f"WITH {SIG}, l AS (SELECT DISTINCT drive FROM sig WHERE channel = 'error' AND v > 150) SELECT drive, CAST(floor(t / 3600) AS BIGINT) AS index, count(*) AS n, round(min(t), 4) AS t0, round(max(t), 4) AS t1 FROM sig WHERE drive IN (SELECT drive FROM l) GROUP BY 1, 2")
def segment_catalogue(spark, sf):
    s = signals(spark, sf)
    out = vw.segment_catalogue(s, "drive", "t", 3600.0, s.filter("channel = 'error' and v > 150"))
    return out.withColumns({"t0": F.round("t0", 4), "t1": F.round("t1", 4)})


@query(f"WITH {SIG} SELECT drive, CAST(floor(t / 600) AS BIGINT) AS bin, count(*) AS n FROM sig WHERE event_id & 64 <> 0 AND event_id % 5 IN (1, 3) GROUP BY 1, 2")
def controller_active(spark, sf):
    return vw.controller_active(signals(spark, sf), "drive", "t", F.col("event_id"), F.col("event_id") % 5, 64, [1, 3], 600.0)


@query(f"""WITH {SIG}, x AS (SELECT drive, t, event_id, CASE WHEN channel <> 'view' THEN v END AS x FROM sig), m AS (SELECT *, CASE WHEN count(x) OVER w >= 3 THEN quantile_cont(x, 0.5) OVER w END AS m FROM x WINDOW w AS (PARTITION BY drive ORDER BY t RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING)),
p AS (SELECT *, max(CASE WHEN m IS NOT NULL THEN t END) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING) AS at_, min(CASE WHEN m IS NOT NULL THEN t END) OVER (PARTITION BY drive ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bt FROM m)
SELECT p.event_id, p.m IS NULL AS filled, round(coalesce(p.m, a.m + (p.t - p.at_) / (p.bt - p.at_) * (b.m - a.m)), 5) AS median FROM p LEFT JOIN m a ON a.drive = p.drive AND a.t = p.at_ LEFT JOIN m b ON b.drive = p.drive AND b.t = p.bt""")
def rolling_time_median(spark, sf):
    s = signals(spark, sf).withColumn("x", F.when(F.col("channel") != "view", F.col("v")))
    return vw.rolling_time_median(s, "drive", "t", "x", 7200.0, 3).select("event_id", "filled", F.round("median", 5).alias("median"))


_CLASS = "CASE WHEN {0} IS NULL THEN NULL " + " ".join(f"WHEN {{0}} < {limit} THEN '{name}'" for limit, name in vw.COMFORT) + " ELSE 'extremely' END"


@query(f"""WITH {TICKS}, b AS (SELECT drive, tick, {fir_sql('ax_mps2', ck.iso_weight_taps(RATE, 2))} AS w FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)), r AS (SELECT *, sqrt(avg(w * w) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS r FROM b),
g AS (SELECT drive, sqrt(avg(w * w)) AS rms, max(r) AS mtvv, pow(sum(pow(w, 4)) / 20, 0.25) AS vdv FROM r GROUP BY drive) SELECT drive, round(rms, 6) AS rms, round(mtvv, 6) AS mtvv, round(vdv, 6) AS vdv, {_CLASS.format("rms")} AS comfort FROM g""")
def ride_comfort(spark, sf):
    out = vw.ride_comfort(ticks(spark, sf), "drive", "tick", "ax_mps2", ck.iso_weight_taps(RATE, 2), RATE, 21)
    return out.select("drive", F.round("rms", 6).alias("rms"), F.round("mtvv", 6).alias("mtvv"), F.round("vdv", 6).alias("vdv"), "comfort")


@query(f"""WITH {TICKS}, {_EVENTS}, g AS (SELECT e.id, sqrt(avg(ax_mps2 ** 2)) AS rms_x, pow(sum(pow(ax_mps2, 4)) / 20, 0.25) AS vdv_x, sqrt(avg(ay_mps2 ** 2)) AS rms_y, pow(sum(pow(ay_mps2, 4)) / 20, 0.25) AS vdv_y, max(abs(ax_mps2)) AS px, max(abs(ay_mps2)) AS py FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start AND e.t_end GROUP BY e.id)
SELECT id, round(rms_x, 6) AS rms_x, round(vdv_x, 6) AS vdv_x, round(rms_y, 6) AS rms_y, round(vdv_y, 6) AS vdv_y, CASE WHEN coalesce(round(vdv_y, 9) >= round(vdv_x, 9), vdv_x IS NULL) THEN round(py / rms_y, 6) ELSE round(px / rms_x, 6) END AS crest, CASE WHEN coalesce(round(vdv_y, 9) >= round(vdv_x, 9), vdv_x IS NULL) THEN 'y' ELSE 'x' END AS dominant FROM g""")
def event_ride(spark, sf):
    out = vw.event_ride(ticks(spark, sf), _brakes(spark, sf), "drive", "t", {"x": "ax_mps2", "y": "ay_mps2"}, RATE, 1.0)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("rms_x", "vdv_x", "rms_y", "vdv_y", "crest")), "dominant")


@query(f"WITH {TICKS}, g AS (SELECT drive, t, tick - row_number() OVER (PARTITION BY drive ORDER BY tick) AS g FROM ticks WHERE gas_pct > 30) SELECT drive, round(min(t), 4) AS start, round(max(t) + 0.05, 4) AS \"end\" FROM g GROUP BY drive, g")
def true_spans(spark, sf):
    out = vw.true_spans(ticks(spark, sf), F.col("gas_pct") > 30, "drive", "t", DT)
    return out.select("drive", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"WITH {TICKS}, b AS (SELECT drive, tick, (((steer_deg - yaw_dps + 180) % 360) + 360) % 360 - 180 AS b, abs(round(yaw_dps, 4)) < 4 AS st FROM ticks), z AS (SELECT drive, quantile_cont(b, 0.5) AS z FROM b WHERE st GROUP BY drive) SELECT b.drive, b.tick, round(b.b - z.z, 5) AS beta FROM b LEFT JOIN z ON z.drive = b.drive")
def zeroed_sideslip(spark, sf):
    return vw.zeroed_sideslip(ticks(spark, sf), "drive", F.col("steer_deg"), F.col("yaw_dps"), F.abs(F.round("yaw_dps", 4)) < 4).select("drive", "tick", F.round("beta", 5).alias("beta"))


@query(f"""WITH {TICKS} SELECT drive, CAST(floor(t / 2.0) AS BIGINT) AS win, count(*) AS n, round(max(ax_mps2) - min(ax_mps2), 5) AS ax_mps2_range, round(max(steer_deg) - min(steer_deg), 5) AS steer_deg_range, round(max(greatest(ws_fl, ws_fr, ws_rl, ws_rr) - least(ws_fl, ws_fr, ws_rl, ws_rr)), 5) AS wheel_gap, max((abs_flag > 0.5)::INT) AS abs_flag_up, max((vsc_flag > 0.5)::INT) AS vsc_flag_up, round(max(v_mps) * radians(max(abs(yaw_dps))), 5) AS ay_bound FROM ticks GROUP BY 1, 2""")
def window_table(spark, sf):
    out = vw.window_table(ticks(spark, sf), ["drive"], "t", 2.0, ["ax_mps2", "steer_deg"], ["ws_fl", "ws_fr", "ws_rl", "ws_rr"], ["abs_flag", "vsc_flag"], "v_mps", "yaw_dps")
    return out.select("drive", "win", "n", *(F.round(c, 5).alias(c) for c in ("ax_mps2_range", "steer_deg_range", "wheel_gap")), "abs_flag_up", "vsc_flag_up", F.round("ay_bound", 5).alias("ay_bound"))


@query(f"WITH {SIG}, e AS (SELECT event_id AS id, drive, t, t + 60 AS u FROM sig WHERE channel = 'view'), c AS (SELECT drive, t, t + 3600 AS u, event_id % 3 AS priority FROM sig WHERE channel = 'error') SELECT e.id, e.drive, min(c.priority) AS priority FROM e LEFT JOIN c ON c.drive = e.drive AND c.t <= e.u AND c.u >= e.t GROUP BY 1, 2")
def inherited_priority(spark, sf):
    s = signals(spark, sf)
    e = s.filter("channel = 'view'").select(F.col("event_id").alias("id"), "drive", F.col("t").alias("t_start"), (F.col("t") + 60).alias("t_end"))
    c = s.filter("channel = 'error'").select("drive", F.col("t").alias("t_start"), (F.col("t") + 3600).alias("t_end"), (F.col("event_id") % 3).alias("priority"))
    return vw.inherited_priority(e, c, "drive", 3600.0).select("id", "drive", "priority")


@query(f"""WITH {_PLACES}, m AS (SELECT a.vec_id AS id, b.vec_id AS review, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, abs(((a.hdg - b.hdg) % 360 + 360) % 360) AS h FROM p a JOIN p b ON b.label % 2 = 1 AND a.label % 2 = 0), n AS (SELECT id, arg_min(review, (d, review)) AS review, min(d) AS dist FROM m WHERE d <= 60 AND least(h, 360 - h) <= 40 GROUP BY id)
SELECT p.vec_id AS id, n.review, round(n.dist, 5) AS dist FROM p LEFT JOIN n ON n.id = p.vec_id WHERE p.label % 2 = 0""")
def attached_review(spark, sf):
    p = _points(spark, sf)
    r = p.filter("drive % 2 = 1").select(F.col("id").alias("review"), "x", "y", "hdg")
    return vw.attached_review(p.filter("drive % 2 = 0").select("id", "x", "y", "hdg"), r, "x", "y", "hdg", 60.0, 40.0).withColumn("dist", F.round("dist", 5))


@query(f"""WITH {SIG}, d AS (SELECT *, concat_ws(', ', CASE WHEN v > 100 THEN 'strong' END, CASE WHEN event_id % 2 = 0 THEN 'even' END) AS r FROM sig WHERE floor((t / 3600 + 9) % 24) >= 6 AND floor((t / 3600 + 9) % 24) < 18) SELECT drive, arg_max(event_id, (v, -event_id)) AS best, max(v) AS score, arg_max(r, (v, -event_id)) AS reason FROM d GROUP BY drive""")
def daytime_best(spark, sf):
    s = signals(spark, sf).withColumnRenamed("event_id", "id")
    return vw.daytime_best(s, "drive", "t", 9.0, (6, 18), "v", {"strong": F.col("v") > 100, "even": F.col("id") % 2 == 0})


@query(f"""WITH {SIG}, x AS (SELECT drive, floor(t / 60) AS m, max(v) AS v FROM sig WHERE channel = 'click' GROUP BY 1, 2), r AS (SELECT drive, t, v FROM sig WHERE channel = 'signup'), e AS (SELECT event_id, drive, t FROM sig WHERE channel = 'error'),
n AS (SELECT e.*, x.v AS exact, a.v AS av, a.t AS at_, b.v AS bv, b.t AS bt FROM e LEFT JOIN x ON x.drive = e.drive AND x.m = floor(e.t / 60) ASOF LEFT JOIN r a ON a.drive = e.drive AND e.t >= a.t ASOF LEFT JOIN r b ON b.drive = e.drive AND e.t <= b.t),
f AS (SELECT *, CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR bt - t < t - at_) THEN CASE WHEN bt - t <= 7200 THEN bv END ELSE CASE WHEN t - at_ <= 7200 THEN av END END AS near FROM n)
SELECT event_id, coalesce(exact, near) AS weather, CASE WHEN exact IS NOT NULL THEN 'minute' WHEN near IS NOT NULL THEN 'report' ELSE 'none' END AS source FROM f""")
def weather_with_fallback(spark, sf):
    s = signals(spark, sf)
    of = lambda c: s.filter(F.col("channel") == c)
    return vw.weather_with_fallback(of("error").select("event_id", "drive", "t"), of("click"), of("signup"), "drive", "t", "v", 7200.0).select("event_id", "weather", "source")


@query(f"WITH {SIG}, h AS (SELECT drive, (max(t) - min(t)) / 3600 AS hours FROM sig GROUP BY drive) SELECT h.drive, round(hours, 6) AS hours, count(*) FILTER (WHERE channel = 'error') AS n_error, count(*) FILTER (WHERE channel = 'view') AS n_view, round(count(*) FILTER (WHERE channel = 'error') / hours, 8) AS per_hour_error, round(count(*) FILTER (WHERE channel = 'view') / hours, 8) AS per_hour_view FROM h JOIN sig ON sig.drive = h.drive GROUP BY h.drive, hours")
def screening_pivot(spark, sf):
    s = signals(spark, sf)
    h = s.groupBy("drive").agg(((F.max("t") - F.min("t")) / 3600).alias("hours"))
    out = vw.screening_pivot(s, h, "drive", "channel", ["error", "view"])
    return out.select("drive", F.round("hours", 6).alias("hours"), "n_error", "n_view", *(F.round(f"per_hour_{k}", 8).alias(f"per_hour_{k}") for k in ("error", "view")))


@query(f"WITH {TICKS} SELECT drive, round(regr_slope(yaw_dps, steer_deg), 6) AS slope, round(avg(yaw_dps) FILTER (WHERE v_mps < 2), 6) AS stop_bias, round(quantile_cont(ws_rr / v_mps, 0.5) FILTER (WHERE v_mps > 5), 6) AS speed_ratio FROM ticks GROUP BY drive")
def signal_sanity(spark, sf):
    out = vw.signal_sanity(ticks(spark, sf), ["drive"], "yaw_dps", "steer_deg", "v_mps", "ws_rr", 2.0)
    return out.select("drive", *(F.round(c, 6).alias(c) for c in ("slope", "stop_bias", "speed_ratio")))


@query(f"WITH {TICKS} SELECT drive, round(quantile_cont(steer_deg, 0.5), 5) AS \"all\", round(quantile_cont(steer_deg, 0.5) FILTER (WHERE abs(round(yaw_dps, 4)) < 4), 5) AS straight, round((quantile_cont(steer_deg, 0.05) FILTER (WHERE NOT v_mps < 5) + quantile_cont(steer_deg, 0.95) FILTER (WHERE NOT v_mps < 5)) / 2, 5) AS symmetric FROM ticks GROUP BY drive")
def zero_offsets(spark, sf):
    out = vw.zero_offsets(ticks(spark, sf), "drive", "steer_deg", F.abs(F.round("yaw_dps", 4)) < 4, F.col("v_mps") < 5)
    return out.select("drive", *(F.round(c, 5).alias(c) for c in ("all", "straight", "symmetric")))


@query(f"WITH {SIG}, c AS (SELECT drive AS clip, max(t) - min(t) AS s FROM sig GROUP BY drive), a AS (SELECT drive AS clip, count(*) AS n, max(v) AS l, sum(v) AS x FROM sig WHERE channel = 'error' AND v > 60 GROUP BY drive) SELECT c.clip, coalesce(n, 0) AS episodes, coalesce(n, 0) > 0 AND coalesce(l, 0) < 150 AS flicker_only, round(coalesce(x, 0) / s, 9) AS alarm_share, round(coalesce(n, 0) * 60 / s, 9) AS per_minute FROM c LEFT JOIN a ON a.clip = c.clip")
def negative_clip_scores(spark, sf):
    s = signals(spark, sf).withColumnRenamed("drive", "clip")
    clips = s.groupBy("clip").agg((F.max("t") - F.min("t")).alias("seconds"))
    alarms = s.filter("channel = 'error' and v > 60").select("clip", F.lit(0.0).alias("t_start"), F.col("v").alias("t_end"))
    out = vw.negative_clip_scores(alarms, clips, "clip", "seconds", 150.0)
    return out.select("clip", "episodes", "flicker_only", F.round("alarm_share", 9).alias("alarm_share"), F.round("per_minute", 9).alias("per_minute"))


@query(f"""WITH {SIG}, c AS (SELECT event_id AS id, drive, floor(v / 50) AS b FROM sig WHERE channel = 'error'), m AS (SELECT event_id AS control, drive, floor(v / 50) AS b, max(abs(v)) OVER (PARTITION BY drive ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM sig), r AS (SELECT *, row_number() OVER (PARTITION BY drive, b ORDER BY {DRAW.format("'9:' || control")}, control) AS r FROM m WHERE m < 90),
p AS (SELECT c.id, r.control, row_number() OVER (PARTITION BY c.id ORDER BY r.r) AS pick FROM c JOIN r ON r.drive = c.drive AND r.b = c.b AND r.r <= 3 AND r.control <> c.id) SELECT * FROM p WHERE pick <= 2""")
def calm_controls(spark, sf):
    s = signals(spark, sf)
    cases = s.filter("channel = 'error'").select(F.col("event_id").alias("id"), "drive", "v")
    return vw.calm_controls(cases, s.withColumnRenamed("event_id", "control"), "drive", "control", "v", "v", 1, 90.0, 50.0, 2, 9).withColumn("pick", F.col("pick").cast("long"))


@query(f"WITH {_PLACES}, n AS (SELECT DISTINCT a.label AS drive, a.vec_id AS id FROM p a JOIN p b ON a.hdg < 0 AND b.hdg > 90 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY id) AS rank FROM n) SELECT * FROM r WHERE rank <= 5")
def even_calm_segments(spark, sf):
    p = _points(spark, sf)
    return vw.even_calm_segments(p.filter("hdg < 0").select("drive", "id", "x", "y"), p.filter("hdg > 90").select("x", "y"), "x", "y", "drive", 30.0, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {SIG}, s AS (SELECT drive, t, avg(v) OVER w AS v, coalesce(lead(t) OVER w2, t) - t AS gap FROM sig WHERE channel <> 'view' WINDOW w AS (PARTITION BY drive ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), w2 AS (PARTITION BY drive ORDER BY t)), g AS (SELECT event_id, drive, t FROM sig WHERE channel = 'view'),
m AS (SELECT g.*, a.t AS at_, a.v AS av, a.gap, b.t AS bt, b.v AS bv FROM g ASOF LEFT JOIN s a ON a.drive = g.drive AND g.t >= a.t ASOF LEFT JOIN s b ON b.drive = g.drive AND g.t <= b.t), x AS (SELECT *, av + CASE WHEN bt > at_ THEN (t - at_) / (bt - at_) ELSE 0 END * (bv - av) AS x FROM m)
SELECT event_id, round(x, 5) AS v, coalesce(x IS NOT NULL AND (at_ = t OR gap <= 7200), false) AS valid FROM x""")
def smoothed_resample(spark, sf):
    s = signals(spark, sf)
    out = vw.smoothed_resample(s.filter("channel = 'view'").select("event_id", "drive", "t"), s.filter("channel <> 'view'").select("drive", "t", "v"), "drive", "t", "v", 3, 7200.0)
    return out.select("event_id", F.round("v", 5).alias("v"), "valid")


@query(f"""WITH {SIG}, b AS (SELECT drive, CAST(floor(t / 3600) AS BIGINT) AS bin, bool_or(v > 120) AS o FROM sig GROUP BY 1, 2), m AS (SELECT *, bool_or(o) OVER (PARTITION BY drive, bin // 6) AS w, bool_or(o) OVER (PARTITION BY drive ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM b)
SELECT drive, count(*) AS bins, round(avg(w::INT), 8) AS kept_window, round(avg(e::INT), 8) AS kept_event FROM m GROUP BY drive""")
def bin_modes(spark, sf):
    out = vw.bin_modes(signals(spark, sf), "drive", "t", 3600.0, F.col("v") > 120, 6, 2)
    return out.select("drive", "bins", F.round("kept_window", 8).alias("kept_window"), F.round("kept_event", 8).alias("kept_event"))


@query(f"WITH {TICKS}, f AS (SELECT coalesce(ax_mps2, ay_mps2) AS a, lead_m AS d FROM ticks) SELECT 'hard' AS condition, count(*) FILTER (WHERE a < -3) AS kept, count(*) FILTER (WHERE a < -2) AS kept_loosely, count(*) FILTER (WHERE a < -2) - count(*) FILTER (WHERE a < -3) AS lost FROM f UNION ALL SELECT 'near', count(*) FILTER (WHERE d < 15), count(*) FILTER (WHERE d < 20), count(*) FILTER (WHERE d < 20) - count(*) FILTER (WHERE d < 15) FROM f")
def condition_losses(spark, sf):
    t = vw.with_fallbacks(ticks(spark, sf), {"a": ["ax_lost", "ax_mps2", "ay_mps2"], "d": ["lead_m"], "none": ["lost"]})
    a, d = F.col("a"), F.col("d")
    return vw.condition_losses(t, {"hard": (a < -3, a < -2), "near": (d < 15, d < 20)})


@query(f"""WITH {TICKS}, {_EVENTS}, m AS (SELECT e.id, k.t, k.v_mps AS v, k.yaw_dps AS y, k.steer_deg AS s, k.t < e.t_start AS b, k.t > e.t_end AS a FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start - 1 AND e.t_end + 1), h AS (SELECT *, sum(CASE WHEN a THEN y * 0.05 END) OVER (PARTITION BY id ORDER BY t) AS turned FROM m)
SELECT id, round(sqrt(avg(y * y) FILTER (WHERE a)) / sqrt(avg(y * y) FILTER (WHERE b)), 6) AS ratio_yaw_dps, round(sqrt(avg(s * s) FILTER (WHERE a)) / sqrt(avg(s * s) FILTER (WHERE b)), 6) AS ratio_steer_deg, round(sum(CASE WHEN a THEN v * sin(radians(turned)) * 0.05 END), 6) AS "offset" FROM h GROUP BY id""")
def behaviour_ratio(spark, sf):
    out = vw.behaviour_ratio(ticks(spark, sf), _brakes(spark, sf), "drive", "t", ["yaw_dps", "steer_deg"], "v_mps", "yaw_dps", 1.0, DT, 2.0)
    return out.select("id", *(F.round(c, 6).alias(c) for c in out.columns if c != "id"))


_CUTS = {"light": [0.25, 0.5, 0.25], "strong": [0.1, 0.2, 0.4, 0.2, 0.1]}


@query(f"""WITH {TICKS}, f AS (SELECT *, {fir_sql('ax_mps2', _CUTS['light'])} AS f0, {fir_sql('ax_mps2', _CUTS['strong'])} AS f1 FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)), j AS (SELECT *, abs((lead(f0) OVER w - lag(f0) OVER w) / 0.1) AS j0, abs((lead(f1) OVER w - lag(f1) OVER w) / 0.1) AS j1 FROM f WINDOW w AS (PARTITION BY drive ORDER BY tick)),
u AS (SELECT 'light' AS filter, j0 AS j, v_mps > 15 AS c, brake_level > 0 AS b FROM j UNION ALL SELECT 'strong', j1, v_mps > 15, brake_level > 0 FROM j), g AS (SELECT filter, quantile_cont(j, 0.95) FILTER (WHERE c) AS noise, quantile_cont(j, 0.5) FILTER (WHERE b) AS signal FROM u GROUP BY filter) SELECT filter, round(noise, 5) AS noise, round(signal, 5) AS signal, round(signal / noise, 6) AS separation FROM g""")
def jerk_feasibility(spark, sf):
    out = vw.jerk_feasibility(ticks(spark, sf), "drive", "tick", "ax_mps2", _CUTS, F.col("v_mps") > 15, F.col("brake_level") > 0, DT)
    return out.select("filter", F.round("noise", 5).alias("noise"), F.round("signal", 5).alias("signal"), F.round("separation", 6).alias("separation"))


@query("""WITH u AS (SELECT user_id AS drive, max(value) AS v, 0 AS s FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1 UNION ALL SELECT user_id, max(value), 1 FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, max(value), 2 FROM events GROUP BY 1), f AS (SELECT *, first_value(v) OVER (PARTITION BY drive ORDER BY s) AS f FROM u) SELECT drive, any_value(f) AS v, min(s) AS source, count(*) FILTER (WHERE v <> f) AS conflicts FROM f GROUP BY drive""")
def first_by_priority(spark, sf):
    s = signals(spark, sf).select("drive", "channel", "v")
    return vw.first_by_priority([s.filter("channel = 'error' and v > 100"), s.filter("channel = 'click'"), s], "drive", "v")


@query(f"WITH {SIG}, r AS (SELECT channel AS kind, floor((t / 3600) % 24) BETWEEN 6 AND 17 AS light, v > 60 AS hit, channel = 'view' AS control FROM sig), b AS (SELECT light, avg(hit::INT) FILTER (WHERE control) AS c FROM r GROUP BY light) SELECT kind, r.light, count(*) AS n, round(avg(hit::INT), 8) AS rate, round(any_value(c), 8) AS control_rate, round(avg(hit::INT) / any_value(c), 6) AS lift FROM r JOIN b ON b.light = r.light WHERE NOT control GROUP BY kind, r.light")
def review_rates(spark, sf):
    s = signals(spark, sf).select(F.col("channel").alias("kind"), F.floor(F.pmod(F.col("t") / 3600, F.lit(24.0))).between(6, 17).alias("light"), "v")
    out = vw.review_rates(s, "kind", "light", F.col("v") > 60, F.col("kind") == "view")
    return out.select("kind", "light", "n", F.round("rate", 8).alias("rate"), F.round("control_rate", 8).alias("control_rate"), F.round("lift", 6).alias("lift"))


@query(f"""WITH {SIG}, s AS (SELECT *, v > 40 AS o FROM sig WHERE channel <> 'view'), n AS (SELECT *, CASE WHEN o AND (NOT coalesce(lag(o) OVER w, false) OR t - lag(t) OVER w > 20000) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY drive, channel ORDER BY t)), r AS (SELECT *, sum(new) OVER (PARTITION BY drive, channel ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT drive, channel, CAST(run AS BIGINT) AS run, min(t) AS a, max(t) AS b, count(*) AS n FROM r WHERE o GROUP BY 1, 2, 3), v AS (SELECT drive, t, v FROM sig WHERE channel = 'view'), m AS (SELECT g.*, x.t AS xt, x.v AS xv, y.t AS yt, y.v AS yv FROM g ASOF LEFT JOIN v x ON x.drive = g.drive AND g.a >= x.t ASOF LEFT JOIN v y ON y.drive = g.drive AND g.a <= y.t)
SELECT drive, channel, run, round(a, 4) AS t_start, round(b, 4) AS t_end, n, CASE WHEN yt IS NOT NULL AND (xt IS NULL OR yt - a < a - xt) THEN yv ELSE xv END AS speed FROM m""")
def raw_flag_runs(spark, sf):
    s = signals(spark, sf)
    out = vw.raw_flag_runs(s.filter("channel <> 'view'"), s.filter("channel = 'view'"), "drive", "channel", "t", "v", 40.0, 20000.0)
    return out.select("drive", "channel", F.col("run").cast("long").alias("run"), F.round("t_start", 4).alias("t_start"), F.round("t_end", 4).alias("t_end"), "n", "speed")
