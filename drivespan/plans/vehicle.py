"""Queries of the feature table and the slip branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.functions import vehicle as vf
from drivespan.operators import features as ft, islands, slip as sl, timegrid as tg
from drivespan.plans.base import DT, SIG, TICKS, query, signals, ticks

_D = lambda x: f"((lead({x}) OVER w - lag({x}) OVER w) / 0.1)"
_FT = f"""f0 AS (SELECT *, {_D('ax_mps2')} AS jerk, v_mps * radians(yaw_dps) AS ay_kin, {_D('steer_deg')} AS steer_rate, CASE WHEN v_mps >= 3 THEN degrees(v_mps * radians(steer_deg) / (15.0 * (2.65 + 0.0025 * v_mps * v_mps))) END AS yaw_exp,
CASE WHEN v_mps >= 5 THEN degrees(1.4 * radians(yaw_dps) / v_mps - 0.003 * ay_mps2) END AS beta FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)),
f AS (SELECT *, yaw_dps - yaw_exp AS yaw_res, {_D('ay_kin')} AS lat_jerk, ay_mps2 - ay_kin AS ay_res, beta / degrees(sqrt(pow(1.4 * radians(0.3) / v_mps, 2) + pow(0.003 * 0.15, 2))) AS sigma, {_D('beta')} AS beta_rate,
beta - CASE WHEN v_mps >= 5 THEN degrees(radians(yaw_exp) * (1.4 / v_mps - 0.003 * v_mps)) END AS excess,
CASE WHEN abs(yaw_dps) >= 5 AND abs(steer_rate) >= 60 AND sign(yaw_dps) <> sign(steer_rate) THEN 1.0 ELSE 0.0 END AS counter FROM f0 WINDOW w AS (PARTITION BY drive ORDER BY tick))"""


def _basic(spark, sf):
    return ft.basic(ticks(spark, sf), "drive", "tick", DT)


def _r(*names):
    return [F.round(n, 5).alias(n) for n in names]


@query(f"WITH {TICKS}, {_FT} SELECT drive, tick, round(jerk, 5) AS jerk_mps3, round(ay_kin, 5) AS ay_kin_mps2, round(steer_rate, 5) AS steer_rate_dps, round(lat_jerk, 4) AS lat_jerk_mps3, round(ay_res, 5) AS ay_residual_mps2 FROM f")
def longitudinal_lateral(spark, sf):
    return _basic(spark, sf).select("drive", "tick", *_r("jerk_mps3", "ay_kin_mps2", "steer_rate_dps"), F.round("lat_jerk_mps3", 4).alias("lat_jerk_mps3"), *_r("ay_residual_mps2"))


@query(f"""WITH {TICKS}, {_FT} SELECT drive, tick, round(CASE WHEN count(jerk) OVER x >= 4 THEN min(jerk) OVER x END, 5) AS jerk_win_min, round(CASE WHEN count(jerk) OVER x >= 4 THEN avg(jerk) OVER x END, 5) AS jerk_win_mean, round(CASE WHEN count(lat_jerk) OVER x >= 4 THEN max(abs(lat_jerk)) OVER x END, 4) AS lat_jerk_win_absmax
FROM f WINDOW x AS (PARTITION BY drive ORDER BY tick ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def jerk_windows(spark, sf):
    return _basic(spark, sf).select("drive", "tick", *_r("jerk_win_min", "jerk_win_mean"), F.round("lat_jerk_win_absmax", 4).alias("lat_jerk_win_absmax"))


@query(f"WITH {TICKS}, {_FT} SELECT drive, tick, round(yaw_exp, 5) AS yaw_expected_dps, round(yaw_res, 5) AS yaw_residual_dps, counter :: DOUBLE AS counter_steer, round(sqrt(ax_mps2 * ax_mps2 + ay_mps2 * ay_mps2) / 9.80665, 5) AS friction_demand FROM f")
def single_track_model(spark, sf):
    return _basic(spark, sf).select("drive", "tick", *_r("yaw_expected_dps", "yaw_residual_dps"), "counter_steer", *_r("friction_demand"))


@query(f"WITH {TICKS}, {_FT} SELECT drive, tick, round(beta, 5) AS beta_model_deg, round(excess, 5) AS beta_excess_deg, round(sigma, 4) AS beta_sigma, round(beta_rate, 4) AS beta_rate_dps FROM f")
def sideslip_model(spark, sf):
    return _basic(spark, sf).select("drive", "tick", *_r("beta_model_deg", "beta_excess_deg"), F.round("beta_sigma", 4).alias("beta_sigma"), F.round("beta_rate_dps", 4).alias("beta_rate_dps"))


_LEAD = """l0 AS (SELECT *, lead_id = lag(lead_id) OVER w AND lead_id = lead(lead_id) OVER w AS same, (lead(lead_m) OVER w - lag(lead_m) OVER w) / 0.1 AS d, CASE WHEN v_mps >= 1 THEN lead_m / v_mps END AS thw FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)),
l AS (SELECT *, CASE WHEN same THEN d END AS vrel, CASE WHEN same THEN (lead(thw) OVER w - lag(thw) OVER w) / 0.1 END AS rate FROM l0 WINDOW w AS (PARTITION BY drive ORDER BY tick))"""


def _lead(spark, sf):
    return ft.lead_features(ticks(spark, sf), "drive", "tick", DT)


@query(f"WITH {TICKS}, {_LEAD} SELECT drive, tick, round(vrel, 5) AS lead_vrel_mps, round(thw, 5) AS thw_s, round(CASE WHEN vrel <= -0.5 THEN lead_m / -vrel END, 5) AS ttc_s, round(rate, 4) AS thw_rate_s_per_s, CASE WHEN rate <= -0.4 THEN 1.0 ELSE 0.0 END :: DOUBLE AS closing_fast FROM l")
def headway_and_ttc(spark, sf):
    return _lead(spark, sf).select("drive", "tick", *_r("lead_vrel_mps", "thw_s", "ttc_s"), F.round("thw_rate_s_per_s", 4).alias("thw_rate_s_per_s"), "closing_fast")


@query("""WITH k AS (SELECT user_id AS drive, floor(epoch_us(ts) / 1e6 / 86400.0) AS t, event_id AS track_id, value / 5.0 AS distance, (event_id * 37 % 100) / 20.0 - 2.5 AS lat_m, (event_id * 53 % 100) / 5.0 - 10 AS rel_speed, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (user_id * 7 % 30) + 2.0 END AS v, (event_id * 13 % 100) / 10.0 - 5 AS yaw FROM events),
i AS (SELECT *, abs(lat_m - coalesce(CASE WHEN v >= 5 THEN 0.5 * radians(yaw) / v * distance * distance END, 0)) AS off FROM k), m AS (SELECT drive, t, min(ROW(distance, track_id, rel_speed)) AS b FROM i WHERE off <= 1.8 AND coalesce(v, 0) + rel_speed >= 3 GROUP BY drive, t)
SELECT drive, t :: BIGINT AS t, round(b[1], 6) AS lead_m, round(b[3], 6) AS lead_vrel_mps, b[2] AS lead_id FROM m""")
def lead_vehicle(spark, sf):
    e = signals(spark, sf)
    k = e.select("drive", F.floor(F.col("t") / 86400.0).alias("t"), F.col("event_id").alias("track_id"), (F.col("v") / 5.0).alias("distance"), (F.col("event_id") * 37 % 100 / 20.0 - 2.5).alias("lateral"), (F.col("event_id") * 53 % 100 / 5.0 - 10).alias("rel_speed"), F.when(F.col("event_id") % 11 != 0, F.col("drive") * 7 % 30 + 2.0).alias("ego"), (F.col("event_id") * 13 % 100 / 10.0 - 5).alias("yaw")).withColumnRenamed("ego", "v")
    return ft.lead_from_tracks(k, "drive", "t").select("drive", "t", F.round("lead_m", 6).alias("lead_m"), F.round("lead_vrel_mps", 6).alias("lead_vrel_mps"), "lead_id")


@query(f"WITH {TICKS} SELECT drive, tick, CASE WHEN coalesce(max(ax_mps2) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) > 0.3 AND ax_mps2 <= -3, false) THEN 1.0 ELSE 0.0 END :: DOUBLE AS panic FROM ticks")
def panic_brake(spark, sf):
    t = ticks(spark, sf)
    return t.select("drive", "tick", ft.panic_brake(t, "drive", "tick", 10).alias("panic"))


@query(f"""WITH {TICKS}, a AS (SELECT *, coalesce(gas_pct < 2 AND CASE WHEN count(gas_pct) OVER x >= 5 THEN max(gas_pct) OVER x END >= 10, false) AS free FROM ticks WINDOW x AS (PARTITION BY drive ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
b AS (SELECT *, coalesce(free AND NOT coalesce(lag(free) OVER w, false) AND min(ax_mps2) OVER y <= -2 AND max(brake_level) OVER y - brake_level >= 0.2 AND lead(1) OVER w IS NOT NULL, false) AS hit FROM a WINDOW w AS (PARTITION BY drive ORDER BY tick), y AS (PARTITION BY drive ORDER BY tick ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT drive, tick, CASE WHEN bool_or(hit) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE 0.0 END :: DOUBLE AS panic_brake_pedal FROM b""")
def pedal_panic_brake(spark, sf):
    return ft.pedal_panic_brakes(ticks(spark, sf), "drive", "tick", 11, 12).select("drive", "tick", "panic_brake_pedal")


@query()
def cut_ins(spark, sf):
    """Cut-ins with their refractory window, compared by tests with a loop."""
    return ft.cut_ins(_lead(spark, sf), "drive", "tick", "t", 6, DT, v_min=1.0, most_thw=5.0)


_WS = """ws0 AS (SELECT *, greatest(ws_fl, ws_fr, ws_rl, ws_rr) - least(ws_fl, ws_fr, ws_rl, ws_rr) AS spread, least((lead(ws_fl) OVER w - lag(ws_fl) OVER w) / 0.1, (lead(ws_fr) OVER w - lag(ws_fr) OVER w) / 0.1, (lead(ws_rl) OVER w - lag(ws_rl) OVER w) / 0.1, (lead(ws_rr) OVER w - lag(ws_rr) OVER w) / 0.1) AS decel FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)),
ws AS (SELECT *, spread - abs(radians(yaw_dps)) * 1.6 - median(spread - abs(radians(yaw_dps)) * 1.6) OVER (PARTITION BY drive) AS ex FROM ws0)"""


def _wheels(spark, sf, df=None):
    return ft.wheel_features(ticks(spark, sf) if df is None else df, "drive", "tick", DT)


@query(f"WITH {TICKS}, {_WS} SELECT drive, tick, spread AS ws_spread_mps, round(decel + 1e-8, 4) AS wheel_decel_mps2, round(ex + 1e-8, 5) AS ws_spread_excess_mps FROM ws")
def wheel_spread(spark, sf):
    return _wheels(spark, sf).select("drive", "tick", "ws_spread_mps", F.round(F.col("wheel_decel_mps2") + 1e-8, 4).alias("wheel_decel_mps2"), F.round(F.col("ws_spread_excess_mps") + 1e-8, 5).alias("ws_spread_excess_mps"))


@query(f"WITH {TICKS}, {_WS} SELECT drive, tick, CASE WHEN coalesce(ex > 0.2 AND v_mps > 5, false) AND coalesce(bool_or(coalesce(abs(ax_mps2) > 4, false) OR abs_flag > 0.5) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), false) THEN 1.0 ELSE 0.0 END :: DOUBLE AS anomaly FROM ws")
def wheel_anomaly(spark, sf):
    return _wheels(spark, sf).select("drive", "tick", ft.wheel_anomaly("drive", "tick", 2, 0.2, 5.0, 4.0, "abs_flag").alias("anomaly"))


def _dev(spark, sf):
    return ft.yaw_deviation(_basic(spark, sf), "drive", "tick", 21)


@query()
def lane_changes(spark, sf):
    """Pairs of opposite lobes that shift the car by a lane; compared by tests with synthetic manoeuvres."""
    return ft.lane_changes(_dev(spark, sf), "drive", "t", DT)


@query()
def weaving(spark, sf):
    return ft.weaving(_dev(spark, sf), "drive", "t", least=2)


@query()
def s_evasions(spark, sf):
    return ft.s_evasions(_dev(spark, sf), "drive", "t", DT, least=2)


@query(f"""WITH {TICKS}, u AS (SELECT 'v_mps' AS feature, v_mps AS x FROM ticks UNION ALL SELECT 'ax_mps2', ax_mps2 FROM ticks UNION ALL SELECT 'lead_m', lead_m FROM ticks) SELECT feature, round(count(x) / count(*), 6) AS coverage, min(x) AS min, max(x) AS max FROM u GROUP BY feature""")
def feature_profile(spark, sf):
    return ft.profile(ticks(spark, sf), ["v_mps", "ax_mps2", "lead_m"]).withColumn("coverage", F.round("coverage", 6))


_S1 = "s1 AS (SELECT *, beta IS NOT NULL AND v_mps >= 10 AND coalesce(abs(beta) >= 1 AND abs(sigma) >= 6, false) AS why_beta, beta IS NOT NULL AND v_mps >= 10 AND coalesce(abs(ay_res) >= 1.5, false) AS why_latdyn, beta IS NOT NULL AND v_mps >= 10 AND (abs_flag > 0.5 OR vsc_flag > 0.5) AS why_flag FROM f)"


def _stage1(spark, sf):
    return sl.stage1(_basic(spark, sf))


@query(f"WITH {TICKS}, {_FT}, {_S1} SELECT drive, tick, why_beta, why_latdyn, why_flag, why_beta OR why_latdyn OR why_flag AS stage1 FROM s1")
def slip_stage1(spark, sf):
    return _stage1(spark, sf).select("drive", "tick", "why_beta", "why_latdyn", "why_flag", "stage1")


_CONF = """cf AS (SELECT *, why_beta OR why_latdyn OR why_flag AS m, ay_mps2 IS NOT NULL AND ay_kin IS NOT NULL AND (NOT coalesce(abs(ay_kin) >= 0.5, false) OR coalesce(ay_mps2 * ay_kin > 0 AND ay_mps2 / ay_kin BETWEEN 0.3 AND 2, false)) AS sane, coalesce(bool_or(coalesce(abs(beta) >= 3, false)) OVER x, false) AS c1, coalesce(bool_or(coalesce(abs(excess) >= 0.5, false)) OVER x, false) AS c2,
coalesce(bool_or(coalesce(abs(ay_kin) >= 1.5, false)) OVER x, false) AS c3, coalesce(bool_or(coalesce(abs(beta_rate) >= 8, false)) OVER x, false) AS c4, coalesce(bool_or(abs_flag > 0.5 OR vsc_flag > 0.5) OVER x, false) AS c5 FROM s1 WINDOW x AS (PARTITION BY drive ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
rh AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive ORDER BY tick) > 0.15 THEN 1 ELSE 0 END AS nw FROM cf WHERE m), ri AS (SELECT *, sum(nw) OVER (PARTITION BY drive ORDER BY tick) AS run FROM rh), sp AS (SELECT drive, run, min(t) AS t_start, max(t) AS t_end FROM ri GROUP BY drive, run),
jd AS (SELECT s.drive, s.run, s.t_start, s.t_end, avg(c.sane::INT) AS share, max(c1::INT) + max(c2::INT) + max(c3::INT) + max(c4::INT) + max(c5::INT) AS score FROM sp s JOIN cf c ON c.drive = s.drive AND c.t BETWEEN s.t_start AND s.t_end GROUP BY ALL)"""


def _judged(spark, sf):
    return sl.stage2(sl.confidence(_stage1(spark, sf), "drive", "tick", 3), "drive", "t", DT, 0.15, 0.1)


@query(f"""WITH {TICKS}, {_FT}, {_S1}, {_CONF} SELECT drive, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, score :: DOUBLE AS score, round(share, 6) AS sane_share, CASE WHEN t_end - t_start < 0.1 AND share < 0.6 THEN 'duration+signal_sane' WHEN t_end - t_start < 0.1 THEN 'duration' WHEN share < 0.6 THEN 'signal_sane' WHEN score < 2 THEN 'confidence' ELSE 'passed' END AS verdict FROM jd""")
def slip_stage2(spark, sf):
    return _judged(spark, sf).select("drive", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "score", F.round("sane_share", 6).alias("sane_share"), "verdict")


@query(f"""WITH {TICKS}, {_FT}, {_S1}, {_CONF} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t_end - t_start < 0.1 THEN 'duration' END AS reason FROM jd UNION ALL SELECT CASE WHEN share < 0.6 THEN 'signal_sane' END FROM jd UNION ALL SELECT CASE WHEN t_end - t_start >= 0.1 AND share >= 0.6 AND score < 2 THEN 'confidence' END FROM jd) WHERE reason IS NOT NULL GROUP BY reason""")
def slip_reject_counts(spark, sf):
    return sl.reject_counts(_judged(spark, sf))


@query()
def sideslip_candidates(spark, sf):
    b = _basic(spark, sf)
    return sl.sideslip_candidates(_judged(spark, sf), b, "drive", "t", 0.2, 0.2, 1.0)


def _evidence(spark, sf):
    return sl.direct_evidence(_wheels(spark, sf), "drive", "tick", "t", DT, spread=1.3, decel=-9.0)


_EV = f"""ev0 AS (SELECT *, slip_warn > 3.5 AND slip_warn <= 4.5 AS e1, abs_flag > 0.5 AS e2, vsc_flag > 0.5 AS e3, coalesce(spread >= 1.3, false) AND v_mps >= 3 AS r4, coalesce(decel <= -9, false) AND v_mps >= 3 AS r5 FROM ws),
ev1 AS (SELECT *, r4 AND (coalesce(lag(r4) OVER w, false) OR coalesce(lead(r4) OVER w, false)) AS e4, r5 AND (coalesce(lag(r5) OVER w, false) OR coalesce(lead(r5) OVER w, false)) AS e5 FROM ev0 WINDOW w AS (PARTITION BY drive ORDER BY tick))"""


@query(f"WITH {TICKS}, {_WS}, {_EV} SELECT drive, tick, e1 AS e_slip_warn, e2 AS e_abs, e3 AS e_vsc, e4 AS e_spread, e5 AS e_decel FROM ev1")
def direct_evidence(spark, sf):
    return _evidence(spark, sf).select("drive", "tick", *sl.EVIDENCE)


@query(f"""WITH {TICKS}, {_WS}, {_EV}, nr AS (SELECT *, bool_or(e1 OR e2 OR e3 OR e4 OR e5) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ev1), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive ORDER BY tick) > 0.1 THEN 1 ELSE 0 END AS nw FROM nr WHERE near), r AS (SELECT *, sum(nw) OVER (PARTITION BY drive ORDER BY tick) AS run FROM g),
h AS (SELECT drive, run, min(t) AS t_start, max(t) AS t_end, bool_or(e1) AS e1, bool_or(e2) AS e2, bool_or(e3) AS e3, bool_or(e4) AS e4, bool_or(e5) AS e5, max(v_mps) AS v_max FROM r GROUP BY drive, run),
m AS (SELECT *, (e1 AND (e4 OR e5 OR e2)) OR (e2 AND (e5 OR e4)) OR (e3 AND e4) AS backed, ((e1 OR e2 OR e3) AND e4)::INT + ((e1 OR e2) AND e5)::INT + (e1 AND e2)::INT AS n_mech FROM h)
SELECT drive, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, CASE WHEN n_mech >= 2 THEN 'multi' WHEN backed THEN 'high' WHEN e1 OR e2 OR e3 THEN 'activation' ELSE 'physics' END AS grade, concat_ws('|', CASE WHEN e1 THEN 'slip_warn' END, CASE WHEN e2 THEN 'abs' END, CASE WHEN e3 THEN 'vsc' END, CASE WHEN e4 THEN 'spread' END, CASE WHEN e5 THEN 'decel' END) AS evidence, round(v_max, 5) AS v_max FROM m""")
def direct_slip(spark, sf):
    return sl.direct_slip(_evidence(spark, sf), "drive", "t", DT, pad_rows=2, merge_gap=0.1).select("drive", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "grade", "evidence", F.round("v_max", 5).alias("v_max"))


@query("""WITH a AS (SELECT event_id AS a_id, user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 9000 AS e FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS b_id, user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 9000 AS e FROM events WHERE event_type = 'view'), j AS (SELECT a.drive, a_id, b_id FROM a JOIN b ON a.drive = b.drive AND a.s <= b.e AND b.s <= a.e)
SELECT drive, a_id, b_id, 'both' AS side FROM j UNION ALL SELECT drive, a_id, NULL, 'a' FROM a WHERE a_id NOT IN (SELECT a_id FROM j) UNION ALL SELECT drive, NULL, b_id, 'b' FROM b WHERE b_id NOT IN (SELECT b_id FROM j)""")
def slip_branch_overlap(spark, sf):
    s = signals(spark, sf)
    side = lambda c, p: s.filter(F.col("channel") == c).select("drive", F.col("event_id").alias(f"{p}_id"), F.col("t").alias(f"{p}_start"), (F.col("t") + 9000).alias(f"{p}_end"))
    return sl.branch_overlap(side("click", "a"), side("view", "b"), "drive", 20000.0)


@query(f"WITH {TICKS}, k AS (SELECT *, CASE WHEN vsc_flag > 0.5 OR coalesce(abs(ay_mps2) >= 4, false) THEN 'lateral' WHEN abs_flag > 0.5 AND coalesce(ax_mps2 < 0, false) THEN 'lock' WHEN coalesce(ws_rr - ws_fl >= 1 AND ax_mps2 >= 0, false) THEN 'spin' ELSE 'unclassified' END AS kind FROM ticks) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def slip_kinds(spark, sf):
    t = ticks(spark, sf)
    kind = sl.slip_kind(F.col("vsc_flag") > 0.5, F.col("ay_mps2"), F.lit(0.0), F.col("abs_flag") > 0.5, F.lit(0.0), F.col("ws_rr") - F.col("ws_fl"), F.col("ax_mps2"))
    return t.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
