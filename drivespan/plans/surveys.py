"""Queries of surveys: radar, poses, accuracies, inventories and band agreements; and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drivespan.functions.vehicle import unit_scale
from drivespan.operators import candidates as cd, decode, surveys as sv
from drivespan.plans.align import _PLACES
from drivespan.plans.base import DT, SIG, TICKS, query, rounded, signals, table, ticks
from drivespan.plans.chains import _EVENTS, _brakes
from drivespan.plans.places import _points
from drivespan.sources import tables as src
from drivespan.sources.scratch import scratch_dir


def _rounded(df, digits, *skip):
    return df.select(*(F.col(c) if c in skip else F.round(c, digits).alias(c) for c in df.columns))


@query(f"""WITH {SIG}, p AS (SELECT drive, t, event_id % 8 AS track, v AS distance, event_id % 7 - 3.0 AS beside, event_id % 3 = 0 AS valid FROM sig WHERE event_id % 8 < 4), s AS (SELECT drive, t, event_id % 8 - 4 AS track, max(event_id % 101 :: DOUBLE) AS score FROM sig WHERE event_id % 8 >= 4 GROUP BY ALL)
SELECT p.drive, round(p.t, 4) AS t, p.track, distance, beside, valid, s.score FROM p ASOF LEFT JOIN s ON s.drive = p.drive AND s.track = p.track AND p.t >= s.t WHERE distance < 120 AND (valid OR coalesce(s.score > 50, false))""")
def radar_tracks(spark, sf):
    f = signals(spark, sf).withColumn("address", 0x210 + F.col("event_id") % 8)
    fields = {"distance": F.col("v"), "beside": F.col("event_id") % 7 - 3.0, "valid": F.col("event_id") % 3 == 0}
    out = sv.radar_tracks(f, "drive", "t", "address", 0x210, 4, fields, 0x214, F.col("event_id") % 101, 50.0, 120.0)
    return out.withColumns({"track": F.col("track") - 0x210, "t": F.round("t", 4)})


@query(f"""WITH {SIG}, g AS (SELECT drive, t, event_id, v FROM sig WHERE channel = 'view'), p AS (SELECT drive, t, v AS x, 500 - v AS y, sin(radians(event_id * 37 % 360)) AS e, cos(radians(event_id * 37 % 360)) AS n, t + 18 AS u FROM sig WHERE channel <> 'view'),
m AS (SELECT g.*, CASE WHEN b.t > a.t THEN (g.t - a.t) / (b.t - a.t) ELSE 0 END AS f, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS "by", a.e AS ae, b.e AS be, a.n AS an, b.n AS bn, a.u AS au, b.u AS bu, least(g.t - a.t, b.t - g.t) AS nearest FROM g ASOF LEFT JOIN p a ON a.drive = g.drive AND g.t >= a.t ASOF LEFT JOIN p b ON b.drive = g.drive AND g.t <= b.t),
l AS (SELECT *, ax + f * (bx - ax) AS x, ay + f * ("by" - ay) AS y, ae + f * (be - ae) AS e, an + f * (bn - an) AS n, au + f * (bu - au) AS u FROM m),
d AS (SELECT *, sum(v * (t - p)) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(lag(t) OVER (PARTITION BY drive ORDER BY t), t) AS p FROM l))
SELECT event_id, round(x + 1.5 * e / greatest(sqrt(e * e + n * n), 1e-9), 4) AS x, round(y + 1.5 * n / greatest(sqrt(e * e + n * n), 1e-9), 4) AS y, round((degrees(atan2(e, n)) + 360) % 360, 3) AS heading, round(u, 3) AS unix, round(nearest, 4) AS nearest_s, round(s, 2) AS distance FROM d""")
def attached_track(spark, sf):
    s = signals(spark, sf)
    pose = s.filter("channel <> 'view'").select("drive", "t", F.col("v").alias("x"), (500 - F.col("v")).alias("y"), (F.col("event_id") * 37 % 360).alias("heading"), (F.col("t") + 18).alias("unix"))
    out = sv.attach_track(s.filter("channel = 'view'").select("drive", "t", "event_id", "v"), pose, "drive", "t", "v", 1.5)
    return out.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("heading", 3).alias("heading"), F.round("unix", 3).alias("unix"), F.round("nearest_s", 4).alias("nearest_s"), F.round("distance", 2).alias("distance"))


@query(f"""WITH {TICKS}, a AS (SELECT drive, tick, v_mps, abs(avg(yaw_dps) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS y FROM ticks), b AS (SELECT *, max(y) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS m FROM a)
SELECT drive, round(count(*) FILTER (WHERE v_mps > 15) * 0.05, 4) AS fast_s, round(count(*) FILTER (WHERE v_mps > 15 AND m < 12) * 0.05, 4) AS straight_s, round(median(v_mps), 5) AS v_median, round(max(v_mps), 5) AS v_max FROM b GROUP BY drive""")
def clip_features(spark, sf):
    out = sv.clip_features(ticks(spark, sf), "drive", "tick", "v_mps", "yaw_dps", DT, 15.0, 12.0, 5, 8)
    return out.select("drive", F.round("fast_s", 4).alias("fast_s"), F.round("straight_s", 4).alias("straight_s"), F.round("v_median", 5).alias("v_median"), F.round("v_max", 5).alias("v_max"))


_LANDMARK = f"{_PLACES}, l AS (SELECT vec_id, label, vec_id % 2 AS line, (x - 20) * sin(radians(hdg)) + (y + 10) * cos(radians(hdg)) AS along, (x - 20) * cos(radians(hdg)) - (y + 10) * sin(radians(hdg)) AS cross_ FROM p)"


def _landmark(spark, sf):
    p = _points(spark, sf).withColumn("line", F.col("id") % 2)
    return sv.landmark_errors(p, "line", "x", "y", "hdg", (20.0, -10.0))


@query(f"WITH {_LANDMARK} SELECT vec_id AS id, round(along, 4) AS along, round(cross_, 4) AS \"cross\", round(along - median(along) OVER (PARTITION BY line), 4) AS along_dev FROM l")
def landmark_errors(spark, sf):
    return _rounded(_landmark(spark, sf).select("id", "along", "cross", "along_dev"), 4, "id")


@query(f"WITH {_LANDMARK}, g AS (SELECT line, count(*) AS k, var_pop(along) AS v FROM l GROUP BY line) SELECT CAST(sum(k) AS BIGINT) AS n, round(sqrt(sum(k * v) / greatest(sum(k) - count(*), 1)), 5) AS pooled, least(greatest(ceil(2 * sqrt(2) * sqrt(sum(k * v) / greatest(sum(k) - count(*), 1))), 5), 15) AS radius FROM g")
def pooled_deviation(spark, sf):
    return sv.pooled_deviation(_landmark(spark, sf), "line").withColumn("pooled", F.round("pooled", 5))


@query(f"WITH {_LANDMARK} SELECT line AS site, count(DISTINCT label) AS drives, count(*) AS n, round(stddev_samp(along), 5) AS along_sd, round(stddev_samp(cross_), 5) AS cross_sd FROM l GROUP BY line HAVING count(DISTINCT label) >= 2")
def site_scatter(spark, sf):
    return _rounded(sv.site_scatter(_landmark(spark, sf).withColumnRenamed("line", "site"), "site", "drive", "along", "cross"), 5, "site", "drives", "n")


@query("SELECT user_id AS drive, count(*) AS n, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY 1")
def accuracy_quantiles(spark, sf):
    return _rounded(sv.accuracy_quantiles(signals(spark, sf), ["drive"], "v"), 5, "drive", "n")


@query(f"WITH {SIG}, r AS (SELECT drive, (count(t) - 1) / (max(t) - min(t)) AS hz FROM sig GROUP BY drive), {TICKS} SELECT k.drive, k.tick, CASE WHEN r.hz >= 0.00005 THEN k.yaw_dps END AS yaw_dps, k.v_mps FROM ticks k LEFT JOIN r ON r.drive = k.drive AND r.drive % 3 <> 1")
def blanked_by_rate(spark, sf):
    rates = sv.effective_rate(signals(spark, sf).filter("drive % 3 <> 1"), ["drive"], "t")
    return sv.blanked(ticks(spark, sf).select("drive", "tick", "yaw_dps", "v_mps"), rates, ["drive"], 0.00005, ["yaw_dps"])


@query(f"""WITH {TICKS}, {_EVENTS}, k AS (SELECT *, lag(yaw_dps) OVER w AS m0, lead(yaw_dps) OVER w AS m2 FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)), m AS (SELECT e.id, k.t - e.t_start AS d, k.yaw_dps AS x, k.steer_deg AS p, m0, m2 FROM ev e JOIN k ON k.drive = e.drive AND k.t BETWEEN e.t_start - 1 AND e.t_start + 0.8),
h AS (SELECT *, max(abs(x)) FILTER (WHERE d BETWEEN -0.3 AND 0.5) OVER (PARTITION BY id) AS top FROM m), g AS (SELECT id, min(CASE WHEN d BETWEEN -0.3 AND 0.5 AND abs(x) >= 0.5 * top AND top > 1e-6 THEN d END) AS fd, corr(m0, p) FILTER (WHERE d BETWEEN -0.5 AND 0.8) AS r0, corr(x, p) FILTER (WHERE d BETWEEN -0.5 AND 0.8) AS r1, corr(m2, p) FILTER (WHERE d BETWEEN -0.5 AND 0.8) AS r2, max(abs(x)) FILTER (WHERE d BETWEEN -1 AND -0.4) / max(abs(x)) AS pre FROM h GROUP BY id),
b AS (SELECT id, max(ROW(round(r, 9), -abs(l), l)) AS b FROM (SELECT id, r0 AS r, -1 AS l FROM g UNION ALL SELECT id, r1, 0 FROM g UNION ALL SELECT id, r2, 1 FROM g) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY id)
SELECT g.id, coalesce((SELECT sign(x) FROM h WHERE h.id = g.id AND h.d = g.fd), 0) :: INT AS first_sign, round(fd, 5) AS first_dt, round(r1, 6) AS r0, round(b.b[1], 6) AS r_best, round(b.b[3] * 0.05, 4) AS lag, round(pre, 6) AS precursor FROM g LEFT JOIN b ON b.id = g.id""")
def impact_metrics(spark, sf):
    hits = _brakes(spark, sf).select("drive", "id", F.col("t_start").alias("t_hit"))
    out = sv.impact_metrics(ticks(spark, sf), hits, "drive", "t", "yaw_dps", "steer_deg", (-0.3, 0.5), 0.5, (-0.5, 0.8), (-1.0, -0.4), [-1, 0, 1], DT, 2.0)
    return out.select("id", "first_sign", rounded("first_dt", 5).alias("first_dt"), rounded("r0", 6).alias("r0"), rounded("r_best", 6).alias("r_best"), rounded("lag", 4).alias("lag"), rounded("precursor", 6).alias("precursor"))


@query(f"""WITH {TICKS}, {_EVENTS}, g AS (SELECT e.id, sqrt(avg(ws_fl ** 2)) AS fl, sqrt(avg(ws_fr ** 2)) AS fr, sqrt(avg(ws_rl ** 2)) AS rl, sqrt(avg(ws_rr ** 2)) AS rr, arg_max(t, (ws_fl, -t)) AS tfl, arg_max(t, (ws_fr, -t)) AS tfr, arg_max(t, (ws_rl, -t)) AS trl, arg_max(t, (ws_rr, -t)) AS trr FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start AND e.t_end GROUP BY e.id)
SELECT id, round((fr + rr) / (fl + rl), 6) AS ratio, CASE WHEN fr + rr > fl + rl THEN 'right' ELSE 'left' END AS side, round(CASE WHEN fr + rr > fl + rl THEN trr - tfr ELSE trl - tfl END, 4) AS lag FROM g""")
def wheel_side(spark, sf):
    out = sv.wheel_side(ticks(spark, sf), _brakes(spark, sf), "drive", "t", {w: f"ws_{w}" for w in ("fl", "fr", "rl", "rr")}, 1.0)
    return out.select("id", rounded("ratio", 6).alias("ratio"), "side", rounded("lag", 4).alias("lag"))


_SCREEN = f"{TICKS}, sm AS (SELECT *, coalesce(v_mps >= 8 AND abs(avg(yaw_dps) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) < 14 AND NOT coalesce(bool_or(vsc_flag > 0.5) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), false) AND row_number() OVER (PARTITION BY drive ORDER BY tick) > 3 AND row_number() OVER (PARTITION BY drive ORDER BY tick) <= count(*) OVER (PARTITION BY drive) - 3, false) AS screened FROM ticks)"


def _screened(spark, sf):
    return sv.screen_mask(ticks(spark, sf), "drive", "tick", "v_mps", "yaw_dps", F.col("vsc_flag") > 0.5, 8.0, 14.0, 10, 2, 3)


@query(f"WITH {_SCREEN} SELECT drive, tick, screened FROM sm")
def screen_mask(spark, sf):
    return _screened(spark, sf).select("drive", "tick", "screened")


_FILES = "files AS (SELECT event_id AS id, user_id AS car, floor(epoch_us(ts) / 1e6 / 3600) * 3600 AS t0, floor(epoch_us(ts) / 1e6 / 3600) * 3600 + 1800 + event_id % 5 * 900 AS t1 FROM events)"


def _files(spark, sf):
    hour = F.floor(F.col("t") / 3600).cast("double") * 3600
    return signals(spark, sf).select(F.col("event_id").alias("id"), F.col("drive").alias("car"), hour.alias("t0"), (hour + 1800 + F.col("event_id") % 5 * 900).alias("t1"))


@query(f"WITH {_FILES}, n AS (SELECT *, CASE WHEN abs(t0 - lag(t0) OVER w) <= 1800 AND abs(t1 - lag(t1) OVER w) <= 1800 THEN 0 ELSE 1 END AS new FROM files WINDOW w AS (PARTITION BY car ORDER BY t0, t1, id)) SELECT id, car, CAST(sum(new) OVER (PARTITION BY car ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drive FROM n")
def grouped_drives(spark, sf):
    return sv.group_drives(_files(spark, sf), "car", 1800.0).select("id", "car", "drive")


@query(f"WITH {_FILES} SELECT a.car, a.id AS a, b.id AS b, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS seconds FROM files a JOIN files b ON b.car = a.car AND a.id < b.id AND least(a.t1, b.t1) > greatest(a.t0, b.t0)")
def overlapping_files(spark, sf):
    return sv.overlapping_files(_files(spark, sf), "car", 3600.0)


@query(f"""WITH {TICKS}, u AS (SELECT drive, v_mps > 10 AS ok, 'ay_mps2' AS metric, ay_mps2 AS x FROM ticks UNION ALL SELECT drive, v_mps > 10, 'yaw_dps', yaw_dps FROM ticks)
SELECT drive, metric, count(x) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS left_out, round(quantile_cont(x, 0.05) FILTER (WHERE ok), 5) AS p05, round(quantile_cont(x, 0.25) FILTER (WHERE ok), 5) AS p25, round(quantile_cont(x, 0.5) FILTER (WHERE ok), 5) AS p50, round(quantile_cont(x, 0.75) FILTER (WHERE ok), 5) AS p75, round(quantile_cont(x, 0.95) FILTER (WHERE ok), 5) AS p95, round(avg((x < 0)::INT) FILTER (WHERE ok), 9) AS negative FROM u GROUP BY drive, metric""")
def inventory_quantiles(spark, sf):
    out = sv.inventory_quantiles(ticks(spark, sf), ["drive"], ["ay_mps2", "yaw_dps"], F.col("v_mps") > 10)
    return out.select("drive", "metric", "n", "left_out", *(F.round(f"p{p}", 5).alias(f"p{p}") for p in ("05", "25", "50", "75", "95")), F.round("negative", 9).alias("negative"))


@query("SELECT user_id AS drive, event_type AS code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS share FROM events GROUP BY 1, 2")
def code_shares(spark, sf):
    return sv.code_shares(signals(spark, sf), ["drive"], F.col("channel")).withColumn("share", F.round("share", 9))


@query(f"""WITH {_SCREEN}, {_EVENTS.replace(TICKS + ", ", "")}, s AS (SELECT drive, CAST(floor(t / 2.0) AS BIGINT) AS seg, min(t) AS t0, max(t) AS t1, count(*) AS n FROM sm WHERE screened GROUP BY ALL HAVING count(*) >= 3)
SELECT drive, seg, round(t0, 4) AS t0, round(t1, 4) AS t1, n, EXISTS (SELECT 1 FROM ev WHERE ev.drive = s.drive AND ev.t_start <= s.t1 + 0.3 AND ev.t_end >= s.t0 - 0.3) AS has_candidate FROM s""")
def compare_segments(spark, sf):
    out = sv.compare_segments(_screened(spark, sf), _brakes(spark, sf), "drive", "t", F.col("screened"), 2.0, 3, 0.3)
    return out.select("drive", "seg", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"), "n", "has_candidate")


@query("""WITH s AS (SELECT user_id AS station, count(*) AS points, round(max(value), 2) AS mb, user_id % 7 = 0 AS must FROM events GROUP BY user_id), t AS (SELECT *, sum(mb) OVER (ORDER BY must DESC, points DESC, station ROWS UNBOUNDED PRECEDING) AS total FROM s) SELECT station, points, round(total, 4) AS total, must OR total <= 2000 AS selected FROM t""")
def capped_plan(spark, sf):
    s = signals(spark, sf).groupBy(F.col("drive").alias("station")).agg(F.count("*").alias("points"), F.round(F.max("v"), 2).alias("mb")).withColumn("must", F.col("station") % 7 == 0)
    return sv.capped_plan(s, [F.desc("must"), F.desc("points"), F.asc("station")], "mb", 2000.0, F.col("must")).select("station", "points", F.round("total", 4).alias("total"), "selected")


_BAND = "{0} AS (SELECT drive, {1} FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick))"
_FIR = "0.25 * lag({0}) OVER w + 0.5 * ({0}) + 0.25 * lead({0}) OVER w AS {1}"


@query(f"""WITH {TICKS}, b AS (SELECT drive, {_FIR.format("steer_deg / 10", "ref")}, {_FIR.format("yaw_dps", "yaw")}, {_FIR.format("v_mps * yaw_dps / 57", "ay")} FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)), u AS (SELECT drive, ref, 'yaw' AS term, yaw AS x FROM b UNION ALL SELECT drive, ref, 'ay', ay FROM b)
SELECT drive, term, round(stddev_pop(x), 6) AS sd, round(corr(x, ref), 6) AS r, round(covar_pop(x, ref) / var_pop(x), 6) AS slope FROM u GROUP BY drive, term""")
def band_terms(spark, sf):
    out = sv.band_terms(ticks(spark, sf), "drive", "tick", F.col("steer_deg") / 10, {"yaw": F.col("yaw_dps"), "ay": F.col("v_mps") * F.col("yaw_dps") / 57}, [0.25, 0.5, 0.25])
    return _rounded(out, 6, "drive", "term")


@query(f"""WITH {TICKS}, u AS (SELECT 'yaw' AS quantity, yaw_dps AS x FROM ticks WHERE v_mps > 10 UNION ALL SELECT 'ay', ay_mps2 FROM ticks WHERE v_mps > 10) SELECT quantity, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.01), 5) AS p01, round(quantile_cont(x, 0.5), 5) AS p50, round(quantile_cont(x, 0.99), 5) AS p99 FROM u WHERE x IS NOT NULL GROUP BY quantity""")
def pooled_quantiles(spark, sf):
    out = sv.pooled_quantiles(ticks(spark, sf), F.col("v_mps") > 10, {"yaw": F.col("yaw_dps"), "ay": F.col("ay_mps2")}, [0.01, 0.5, 0.99])
    return out.select("quantity", "n", F.round("mean", 8).alias("mean"), F.round("sd", 6).alias("sd"), *(F.round(p, 5).alias(p) for p in ("p01", "p50", "p99")))


@query(f"""WITH {TICKS}, b AS (SELECT drive, v_mps, {_FIR.format("yaw_dps", "a1")}, {_FIR.format("steer_deg", "b1")}, -0.25 * lag(yaw_dps) OVER w + 0.5 * yaw_dps - 0.25 * lead(yaw_dps) OVER w AS a2, -0.25 * lag(steer_deg) OVER w + 0.5 * steer_deg - 0.25 * lead(steer_deg) OVER w AS b2 FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick))
SELECT drive, count(*) AS n, round(corr(a1, b1), 6) AS r_low, round(stddev_pop(b1) / stddev_pop(a1), 6) AS ratio_low, round(corr(a2, b2), 6) AS r_high, round(stddev_pop(b2) / stddev_pop(a2), 6) AS ratio_high FROM b WHERE v_mps > 8 GROUP BY drive HAVING count(*) >= 10""")
def band_agreement(spark, sf):
    out = sv.band_agreement(ticks(spark, sf), "drive", "tick", F.col("yaw_dps"), F.col("steer_deg"), F.col("v_mps") > 8, {"low": [0.25, 0.5, 0.25], "high": [-0.25, 0.5, -0.25]}, 10)
    return _rounded(out, 6, "drive", "n")


def _shared(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(user_id AS VARCHAR) AS drive_id, CAST(event_id % 60 AS INT) AS segment, event_type, value AS peak_value FROM events")
def csv_round_trip(spark, sf):
    """Events written as CSV and read with their schema; rows without a segment would be left out."""
    at = _shared(spark, "csv")
    s = signals(spark, sf)
    s.select(F.col("drive").cast("string").alias("drive_id"), (F.col("event_id") % 60).cast("int").alias("segment"), F.col("channel").alias("event_type"), F.col("t").alias("t_start"), F.col("t").alias("t_end"), F.col("v").alias("peak_value"), F.lit(None).cast("double").alias("severity")).write.csv(at, header=True)
    return src.read_rows(spark, at, src.EVENT_SCHEMA).select("drive_id", "segment", "event_type", "peak_value")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS n_errors FROM events")
def result_round_trip(spark, sf):
    """Requests written as JSON lines, and read back as results with their number of errors."""
    at = _shared(spark, "requests")
    e = F.col("event_id") % 5
    rows = signals(spark, sf).select("event_id", F.when(e == 0, F.array(F.lit("range"), F.lit("type"))).when(e == 1, F.array(F.lit("range"))).alias("errors"))
    src.write_requests(rows, at)
    return src.read_results(spark, at, "event_id long, errors array<string>").select("event_id", F.col("n_errors").cast("int").alias("n_errors"))


@query("SELECT dataset, count(*) AS n, count(DISTINCT drive) AS drives, round(max(v), 5) AS top FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, user_id AS drive, value AS v FROM events) GROUP BY dataset")
def dataset_switch(spark, sf):
    """Two datasets behind one schema, written by dataset and read again."""
    part = lambda k: lambda s: signals(s, sf).filter(F.col("drive") % 2 == k)
    both = src.union(spark, [src.SegmentSource("even", part(0)), src.SegmentSource("odd", part(1))])
    at = _shared(spark, "tables")
    src.write_tables({"signals": both}, at)
    return spark.read.parquet(f"{at}/signals").groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("drive").alias("drives"), F.round(F.max("v"), 5).alias("top"))


@query(f"WITH {TICKS} SELECT drive, tick, round(v_mps * 3.6, 6) AS kmh, round(yaw_dps * 0.017453292519943295, 9) AS yaw_rad FROM ticks")
def unit_conversion(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(unit_scale(F.col("v_mps"), "m/s", "km/h"), 6).alias("kmh"), F.round(unit_scale(F.col("yaw_dps"), "deg", "rad"), 9).alias("yaw_rad"))


_CONFIG = {"rule": "hard_brake", "limit": -4.0}


@query(f"WITH {TICKS}, {_EVENTS} SELECT id, round(t_start, 5) AS t_start, '{decode.config_hash(_CONFIG)}' AS config FROM ev")
def stamped_rows(spark, sf):
    return _brakes(spark, sf).select("id", F.round("t_start", 5).alias("t_start"), F.lit(decode.config_hash(_CONFIG)).alias("config"))


@query("""SELECT row_number() OVER (ORDER BY value DESC, user_id, ts) AS rank, user_id AS drive, round(value, 5) AS severity, event_type AS event_types, floor(epoch_us(ts) / 1e6 / 60) <> floor((epoch_us(ts) / 1e6 + 2.5) / 60) AS crosses_segment, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS note FROM events""")
def review_sheet(spark, sf):
    c = signals(spark, sf).select("drive", F.col("t").alias("t_start"), (F.col("t") + 2.5).alias("t_end"), F.col("v").alias("severity"), F.array("channel").alias("event_types"))
    return cd.review_sheet(c, "drive", 60.0).select(F.col("rank").cast("long").alias("rank"), "drive", F.round("severity", 5).alias("severity"), "event_types", "crosses_segment", "verdict", "note")
