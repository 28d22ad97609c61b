"""Queries of per-drive checks, event physics and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import drive_checks as ck, islands, timegrid as tg
from drivespan.plans.base import DT, RATE, SIG, TICKS, fir_sql, query, signals, ticks
from drivespan.plans.chains import _EVENTS, _brakes


@query(f"WITH {TICKS} SELECT drive, tick, round({fir_sql('ax_mps2', ck.iso_weight_taps(RATE, 12))}, 8) AS weighted FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)")
def ride_weighting(spark, sf):
    """Weighted vertical acceleration; taps by frequency sampling, whose gains tests compare with the standard's."""
    return ticks(spark, sf).select("drive", "tick", F.round(tg.fir(F.col("ax_mps2"), "drive", "tick", ck.iso_weight_taps(RATE, 12)), 8).alias("weighted"))


@query(f"""WITH {TICKS}, l AS (SELECT unnest(range(-3, 4)) AS lag), m AS (SELECT a.drive, l.lag, corr(a.yaw_dps, b.steer_deg) AS r FROM ticks a CROSS JOIN l JOIN ticks b ON b.drive = a.drive AND b.tick = a.tick + l.lag GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY r DESC, abs(lag), lag DESC) AS n FROM m) SELECT drive, CAST(lag AS INTEGER) AS lag, round(r, 5) AS r FROM k WHERE n = 1""")
def drive_clock_lags(spark, sf):
    return ck.drive_lags(ticks(spark, sf), "yaw_dps", "steer_deg", "drive", "tick", list(range(-3, 4))).withColumn("r", F.round("r", 5))


@query(f"WITH {TICKS} SELECT a.drive, a.tick, a.yaw_dps, b.steer_deg FROM ticks a JOIN ticks b ON b.drive = a.drive AND b.tick = a.tick + a.drive % 3")
def synchronised_clocks(spark, sf):
    t = ticks(spark, sf)
    lags = t.select("drive", (F.col("drive") % 3).alias("lag")).distinct()
    return ck.synchronised(t.select("drive", "tick", "yaw_dps"), t.select("drive", "tick", "steer_deg"), lags, "drive", "tick")


@query(f"""WITH {TICKS}, p AS (SELECT drive, 0.5 :: DOUBLE AS f, round(pow(sum(yaw_dps * cos(2 * pi() * 0.5 * t)), 2) + pow(sum(yaw_dps * sin(2 * pi() * 0.5 * t)), 2), 4) AS p FROM ticks GROUP BY drive UNION ALL SELECT drive, 1.2, round(pow(sum(yaw_dps * cos(2 * pi() * 1.2 * t)), 2) + pow(sum(yaw_dps * sin(2 * pi() * 1.2 * t)), 2), 4) FROM ticks GROUP BY drive UNION ALL SELECT drive, 3.0, round(pow(sum(yaw_dps * cos(2 * pi() * 3.0 * t)), 2) + pow(sum(yaw_dps * sin(2 * pi() * 3.0 * t)), 2), 4) FROM ticks GROUP BY drive)
SELECT drive, arg_max(f, (p, -f)) AS hz, round(max(p), 1) AS power FROM p GROUP BY drive""")
def dominant_bands(spark, sf):
    return ck.dominant_band(ticks(spark, sf), ["drive"], "t", "yaw_dps", [0.5, 1.2, 3.0]).withColumn("power", F.round("power", 1))


@query()
def lobe_rebounds(spark, sf):
    """Lobes after the largest that swing back ever less, compared by tests with a loop."""
    return ck.rebounds(islands.lobes(ticks(spark, sf), "yaw_dps", "drive", "t", 3.0, 0.15), ["drive"])


@query(f"WITH {TICKS}, b AS (SELECT drive, 0.25 * lag(yaw_dps) OVER w + 0.5 * yaw_dps + 0.25 * lead(yaw_dps) OVER w AS x, 0.25 * lag(steer_deg) OVER w + 0.5 * steer_deg + 0.25 * lead(steer_deg) OVER w AS y FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)) SELECT drive, round(var_pop(x), 4) AS var_x, round(var_pop(y), 3) AS var_y, round(pow(corr(x, y), 2), 5) AS coherence FROM b GROUP BY drive")
def band_coherence(spark, sf):
    out = ck.coherence(ticks(spark, sf), "drive", "tick", "yaw_dps", "steer_deg", [0.25, 0.5, 0.25])
    return out.select("drive", F.round("var_x", 4).alias("var_x"), F.round("var_y", 3).alias("var_y"), F.round("coherence", 5).alias("coherence"))


@query(f"""WITH {TICKS}, m AS (SELECT drive, median(yaw_dps) AS o FROM ticks GROUP BY drive), r AS (SELECT t.drive, o, cos(radians(steer_deg)) AS c, sin(radians(steer_deg)) AS s, yaw_dps - o AS e FROM ticks t JOIN m ON m.drive = t.drive), g AS (SELECT drive, o, count(*) AS n, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * e) AS ce, sum(s * e) AS se FROM r GROUP BY drive, o)
SELECT drive, n, round(o, 5) AS "offset", round(sqrt(pow((ce * ss - se * cs) / (cc * ss - cs * cs), 2) + pow((se * cc - ce * cs) / (cc * ss - cs * cs), 2)), 4) AS amplitude FROM g""")
def offset_calibration(spark, sf):
    return ck.offset_calibration(ticks(spark, sf), "drive", "yaw_dps", "steer_deg").select("drive", "n", F.round("offset", 5).alias("offset"), F.round("amplitude", 4).alias("amplitude"))


@query(f"""WITH {TICKS}, {_EVENTS}, m AS (SELECT e.id, k.t >= e.t_start AS i, k.yaw_dps, k.v_mps FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start - 0.5 AND e.t_end), u AS (SELECT id, i, 'yaw_dps' AS c, yaw_dps AS x FROM m UNION ALL SELECT id, i, 'v_mps', v_mps FROM m) SELECT id, c AS "column", round(avg(x) FILTER (WHERE i), 5) AS during, round(avg(x) FILTER (WHERE NOT i), 5) AS before FROM u GROUP BY id, c""")
def event_physics(spark, sf):
    out = ck.event_physics(_brakes(spark, sf), ticks(spark, sf), "drive", "t", 0.5, ["yaw_dps", "v_mps"], 1.0)
    return out.select("id", "column", F.round("during", 5).alias("during"), F.round("before", 5).alias("before"))


@query(f"WITH {TICKS} SELECT drive, count(*) AS n, round(max(t) - min(t), 9) AS seconds, round(avg((v_mps > 15)::INT), 9) AS share_fast, round(count(ax_mps2) / count(*), 9) AS known_ax_mps2, round(avg(ax_mps2), 9) AS mean_ax_mps2, round(stddev_samp(ax_mps2), 9) AS sd_ax_mps2 FROM ticks GROUP BY drive")
def drive_quality(spark, sf):
    out = ck.quality_row(ticks(spark, sf), ["drive"], "t", {"fast": F.col("v_mps") > 15}, ["ax_mps2"])
    return out.select("drive", "n", F.round("seconds", 9).alias("seconds"), F.round("share_fast", 9).alias("share_fast"), F.round("known_ax_mps2", 9).alias("known_ax_mps2"), F.round("mean_ax_mps2", 9).alias("mean_ax_mps2"), F.round("sd_ax_mps2", 9).alias("sd_ax_mps2"))


@query(f"WITH {TICKS} SELECT drive, tick, round(CASE WHEN v_mps >= 1 THEN t - 31.5 / v_mps END, 6) AS t_frame FROM ticks")
def frames_for_distance(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(ck.frame_for_distance(F.col("t"), F.col("v_mps"), 30.0, 1.5), 6).alias("t_frame"))


@query("SELECT 'count' AS \"table\", event_type AS key, count(*) :: DOUBLE AS value FROM events GROUP BY 2 UNION ALL SELECT 'mean', CAST(user_id AS VARCHAR), round(avg(value), 5) FROM events GROUP BY 2")
def score_digest(spark, sf):
    s = signals(spark, sf)
    a = s.groupBy(F.col("channel").alias("k")).agg(F.count("*").alias("v"))
    b = s.groupBy(F.col("drive").alias("k")).agg(F.round(F.avg("v"), 5).alias("v"))
    return ck.digest({"count": a, "mean": b}, "k", "v")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"source":{"dataset":"driver","drive":"' || user_id || '"},"time":{},"detection":{"detector":"rules","event_type":"' || event_type || '"},"attributes":{"even":"true"}}' ELSE '{"source":{"dataset":"driver","drive":"' || user_id || '"},"time":{},"detection":{"detector":"rules","event_type":"' || event_type || '"},"attributes":{}}' END AS record FROM events""")
def canonical_records(spark, sf):
    s = signals(spark, sf)
    r = ck.record("driver", "rules", {"drive": F.col("drive").cast("string"), "event_type": F.col("channel"), "even": F.when(F.col("event_id") % 2 == 0, "true")})
    return s.select("event_id", F.to_json(r).alias("record"))
