"""Queries of positions, passes and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import decode as dc, geo
from drivespan.plans.base import DT, SIG, TICKS, query, rounded, signals, table, ticks

_LL = "p AS (SELECT vec_id AS id, 50 + embedding[1]::DOUBLE * 10 AS lat, 10 + embedding[2]::DOUBLE * 10 AS lon FROM embeddings)"


def _latlon(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.get("embedding", 0).cast("double") * 10 + 50).alias("lat"), (F.get("embedding", 1).cast("double") * 10 + 10).alias("lon"))


@query(f"WITH {_LL} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(radians(lon - 10) * 6378137.0 * cos(radians(50.0)), 3) AS east, round(radians(lat - 50) * 6378137.0, 3) AS north FROM p")
def geodetic_round_trip(spark, sf):
    p = _latlon(spark, sf)
    x, y, z = geo.geodetic_to_ecef(F.col("lat"), F.col("lon"))
    p = p.select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon = geo.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    east, north = geo.local_plane(F.col("lat"), F.col("lon"), 50.0, 10.0)
    return p.select("id", lat.alias("lat"), lon.alias("lon")).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("SELECT event_id, user_id * 604800 + value + 315964800 - 18 AS unix FROM events")
def gps_time(spark, sf):
    return signals(spark, sf).select("event_id", geo.gps_to_unix(F.col("drive"), F.col("v")).alias("unix"))


@query(f"WITH {TICKS}, c AS (SELECT drive, degrees(atan2(avg(sin(radians(steer_deg))), avg(cos(radians(steer_deg))))) AS m FROM ticks GROUP BY drive) SELECT drive, round((m % 360 + 360) % 360, 4) AS heading FROM c")
def mean_heading(spark, sf):
    return ticks(spark, sf).groupBy("drive").agg(geo.circular_mean("steer_deg").alias("heading")).select("drive", F.round("heading", 4).alias("heading"))


@query(f"""WITH {TICKS}, h AS (SELECT drive, tick, v_mps, tick * 7.0 % 360 AS hd FROM ticks), s AS (SELECT *, coalesce(-((((180 - (hd - lag(hd) OVER w)) % 360) + 360) % 360 - 180), 0) AS st, first_value(hd) OVER w AS f FROM h WINDOW w AS (PARTITION BY drive ORDER BY tick)), c AS (SELECT *, f + sum(st) OVER (PARTITION BY drive ORDER BY tick) AS c FROM s), m AS (SELECT *, avg(c) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM c)
SELECT drive, tick, round(CASE WHEN v_mps >= 5 THEN (lead(m) OVER w - lag(m) OVER w) / 0.1 END, 4) AS course_rate FROM m WINDOW w AS (PARTITION BY drive ORDER BY tick)""")
def course_rate(spark, sf):
    t = ticks(spark, sf).withColumn("hd", F.pmod(F.col("tick") * 7.0, F.lit(360.0)))
    return geo.course_rate(t, "hd", "v_mps", "drive", "tick", DT, 2, 5.0).select("drive", "tick", F.round("course_rate", 4).alias("course_rate"))


@query(f"WITH {TICKS} SELECT drive, tick, round(v_mps - radians(yaw_dps) * 0.3, 6) AS vx, round(ax_mps2 + radians(yaw_dps) * 1.2, 6) AS vy, round(degrees(atan2(ax_mps2 + radians(yaw_dps) * 1.2, v_mps - radians(yaw_dps) * 0.3)), 5) AS beta FROM ticks")
def translated_velocity(spark, sf):
    x, y, b = geo.translated_velocity(F.col("v_mps"), F.col("ax_mps2"), F.col("yaw_dps"), 1.2, 0.3)
    return ticks(spark, sf).select("drive", "tick", F.round(x, 6).alias("vx"), F.round(y, 6).alias("vy"), F.round(b, 5).alias("beta"))


@query(f"WITH {TICKS} SELECT drive, tick, round(sum(v_mps * 0.05) OVER (PARTITION BY drive ORDER BY tick ROWS UNBOUNDED PRECEDING), 5) AS s FROM ticks")
def distance_driven(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(geo.distance_along(F.col("v_mps"), "drive", "tick", DT), 5).alias("s"))


@query(f"WITH {TICKS}, r AS (SELECT drive, tick - 25.0 AS o, abs(ay_mps2) AS m FROM ticks), g AS (SELECT drive, max(m) FILTER (WHERE abs(o) <= 5) AS peak, arg_max(o, (m, -abs(o), o)) FILTER (WHERE abs(o) <= 5 AND m IS NOT NULL) AS at_, median(m) FILTER (WHERE abs(o) > 5 AND abs(o) <= 20) AS f FROM r GROUP BY drive) SELECT drive, peak, at_ AS peak_at, round(peak / nullif(f, 0), 5) AS contrast FROM g")
def pass_metrics(spark, sf):
    r = ticks(spark, sf).withColumn("o", F.col("tick") - 25.0)
    return geo.pass_metrics(r, ["drive"], "o", "ay_mps2", 5.0, 20.0).withColumn("contrast", rounded("contrast", 5))


@query("""WITH r AS (SELECT event_type || ':' || user_id AS site, (value > 100)::INT AS h, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC) AS r FROM events), g AS (SELECT site, count(*) :: INT AS n, sum(h) :: INT AS hits FROM r WHERE r > 1 GROUP BY site), t AS (SELECT g.*, unnest(range(hits, n + 1)) AS i FROM g),
s AS (SELECT site, n, hits, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8))) AS p FROM t GROUP BY ALL) SELECT site, n, hits, CASE WHEN hits = 0 THEN 0.0 ELSE round(-log10(least(p, 1)), 6) END AS surprise FROM s""")
def repeat_surprise(spark, sf):
    """Binomial surprise of drives' hits without the strongest; the tail sum is compared by tests with exact binomials."""
    s = signals(spark, sf).withColumnRenamed("channel", "site")
    out = geo.repeat_surprise(s.withColumn("site", F.concat_ws(":", "site", "drive")), "site", F.col("v") > 100, "v", 0.2)
    return out.withColumn("surprise", F.round("surprise", 6))


@query(f"WITH {TICKS}, w AS (SELECT drive, tick, avg((v_mps > 8)::INT) OVER x AS e, avg(ay_mps2) OVER x AS m, count(*) OVER x AS n FROM ticks WINDOW x AS (PARTITION BY drive ORDER BY tick ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), k AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY m DESC, tick) AS r FROM w WHERE n = 8 AND e = 1 AND m IS NOT NULL) SELECT drive, tick, e :: DOUBLE AS exposed_share, round(m, 5) AS mean FROM k WHERE r = 1")
def exposed_scan(spark, sf):
    return geo.exposed_scan(ticks(spark, sf), "drive", "tick", F.col("v_mps") > 8, "ay_mps2", 8).withColumn("mean", rounded("mean", 5))


@query(f"WITH {TICKS}, b AS (SELECT drive, floor(t / 0.5) AS b, avg(ax_mps2) AS x, avg(steer_deg) AS y FROM ticks GROUP BY 1, 2) SELECT drive, count(*) AS blocks, round(corr(x, y), 5) AS r FROM b GROUP BY drive")
def block_correlation(spark, sf):
    return geo.block_means(ticks(spark, sf), ["drive"], "t", 0.5, "ax_mps2", "steer_deg").withColumn("r", F.round("r", 5))


@query(f"""WITH {TICKS}, g AS (SELECT drive, CAST(floor(t / 0.5) AS BIGINT) AS win, count(*) AS n, min(v_mps) AS v, regr_slope(steer_deg, t) AS s FROM ticks GROUP BY 1, 2), x AS (SELECT drive, t AS a, t + 0.1 AS b FROM ticks WHERE slip_warn > 3.5) SELECT drive, win, n, round(s, 4) AS slope FROM g WHERE n >= 8 AND v >= 3 AND NOT EXISTS (SELECT 1 FROM x WHERE x.drive = g.drive AND x.a <= (win + 1) * 0.5 + 0.2 AND x.b >= win * 0.5 - 0.2)""")
def calibration_windows(spark, sf):
    t = ticks(spark, sf)
    x = t.filter("slip_warn > 3.5").select("drive", F.col("t").alias("b_start"), (F.col("t") + 0.1).alias("b_end"))
    return geo.calibration_windows(t, "drive", "t", 0.5, x, 0.2, "v_mps", 3.0, 8, "steer_deg").withColumn("slope", F.round("slope", 4))


@query(f"WITH {SIG}, a AS (SELECT drive, min(t) AS a0, max(t) AS a1 FROM sig WHERE channel = 'click' GROUP BY drive), b AS (SELECT drive, min(t) AS b0, max(t) AS b1 FROM sig WHERE channel = 'view' GROUP BY drive) SELECT a.drive, round(greatest(a0, b0) - a0, 3) AS \"offset\", round(greatest(least(a1, b1) - greatest(a0, b0), 0), 3) AS shared_s FROM a JOIN b ON a.drive = b.drive")
def aligned_streams(spark, sf):
    s = signals(spark, sf)
    out = geo.aligned_streams(s.filter("channel = 'click'"), s.filter("channel = 'view'"), "drive", "t")
    return out.select("drive", F.round("offset", 3).alias("offset"), F.round("shared_s", 3).alias("shared_s"))


@query(f"WITH {TICKS}, g AS (SELECT drive, sum(ax_mps2 * yaw_dps + v_mps * steer_deg) AS c, sum(ax_mps2 * steer_deg - v_mps * yaw_dps) AS s FROM ticks GROUP BY drive) SELECT drive, round(degrees(atan2(s, c)), 4) AS angle FROM g")
def horizontal_alignment(spark, sf):
    return geo.horizontal_alignment(ticks(spark, sf), "drive", "ax_mps2", "v_mps", "yaw_dps", "steer_deg").withColumn("angle", F.round("angle", 4))


@query("""SELECT event_id, q AS quantity, CASE WHEN raw > -998 THEN raw END AS value FROM (SELECT event_id, 'wind' AS q, CASE WHEN event_id % 4 = 0 THEN -999.0 :: DOUBLE ELSE value END AS raw FROM events UNION ALL SELECT event_id, 'temp', CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END FROM events)""")
def weather_observations(spark, sf):
    s = signals(spark, sf)
    raw = s.select("event_id", F.when(F.col("event_id") % 4 == 0, "-999").otherwise(F.col("v").cast("string")).alias("wind"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("drive").cast("string")).alias("temp"), F.when(F.col("event_id") % 2 == 0, "2024-03-01 10:00").otherwise("20240301 1000").alias("at"))
    return dc.weather_long(raw, ["event_id"], ["wind", "temp"], "at", ["yyyy-MM-dd HH:mm", "yyyyMMdd HHmm"]).filter("t is not null").select("event_id", "quantity", "value")
