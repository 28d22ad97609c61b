"""Queries of sites, weather and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.functions import vehicle as vf
from drivespan.operators import sites as st, stats as ss
from drivespan.plans.align import _PLACES, places
from drivespan.plans.base import DRAW, RATE, SIG, TICKS, query, signals, table, ticks


@query(f"WITH {TICKS} SELECT CAST(floor(v_mps / 5) AS BIGINT) AS bin, round(median(abs(ax_mps2)), 6) AS base, count(*) AS n FROM ticks WHERE ax_mps2 IS NOT NULL GROUP BY 1")
def speed_baseline(spark, sf):
    t = ticks(spark, sf).withColumn("x", F.abs("ax_mps2"))
    return st.speed_baseline(t, "v_mps", "x", 5.0).withColumn("base", F.round("base", 6))


@query(f"""WITH {TICKS}, b AS (SELECT CAST(floor(v_mps / 5) AS BIGINT) AS bin, median(abs(ax_mps2)) AS base FROM ticks WHERE ax_mps2 IS NOT NULL AND CAST(floor(v_mps / 5) AS BIGINT) NOT IN (2, 0) GROUP BY 1), e AS (SELECT unnest(range(0, 8)) AS bin),
f AS (SELECT e.bin, coalesce(b.base, CASE WHEN lo.bin IS NULL THEN hi.base WHEN hi.bin IS NULL THEN lo.base ELSE lo.base + (hi.base - lo.base) * (e.bin - lo.bin) / (hi.bin - lo.bin) END) AS base FROM e LEFT JOIN b ON b.bin = e.bin ASOF LEFT JOIN b lo ON e.bin >= lo.bin ASOF LEFT JOIN b hi ON e.bin <= hi.bin)
SELECT drive, tick, round(abs(ax_mps2) / base, 5) AS ratio FROM ticks JOIN f ON f.bin = least(greatest(CAST(floor(v_mps / 5) AS BIGINT), 0), 7)""")
def baseline_ratio(spark, sf):
    t = ticks(spark, sf).withColumn("x", F.abs("ax_mps2"))
    base = st.speed_baseline(t, "v_mps", "x", 5.0).filter("bin not in (2, 0)")
    return st.baseline_ratio(t, base, "v_mps", "x", 5.0, 8).select("drive", "tick", F.round("ratio", 5).alias("ratio"))


_NEAR = lambda r, turn: f"sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {r} AND least((((a.hdg - b.hdg) % 360 + 360) % 360), 360 - (((a.hdg - b.hdg) % 360 + 360) % 360)) <= {turn}"


def _points(spark, sf):
    return places(spark, sf).withColumnsRenamed({"vec_id": "id", "label": "drive"}).withColumn("strength", F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double"))


@query(f"WITH {_PLACES} SELECT a.vec_id AS id, count(DISTINCT b.label) AS drives FROM p a LEFT JOIN p b ON a.label <> b.label AND {_NEAR(15, 60)} GROUP BY 1")
def place_repeats(spark, sf):
    return st.repeats(_points(spark, sf), "x", "y", "hdg", "drive", 15.0, 60.0)


@query()
def greedy_sites(spark, sf):
    """Sites by strongest-first seeding in rounds; tests compare with the plain loop."""
    return st.assign_sites(_points(spark, sf), "x", "y", "hdg", "strength", 20.0, 60.0)


@query()
def site_stretches(spark, sf):
    """Connected components of places; tests compare with union-find."""
    return st.stretches(_points(spark, sf).withColumnRenamed("id", "site"), "x", "y", "hdg", 10.0, 60.0)


@query(f"WITH {_PLACES}, d AS (SELECT a.vec_id AS site, b.vec_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 30 AND least((((a.hdg + 180 - b.hdg) % 360 + 360) % 360), 360 - (((a.hdg + 180 - b.hdg) % 360 + 360) % 360)) <= 30) SELECT site, arg_min(other, (dist, other)) AS other FROM d GROUP BY site")
def opposite_sites(spark, sf):
    return st.opposite_links(_points(spark, sf).withColumnRenamed("id", "site"), "x", "y", "hdg", 30.0)


@query(f"""WITH {_PLACES}, s AS (SELECT * FROM p), n AS (SELECT b.vec_id AS site, a.label AS drive, a.vec_id * 60.0 AS t, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM p a JOIN s b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 30),
g AS (SELECT *, sum(CASE WHEN t - l > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY site, drive ORDER BY t) AS pass FROM (SELECT *, lag(t) OVER (PARTITION BY site, drive ORDER BY t) AS l FROM n))
SELECT site, drive, CAST(pass AS BIGINT) AS pass, min(t) :: DOUBLE AS t_start, max(t) :: DOUBLE AS t_end, arg_min(t, (dist, t)) :: DOUBLE AS t_near, round(min(dist), 5) AS dist FROM g GROUP BY site, drive, pass""")
def site_passes(spark, sf):
    p = _points(spark, sf).withColumn("t", F.col("id") * 60.0)
    s = p.select(F.col("id").alias("site"), "x", "y")
    return st.site_passes(s, p.select("drive", "t", "x", "y"), "x", "y", 30.0, "drive", "t", 6000.0).withColumn("dist", F.round("dist", 5))


@query("SELECT event_type AS site, arg_max(event_id, (value, -event_id)) AS best, max(value) AS score, count(*) AS n, round(median(value), 5) AS median FROM events GROUP BY 1")
def best_per_site(spark, sf):
    e = signals(spark, sf).select(F.col("channel").alias("site"), F.col("event_id").alias("id"), "v")
    return st.best_per_site(e, "site", "v").withColumn("median", F.round("median", 5))


@query("SELECT event_id, CASE WHEN value > 450 THEN 1 WHEN event_type = 'error' THEN 2 WHEN user_id % 2 = 0 THEN 3 ELSE 4 END AS class FROM events")
def priority_classes(spark, sf):
    return signals(spark, sf).select("event_id", st.priority_class([F.col("v") > 450, F.col("channel") == "error", F.col("drive") % 2 == 0]).alias("class"))


@query(f"""WITH {_PLACES}, d AS (SELECT a.vec_id AS id, b.vec_id AS way, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, least((((a.hdg - b.hdg) % 360 + 360) % 360), 360 - (((a.hdg - b.hdg) % 360 + 360) % 360)) AS h, b.label % 2 = 0 AS oneway FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40)
SELECT id, arg_min(way, (dist, way)) AS way, round(min(dist), 5) AS dist FROM d WHERE h <= 25 OR (NOT oneway AND 180 - h <= 25) GROUP BY id""")
def road_match(spark, sf):
    p = _points(spark, sf)
    w = p.select(F.col("id").alias("way"), "x", "y", F.col("hdg").alias("bearing"), (F.col("drive") % 2 == 0).alias("oneway"))
    return st.road_match(p, w, "x", "y", "hdg", 40.0, 25.0).withColumn("dist", F.round("dist", 5))


@query(f"""WITH {_PLACES}, q AS (SELECT *, (vec_id * 7919 % 1000) :: DOUBLE AS s FROM p), m AS (SELECT a.vec_id AS id, a.s, b.label, max(b.s) AS m FROM q a JOIN q b ON a.label <> b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40 GROUP BY ALL) SELECT id, count(*) AS others, round(avg((m >= s)::INT), 6) AS share FROM m GROUP BY id""")
def place_uniqueness(spark, sf):
    p = _points(spark, sf).select("id", "drive", "x", "y", "strength")
    return st.uniqueness(p, p, "x", "y", "drive", "strength", 40.0).withColumn("share", F.round("share", 6))


_GEO = "pt AS (SELECT vec_id AS id, embedding[1] * 10 + 50 :: DOUBLE AS lat, embedding[2] * 10 + 10 :: DOUBLE AS lon FROM embeddings), sta AS (SELECT id AS station, lat, lon FROM pt), nb AS (SELECT p.id, s.station, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))) AS d FROM pt p, sta s), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, station) AS rank FROM nb WHERE d <= 60000)"


def _near_stations(spark, sf):
    e = table(spark, sf, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), (F.get("embedding", 0).cast("double") * 10 + 50).alias("lat"), (F.get("embedding", 1).cast("double") * 10 + 10).alias("lon"))
    return st.weather_near(p, p.withColumnRenamed("id", "station"), 60000.0, 3)


@query(f"WITH {_GEO.replace('embedding[1] *', 'embedding[1]::DOUBLE *').replace('embedding[2] *', 'embedding[2]::DOUBLE *')} SELECT id, station, round(d, 1) AS dist_m, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 3")
def nearby_stations(spark, sf):
    return _near_stations(spark, sf).withColumn("dist_m", F.round("dist_m", 1))


@query("""WITH o AS (SELECT user_id AS k, value AS v, 1 / greatest((event_id % 50 + 1.0 :: DOUBLE) * (event_id % 50 + 1.0), 1) AS w FROM events), t AS (SELECT k, sum(w) AS tw, sum(w * v) AS twv, max(v) - min(v) AS spread, count(*) AS n FROM o GROUP BY k)
SELECT o.k AS drive, round(any_value(twv / tw), 5) AS estimate, round(any_value(spread), 5) AS spread, round(sqrt(avg(pow((twv - w * v) / (tw - w) - v, 2))), 4) AS loo_rmse, any_value(n) AS n FROM o JOIN t ON t.k = o.k GROUP BY o.k""")
def idw_estimate(spark, sf):
    o = signals(spark, sf).withColumn("d", F.col("event_id") % 50 + 1.0)
    return st.idw(o, "drive", "v", "d").select("drive", F.round("estimate", 5).alias("estimate"), F.round("spread", 5).alias("spread"), F.round("loo_rmse", 4).alias("loo_rmse"), "n")


@query(f"WITH {SIG}, d AS (SELECT drive, channel, t, t - lag(t) OVER (PARTITION BY drive, channel ORDER BY t) AS d FROM sig), g AS (SELECT drive, channel, median(d) AS step, count(*) AS n, max(t) - min(t) AS span FROM d GROUP BY ALL) SELECT drive, channel, round(step, 3) AS step, n, round(n / (floor(span / nullif(step, 0)) + 1), 5) AS share FROM g")
def observation_completeness(spark, sf):
    return st.completeness(signals(spark, sf), ["drive", "channel"], "t").select("drive", "channel", F.round("step", 3).alias("step"), "n", F.round("share", 5).alias("share"))


@query("SELECT event_id, CASE WHEN b < 200 THEN 'before' WHEN a > 300 THEN 'after' WHEN a >= 200 AND b <= 300 THEN 'inside' WHEN a <= 200 AND b >= 300 THEN 'covers' ELSE 'overlaps' END AS relation, round(greatest(least(b, 300) - greatest(a, 200), 0), 5) AS shared FROM (SELECT event_id, value AS a, value + user_id AS b FROM events)")
def interval_relation(spark, sf):
    rel, shared = st.relation(F.col("v"), F.col("v") + F.col("drive"), F.lit(200.0), F.lit(300.0))
    return signals(spark, sf).select("event_id", rel.alias("relation"), F.round(shared, 5).alias("shared"))


@query(f"""WITH {SIG}, g AS (SELECT *, sum(CASE WHEN t - l <= 20000 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY t, channel) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY drive ORDER BY t, channel) AS l FROM sig)) SELECT drive, arg_max(t, (v, -t)) AS t, max(v) AS v, array_to_string(list_sort(list(DISTINCT channel)), '|') AS settings FROM g GROUP BY drive, g""")
def unique_candidates(spark, sf):
    return st.unique_candidates(signals(spark, sf), "drive", "t", "v", "channel", 20000.0).withColumn("settings", F.array_join("settings", "|"))


@query(f"WITH {TICKS} SELECT drive, CAST(floor(t / 0.5) AS BIGINT) AS win, count(v_mps) AS n, round(avg(v_mps), 5) AS v_mean, round(max(v_mps) - min(v_mps), 5) AS v_range FROM ticks GROUP BY drive, 2 HAVING count(v_mps) >= 10 AND max(v_mps) - min(v_mps) <= 9.5 AND max(abs(yaw_dps)) <= 18.5")
def straight_windows(spark, sf):
    out = st.straight_windows(ticks(spark, sf), ["drive"], "t", 0.5, 10, "v_mps", "yaw_dps", 9.5, 18.5)
    return out.select("drive", "win", "n", F.round("v_mean", 5).alias("v_mean"), F.round("v_range", 5).alias("v_range"))


@query(f"WITH {TICKS}, m AS (SELECT drive, max(abs(ay_mps2)) AS m, arg_max(t, (abs(ay_mps2), -t)) FILTER (WHERE ay_mps2 IS NOT NULL) AS t_peak FROM ticks GROUP BY drive) SELECT k.drive, round(m.t_peak, 5) AS t_peak, round(min(k.t), 5) AS t_hit FROM ticks k JOIN m ON m.drive = k.drive WHERE abs(k.ay_mps2) >= 0.5 * m.m GROUP BY ALL")
def hit_times(spark, sf):
    return st.hit_time(ticks(spark, sf).filter("ay_mps2 is not null"), "drive", "t", "ay_mps2").select("drive", F.round("t_peak", 5).alias("t_peak"), F.round("t_hit", 5).alias("t_hit"))


@query(f"WITH {TICKS}, w AS (SELECT drive, floor(t / 1.0) AS w, max(abs(ay_mps2)) AS m FROM ticks GROUP BY ALL) SELECT drive, count(*) AS windows, CAST(sum((m > 5)::INT) AS BIGINT) AS hits, round(sum((m > 5)::INT) * 3600.0 / count(*), 4) AS per_hour FROM w GROUP BY drive")
def exceedance_rate(spark, sf):
    return st.exceedance_rate(ticks(spark, sf), ["drive"], "t", "ay_mps2", 1.0, 5.0).withColumn("per_hour", F.round("per_hour", 4))


@query(f"WITH {TICKS}, g AS (SELECT drive, sqrt(avg(ax_mps2 ** 2)) AS rms, pow(sum(pow(ax_mps2, 4)) / 20.0, 0.25) AS vdv, max(abs(ax_mps2)) AS p FROM ticks GROUP BY drive) SELECT drive, round(rms, 5) AS rms, round(vdv, 4) AS vdv, round(p / rms, 5) AS crest, CASE WHEN rms < 0.315 THEN 'not uncomfortable' WHEN rms < 0.63 THEN 'a little' WHEN rms < 1 THEN 'fairly' WHEN rms < 1.6 THEN 'uncomfortable' WHEN rms < 2.5 THEN 'very' ELSE 'extremely' END AS comfort FROM g")
def ride_dose(spark, sf):
    return st.ride_dose(ticks(spark, sf), ["drive"], "ax_mps2", RATE).select("drive", F.round("rms", 5).alias("rms"), F.round("vdv", 4).alias("vdv"), F.round("crest", 5).alias("crest"), "comfort")


@query(f"WITH {TICKS} SELECT drive, tick, round(-v_mps * sin(radians(yaw_dps - steer_deg)), 5) AS left_wind, round(v_mps * cos(radians(yaw_dps - steer_deg)), 5) AS head_wind FROM ticks")
def wind_components(spark, sf):
    c = F.col
    return ticks(spark, sf).select("drive", "tick", F.round(vf.left_wind(c("v_mps"), c("yaw_dps"), c("steer_deg")), 5).alias("left_wind"), F.round(vf.head_wind(c("v_mps"), c("yaw_dps"), c("steer_deg")), 5).alias("head_wind"))


@query("""WITH r AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT k, count(*) :: DOUBLE AS n, round(regr_intercept(y, x), 2) AS b_0, round(regr_slope(y, x), 3) AS b_1, round(regr_r2(y, x), 5) AS r2 FROM r GROUP BY k""")
def least_squares(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.lit(1.0).alias("one"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return ss.fit_with_r2(df, ["k"], ["one", "x"], "y").select("k", "n", F.round("b_0", 2).alias("b_0"), F.round("b_1", 3).alias("b_1"), F.round("r2", 5).alias("r2"))


@query("""WITH r AS (SELECT l_suppkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT a.fold, regr_intercept(b.y, b.x) AS b0, regr_slope(b.y, b.x) AS b1 FROM (SELECT DISTINCT fold FROM r) a JOIN r b ON b.fold <> a.fold GROUP BY a.fold) SELECT r.fold, count(*) AS n, round(sqrt(avg(pow(y - b0 - b1 * x, 2))), 2) AS rmse FROM r JOIN f ON f.fold = r.fold GROUP BY r.fold""")
def cross_validated_fit(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("fold"), F.lit(1.0).alias("one"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return ss.cross_validated(df, "fold", ["one", "x"], "y").withColumn("rmse", F.round("rmse", 2))


@query("""WITH m AS (SELECT l_suppkey AS site, count(*) AS n, sum(l_quantity ** 2) - sum(l_quantity) ** 2 / count(*) AS cxx, sum(l_extendedprice ** 2) - sum(l_extendedprice) ** 2 / count(*) AS cyy, sum(l_quantity * l_extendedprice) - sum(l_quantity) * sum(l_extendedprice) / count(*) AS cxy FROM lineitem GROUP BY 1) SELECT site, n, round(cxy / cxx, 3) AS slope, round(cxy / cxx / sqrt((cyy - cxy / cxx * cxy) / (n - 2) / cxx), 3) AS t FROM m""")
def within_site_slope(spark, sf):
    out = ss.within_slope(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "site"), "site", "l_quantity", "l_extendedprice")
    return out.select("site", "n", F.round("slope", 3).alias("slope"), F.round("t", 3).alias("t"))


@query(f"""WITH p AS (SELECT event_id % 40 AS site, user_id AS drive, avg(value) AS x, avg(value * 0.5 + user_id) AS y FROM events GROUP BY ALL), d AS (SELECT site, drive, x - avg(x) OVER (PARTITION BY site) AS x, y - avg(y) OVER (PARTITION BY site) AS y, row_number() OVER (PARTITION BY site ORDER BY drive) - 1 AS k, count(*) OVER (PARTITION BY site) AS m FROM p),
o AS (SELECT sum(x * y) / sum(x * x) AS slope FROM d), s AS (SELECT r, sum(b.x * a.y) / sum(b.x * b.x) AS s FROM d a, range(99) q(r), d b WHERE b.site = a.site AND b.k = (a.k + floor({DRAW.format("'3:' || r || ':' || a.site")} * a.m)) % a.m GROUP BY r)
SELECT round(any_value(slope), 8) AS slope, round((sum((abs(s) >= abs(slope))::INT) + 1) / (count(*) + 1), 8) AS p FROM s, o""")
def pooled_permutation(spark, sf):
    """Pooled slope with a permutation p by drive; tests check a planted and a null effect."""
    df = signals(spark, sf).select((F.col("event_id") % 40).alias("site"), "drive", F.col("v").alias("x"), (F.col("v") * 0.5 + F.col("drive")).alias("y"))
    return ss.pooled_permutation(df, "site", "drive", "x", "y", 99, 3).select(F.round("slope", 8).alias("slope"), F.round("p", 8).alias("p"))


@query("""WITH g AS (SELECT user_id AS drive, count(*) AS n, avg(value) FILTER (WHERE event_id % 2 = 0) AS a, avg(value) FILTER (WHERE event_id % 2 = 1) AS b, var_samp(value) FILTER (WHERE event_id % 2 = 0) / count(*) FILTER (WHERE event_id % 2 = 0) + var_samp(value) FILTER (WHERE event_id % 2 = 1) / count(*) FILTER (WHERE event_id % 2 = 1) AS s FROM events GROUP BY 1) SELECT drive, n, round(a - b, 4) AS diff, round(sqrt(s), 4) AS se, round((a - b) / sqrt(s), 4) AS k FROM g""")
def direction_reversal(spark, sf):
    df = signals(spark, sf).withColumn("s", F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0))
    return ss.reversal(df, "drive", "s", "v").select("drive", "n", *(F.round(c, 4).alias(c) for c in ("diff", "se", "k")))


@query("""WITH n AS (SELECT value AS v FROM events WHERE event_type <> 'error'), e AS (SELECT event_id, value AS v FROM events WHERE event_type = 'error'), c AS (SELECT count(*) AS n FROM n), r AS (SELECT e.event_id, count(n.v) AS k FROM e LEFT JOIN n ON n.v >= e.v GROUP BY 1) SELECT event_id, round(-log10((k + 1) / (c.n + 1)), 6) AS surprise FROM r, c""")
def empirical_surprise(spark, sf):
    s = signals(spark, sf)
    return ss.surprise(s.filter("channel = 'error'").select("event_id", "v"), s.filter("channel <> 'error'").select("v"), "v").select("event_id", F.round("surprise", 6).alias("surprise"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY round(value)) + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS b FROM events) SELECT event_type AS channel, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def rank_correlation(spark, sf):
    s = signals(spark, sf).withColumn("x", F.round("v"))
    return ss.spearman(s, ["channel"], "x", "drive").withColumn("rho", F.round("rho", 6))


@query("""WITH p AS (SELECT event_id % 60 AS cell, user_id AS drive, median(value) AS m FROM events GROUP BY ALL) SELECT a.cell, a.drive, round(median(b.m), 5) AS baseline FROM p a JOIN p b ON b.cell = a.cell AND b.drive <> a.drive GROUP BY ALL HAVING count(*) >= 3""")
def leave_own_out_baseline(spark, sf):
    s = signals(spark, sf).withColumn("cell", F.col("event_id") % 60)
    return ss.leave_own_out_median(s, "cell", "drive", "v").withColumn("baseline", F.round("baseline", 5))
