"""Queries of the time grid and the joins: resampling, rolling operators, as-of, runs."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from drivespan.operators import islands, joins, timegrid as tg
from drivespan.plans.base import DT, RATE, SIG, TICKS, fir_sql, query, signals, table, ticks

STEP, GAP = 21600.0, 172800.0
_SPANS = "spans AS (SELECT drive, max(a) AS t0, min(b) AS t1 FROM (SELECT drive, channel, min(t) AS a, max(t) AS b FROM sig GROUP BY ALL) GROUP BY drive)"
_GRID = "grid AS (SELECT drive, tick, tick * 21600.0 :: DOUBLE AS t FROM (SELECT drive, unnest(generate_series(CAST(ceil(t0 / 21600.0) AS BIGINT), CAST(floor(t1 / 21600.0) AS BIGINT))) AS tick FROM spans WHERE ceil(t0 / 21600.0) <= floor(t1 / 21600.0)))"


@query(f"WITH {SIG}, {_SPANS} SELECT drive, t0, t1 FROM spans")
def common_span(spark, sf):
    return tg.common_span(signals(spark, sf), "drive", "channel", "t")


@query(f"WITH {SIG}, {_SPANS}, {_GRID} SELECT * FROM grid")
def uniform_grid(spark, sf):
    return tg.grid(tg.common_span(signals(spark, sf), "drive", "channel", "t"), STEP)


def _grid(spark, sf):
    return tg.grid(tg.common_span(signals(spark, sf), "drive", "channel", "t"), STEP)


@query(f"""WITH {SIG}, {_SPANS}, {_GRID},
s AS (SELECT drive, t, v FROM sig WHERE channel = 'click'),
a AS (SELECT g.drive, g.tick, g.t, s.t AS ta, s.v AS va FROM grid g ASOF LEFT JOIN s ON g.drive = s.drive AND g.t >= s.t),
b AS (SELECT g.drive, g.tick, s.t AS tb, s.v AS vb FROM grid g ASOF LEFT JOIN s ON g.drive = s.drive AND g.t <= s.t)
SELECT a.drive, a.tick, a.t, round(CASE WHEN ta = a.t THEN va WHEN tb - ta <= 172800 THEN va + (vb - va) * (a.t - ta) / (tb - ta) END, 6) AS value
FROM a JOIN b ON a.drive = b.drive AND a.tick = b.tick""")
def resample_linear(spark, sf):
    s = signals(spark, sf)
    return tg.resample_linear(_grid(spark, sf), s.filter("channel = 'click'"), "drive", "t", "v", GAP).withColumn("value", F.round("value", 6))


@query(f"""WITH {SIG}, {_SPANS}, {_GRID}, s AS (SELECT drive, t, v FROM sig WHERE channel = 'error')
SELECT g.drive, g.tick, g.t, CASE WHEN g.t - s.t <= 172800 THEN s.v END AS value FROM grid g ASOF LEFT JOIN s ON g.drive = s.drive AND g.t >= s.t""")
def resample_flag_hold(spark, sf):
    return tg.resample_hold(_grid(spark, sf), signals(spark, sf).filter("channel = 'error'"), "drive", "t", "v", GAP)


@query(f"""WITH {SIG}, {_SPANS}, {_GRID}, hit AS (SELECT DISTINCT drive, CAST(floor(t / 21600.0) AS BIGINT) AS tick FROM sig WHERE channel = 'view')
SELECT g.drive, g.tick, g.t, CASE WHEN hit.tick IS NULL THEN 0.0 ELSE 1.0 END :: DOUBLE AS value FROM grid g LEFT JOIN hit ON hit.drive = g.drive AND hit.tick = g.tick""")
def occupancy(spark, sf):
    return tg.occupancy(_grid(spark, sf), signals(spark, sf).filter("channel = 'view'"), "drive", "t", STEP)


_WIDE = "wide AS (SELECT drive, tick, tick * 86400.0 :: DOUBLE AS t, avg(v) FILTER (WHERE channel = 'click') AS click, avg(v) FILTER (WHERE channel = 'error') AS error, avg(v) FILTER (WHERE channel = 'view') AS \"view\" FROM (SELECT *, CAST(floor(t / 86400.0) AS BIGINT) AS tick FROM sig) WHERE channel IN ('click', 'error', 'view') GROUP BY drive, tick)"
CHANNELS = ["click", "error", "view"]


def _wide(spark, sf):
    long = signals(spark, sf).filter(F.col("channel").isin(CHANNELS)).withColumn("tick", F.floor(F.col("t") / 86400.0)).withColumn("t", F.col("tick") * 86400.0)
    return tg.to_wide(long, "drive", "channel", "v", CHANNELS)


@query(f'WITH {SIG}, {_WIDE} SELECT drive, tick, t, round(click, 6) AS click, round(error, 6) AS error, round("view", 6) AS "view" FROM wide')
def long_to_wide(spark, sf):
    return _wide(spark, sf).select("drive", "tick", "t", *(F.round(c, 6).alias(c) for c in CHANNELS))


@query(f"""WITH {SIG}, {_WIDE} SELECT drive, channel, round(cov, 6) AS coverage FROM (
SELECT drive, 'click' AS channel, avg((click IS NOT NULL)::INT) AS cov FROM wide GROUP BY drive UNION ALL
SELECT drive, 'error', avg((error IS NOT NULL)::INT) FROM wide GROUP BY drive UNION ALL SELECT drive, 'view', avg(("view" IS NOT NULL)::INT) FROM wide GROUP BY drive)""")
def channel_coverage(spark, sf):
    return tg.coverage(_wide(spark, sf), "drive", CHANNELS).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {TICKS} SELECT drive, tick, round(CASE WHEN r > 4 AND r <= n - 4 THEN m END, 6) AS smooth FROM (
SELECT drive, tick, avg(ax_mps2) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m, row_number() OVER (PARTITION BY drive ORDER BY tick) AS r, count(*) OVER (PARTITION BY drive) AS n FROM ticks)""")
def moving_average(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(tg.moving_average(F.col("ax_mps2"), "drive", "tick", tg.window_samples(0.4, RATE)), 6).alias("smooth"))


_W7 = "OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"""WITH {TICKS} SELECT drive, tick, CASE WHEN c >= 3 THEN lo END AS lo, CASE WHEN c >= 3 THEN hi END AS hi, round(CASE WHEN c >= 3 THEN mean END, 6) AS mean, CASE WHEN c >= 3 THEN am END AS absmax,
round(CASE WHEN c >= 3 AND r > 3 AND r <= n - 3 THEN med END, 6) AS med FROM (SELECT drive, tick, min(ay_mps2) {_W7} AS lo, max(ay_mps2) {_W7} AS hi, avg(ay_mps2) {_W7} AS mean, max(abs(ay_mps2)) {_W7} AS am, median(ay_mps2) {_W7} AS med, count(ay_mps2) {_W7} AS c,
row_number() OVER (PARTITION BY drive ORDER BY tick) AS r, count(*) OVER (PARTITION BY drive) AS n FROM ticks)""")
def rolling_windows(spark, sf):
    x = F.col("ay_mps2")
    r = lambda how: tg.rolling(x, "drive", "tick", 7, how)
    return ticks(spark, sf).select("drive", "tick", r("min").alias("lo"), r("max").alias("hi"), F.round(r("mean"), 6).alias("mean"), r("absmax").alias("absmax"), F.round(r("median"), 6).alias("med"))


@query(f"WITH {TICKS} SELECT drive, tick, round((lead(ax_mps2) OVER w - lag(ax_mps2) OVER w) / 0.1, 6) AS jerk FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)")
def central_difference(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(tg.derivative(F.col("ax_mps2"), "drive", "tick", DT), 6).alias("jerk"))


@query(f"""WITH {TICKS}, big AS (SELECT drive, tick, t, sign(steer_deg) AS s FROM ticks WHERE abs(steer_deg) > 20),
ch AS (SELECT drive, t FROM (SELECT *, lag(s) OVER (PARTITION BY drive ORDER BY tick) AS p FROM big) WHERE p <> s)
SELECT k.drive, k.tick, CAST(count(ch.t) AS DOUBLE) AS reversals FROM ticks k LEFT JOIN ch ON ch.drive = k.drive AND round(ch.t * 1000) <= round(k.t * 1000) AND round(ch.t * 1000) > round(k.t * 1000) - 1500 GROUP BY k.drive, k.tick""")
def steering_reversals(spark, sf):
    return tg.count_reversals(ticks(spark, sf), F.col("steer_deg"), "drive", "t", 20.0, 1.5).select("drive", "tick", "reversals")


@query(f"WITH {TICKS} SELECT drive, tick, last_value(lead_m IGNORE NULLS) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS held FROM ticks")
def hold_forward(spark, sf):
    return ticks(spark, sf).select("drive", "tick", tg.hold_forward(F.col("lead_m"), "drive", "tick", 5).alias("held"))


@query(f"WITH {TICKS} SELECT drive, tick, coalesce(bool_or(ax_mps2 < -5) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), false) AS near FROM ticks")
def dilated_mask(spark, sf):
    return ticks(spark, sf).select("drive", "tick", tg.dilate(F.col("ax_mps2") < -5, "drive", "tick", 2).alias("near"))


@query(f"WITH {TICKS} SELECT drive, tick, round(sum(yaw_dps * 0.05) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING), 6) AS turned FROM ticks")
def net_heading(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(tg.net_heading(F.col("yaw_dps"), "drive", "tick", DT, 10), 6).alias("turned"))


@query(f"""WITH {TICKS} SELECT drive, tick, round(steer_deg - m, 6) AS fast, round(m, 6) AS slow, q < 400 AS quiet FROM (SELECT drive, tick, steer_deg, avg(steer_deg) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m,
max(abs(d)) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS q FROM (SELECT *, (lead(steer_deg) OVER (PARTITION BY drive ORDER BY tick) - lag(steer_deg) OVER (PARTITION BY drive ORDER BY tick)) / 0.1 AS d FROM ticks))""")
def detrended_and_quiet(spark, sf):
    t = ticks(spark, sf).withColumn("d", tg.derivative(F.col("steer_deg"), "drive", "tick", DT))
    fast, slow = tg.detrend(F.col("steer_deg"), "drive", "tick", 21)
    return t.select("drive", "tick", F.round(fast, 6).alias("fast"), F.round(slow, 6).alias("slow"), tg.quiet_prior(F.col("d"), "drive", "tick", 6, 400.0).alias("quiet"))


@query(f"""WITH {TICKS}, lags AS (SELECT unnest(range(-4, 5)) AS lag), p AS (SELECT a.drive, l.lag, a.yaw_dps AS x, b.steer_deg AS y FROM ticks a CROSS JOIN lags l JOIN ticks b ON b.drive = a.drive AND b.tick = a.tick + l.lag),
m AS (SELECT drive, lag, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM p GROUP BY drive, lag),
pool AS (SELECT lag, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM m GROUP BY lag),
r AS (SELECT lag, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM pool),
nb AS (SELECT lag, r, lag(r) OVER (ORDER BY lag) AS a, lead(r) OVER (ORDER BY lag) AS b FROM r)
SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS r, round(lag + coalesce(0.5 * (a - b) / nullif(a - 2 * r + b, 0), 0), 5) AS peak FROM nb ORDER BY r DESC, lag LIMIT 1""")
def lag_search(spark, sf):
    m = tg.lag_correlations(ticks(spark, sf), "yaw_dps", "steer_deg", "drive", "tick", list(range(-4, 5)))
    return tg.lag_search(m, "drive").select("lag", F.round("r", 6).alias("r"), F.round("peak", 5).alias("peak"))


@query(f"""WITH {TICKS} SELECT drive, tick, round(0.25 * lag(ax_mps2) OVER w + 0.5 * ax_mps2 + 0.25 * lead(ax_mps2) OVER w, 6) AS smooth,
round(sqrt(avg(yaw_dps * yaw_dps) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), 6) AS rms FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)""")
def fir_and_rms(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(tg.fir(F.col("ax_mps2"), "drive", "tick", [0.25, 0.5, 0.25]), 6).alias("smooth"), F.round(tg.moving_rms(F.col("yaw_dps"), "drive", "tick", 11), 6).alias("rms"))


@query(f"WITH {TICKS}, b AS (SELECT drive, tick, {fir_sql('yaw_dps', tg.bandpass_taps(1.0, 3.0, RATE, 10))} AS band FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)) SELECT drive, tick, round(band, 8) AS band, round(sqrt(avg(band * band) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), 8) AS envelope FROM b")
def band_envelopes(spark, sf):
    """Band-passed yaw and its moving RMS, by windowed-sinc taps."""
    t = ticks(spark, sf).withColumn("band", tg.fir(F.col("yaw_dps"), "drive", "tick", tg.bandpass_taps(1.0, 3.0, RATE, 10)))
    return t.select("drive", "tick", F.round("band", 8).alias("band"), F.round(tg.moving_rms(F.col("band"), "drive", "tick", 11), 8).alias("envelope"))


_DECAY = [math.exp(-k / 4.0) for k in range(20)]


@query(f"WITH {TICKS} SELECT drive, tick, round({fir_sql('steer_deg', [a / sum(_DECAY) for a in _DECAY], lag_only=True)}, 8) AS lagged FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)")
def first_order_lag(spark, sf):
    """Steering through a lag of 0.2 s; taps are exponentials, compared by tests with the recursion."""
    return ticks(spark, sf).select("drive", "tick", F.round(tg.first_order_lag(F.col("steer_deg"), "drive", "tick", 4.0, 20), 8).alias("lagged"))


@query(f"""WITH {TICKS}, w AS (SELECT a.drive, a.tick, a.yaw_dps AS y, count(*) AS n, sum(b.yaw_dps) AS sy, sum(b.yaw_dps * power((b.tick - a.tick) * 0.05, 2)) AS y2 FROM ticks a JOIN ticks b ON b.drive = a.drive AND b.tick BETWEEN a.tick - 6 AND a.tick + 6 GROUP BY ALL),
s AS (SELECT sum(power(k * 0.05, 2)) AS s2, sum(power(k * 0.05, 4)) AS s4 FROM (SELECT unnest(range(-6, 7)) AS k))
SELECT drive, tick, round(CASE WHEN n = 13 THEN y - (s4 * sy - s2 * y2) / (13 * s4 - s2 * s2) END, 4) AS off FROM w, s""")
def quadratic_deviation(spark, sf):
    return ticks(spark, sf).select("drive", "tick", F.round(tg.quadratic_deviation(F.col("yaw_dps"), "drive", "tick", 6, DT), 4).alias("off"))


_VIEW = "s AS (SELECT drive, t, v FROM sig WHERE channel = 'view'), c AS (SELECT drive, t, event_id FROM sig WHERE channel = 'click')"


@query(f"WITH {SIG}, {_VIEW} SELECT c.drive, c.event_id, CASE WHEN c.t - s.t <= 86400 THEN s.v END AS matched FROM c ASOF LEFT JOIN s ON c.drive = s.drive AND c.t >= s.t")
def asof_backward(spark, sf):
    s = signals(spark, sf)
    return joins.asof(s.filter("channel = 'click'").select("drive", "t", "event_id"), s.filter("channel = 'view'"), "drive", "t", "v", tolerance=86400.0).select("drive", "event_id", "matched")


@query(f"""WITH {SIG}, {_VIEW}, n AS (SELECT c.drive, c.event_id, s.v, abs(s.t - c.t) AS d, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(s.t - c.t), s.t) AS r FROM c LEFT JOIN s ON s.drive = c.drive)
SELECT drive, event_id, CASE WHEN d <= 43200 THEN v END AS matched FROM n WHERE r = 1""")
def asof_nearest(spark, sf):
    s = signals(spark, sf)
    return joins.asof(s.filter("channel = 'click'").select("drive", "t", "event_id"), s.filter("channel = 'view'"), "drive", "t", "v", "nearest", 43200.0).select("drive", "event_id", "matched")


@query("""WITH i AS (SELECT DISTINCT user_id AS drive, CAST(floor(epoch_us(ts) / 1e6 / 86400.0) AS BIGINT) AS idx FROM events),
g AS (SELECT *, sum(CASE WHEN idx - p <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY idx) - 1 AS block FROM (SELECT *, lag(idx) OVER (PARTITION BY drive ORDER BY idx) AS p FROM i))
SELECT drive, idx, CAST(block AS BIGINT) AS block FROM g""")
def contiguous_blocks(spark, sf):
    days = signals(spark, sf).select("drive", F.floor(F.col("t") / 86400.0).alias("idx")).distinct()
    return tg.blocks(days, "drive", "idx")


@query("""WITH i AS (SELECT DISTINCT user_id AS drive, CAST(floor(epoch_us(ts) / 1e6 / 86400.0) AS BIGINT) AS idx FROM events), g AS (SELECT *, idx - row_number() OVER (PARTITION BY drive ORDER BY idx) AS g FROM i),
r AS (SELECT drive, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY drive, g) SELECT drive, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY n DESC, first) AS k FROM r) WHERE k = 1""")
def longest_run(spark, sf):
    return islands.longest_run(signals(spark, sf).select("drive", F.floor(F.col("t") / 86400.0).alias("idx")), "drive", "idx")


@query(f"""WITH {SIG}, o AS (SELECT DISTINCT drive, t FROM sig), g AS (SELECT drive, t, sum(CASE WHEN t - p > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY t) AS block FROM (SELECT *, lag(t) OVER (PARTITION BY drive ORDER BY t) AS p FROM o))
SELECT drive, CAST(block AS BIGINT) AS block, min(t) AS t0, max(t) AS t1, count(*) AS n FROM g GROUP BY drive, block""")
def recording_blocks(spark, sf):
    return tg.gap_blocks(signals(spark, sf).select("drive", "t"), "drive", "t", 86400.0).groupBy("drive", F.col("block").cast("long").alias("block")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS drive, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 100 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY drive ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
g AS (SELECT *, sum(CASE WHEN a - e <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT drive, round(sum(s), 3) AS seconds FROM (SELECT drive, g, max(b) - min(a) AS s FROM g GROUP BY drive, g) GROUP BY drive""")
def union_seconds(spark, sf):
    s = signals(spark, sf).select("drive", F.col("t").alias("a"), (F.col("t") + F.col("v") * 100).alias("b"))
    return islands.union_seconds(s, "drive", "a", "b").withColumn("seconds", F.round("seconds", 3))


@query("""WITH a AS (SELECT event_id, user_id AS drive, epoch_us(ts) / 1e6 AS a0, epoch_us(ts) / 1e6 + 20000 AS a1 FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS b_id, user_id AS drive, epoch_us(ts) / 1e6 AS b0, epoch_us(ts) / 1e6 + 5000 AS b1 FROM events WHERE event_type = 'error')
SELECT a.event_id, b.b_id FROM a JOIN b ON a.drive = b.drive AND b.b0 <= a.a1 + 3600 AND b.b1 >= a.a0 - 3600""")
def interval_join(spark, sf):
    s = signals(spark, sf)
    a = s.filter("channel = 'click'").select("drive", "event_id", F.col("t").alias("a_start"), (F.col("t") + 20000).alias("a_end"))
    b = s.filter("channel = 'error'").select("drive", F.col("event_id").alias("b_id"), F.col("t").alias("b_start"), (F.col("t") + 5000).alias("b_end"))
    return joins.overlap_join(a, b, "drive", 43200.0, pad=3600.0).select("event_id", "b_id")


_PLACES = "p AS (SELECT vec_id, label, embedding[1] * 1000.0 :: DOUBLE AS x, embedding[2] * 1000.0 :: DOUBLE AS y, degrees(atan2(embedding[4] :: DOUBLE, embedding[3] :: DOUBLE)) AS hdg FROM embeddings)"


def places(spark, sf):
    """Embeddings read as places: two components as metres east and north, two as a heading, the label as drive."""
    e = lambda i: F.get("embedding", i).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", "label", (e(0) * 1000.0).alias("x"), (e(1) * 1000.0).alias("y"), F.degrees(F.atan2(e(3), e(2))).alias("hdg"))


@query(f"""WITH {_PLACES} SELECT a.vec_id, b.vec_id AS b_vec_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) AS dist FROM p a JOIN p b ON a.label <> b.label
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 15 AND least((((a.hdg - b.hdg) % 360 + 360) % 360), 360 - (((a.hdg - b.hdg) % 360 + 360) % 360)) <= 60""")
def spatial_join(spark, sf):
    p = places(spark, sf)
    near = joins.near_pairs(p, p, "x", "y", 15.0).filter("label <> b_label").filter(joins.heading_difference(F.col("hdg"), F.col("b_hdg")) <= 60)
    return near.select("vec_id", "b_vec_id", F.round("dist", 4).alias("dist"))


@query(f"""WITH RECURSIVE {SIG}, o AS (SELECT drive, t, v, row_number() OVER (PARTITION BY drive ORDER BY v DESC, t) AS i FROM sig WHERE v > 100), k AS (SELECT drive, 0 :: BIGINT AS i, [] :: DOUBLE[] AS kept FROM (SELECT DISTINCT drive FROM o)
UNION ALL SELECT o.drive, o.i, CASE WHEN len(list_filter(k.kept, lambda x: abs(x - o.t) <= 172800.0)) > 0 THEN k.kept ELSE list_append(k.kept, o.t) END FROM k JOIN o ON o.drive = k.drive AND o.i = k.i + 1), l AS (SELECT drive, unnest(arg_max(kept, i)) AS t FROM k GROUP BY drive) SELECT o.drive, round(o.t, 4) AS t, o.v FROM l JOIN o ON o.drive = l.drive AND o.t = l.t""")
def spaced_peaks(spark, sf):
    """Strongest events of a drive, none within two days of a stronger one kept. The greedy fold is compared by tests with a loop."""
    s = signals(spark, sf).filter("v > 100")
    return islands.spaced_peaks(s, "drive", "t", "v", 172800.0).select("drive", F.round("t", 4).alias("t"), "v")


@query(f"""WITH {TICKS}, r AS (SELECT drive, tick, t, round(yaw_dps, 4) AS x FROM ticks), c AS (SELECT *, sum(coalesce((x + px) / 2 * (t - pt), 0)) OVER w AS cum FROM (SELECT *, lag(x) OVER w AS px, lag(t) OVER w AS pt FROM r WINDOW w AS (PARTITION BY drive ORDER BY tick)) WINDOW w AS (PARTITION BY drive ORDER BY tick)),
b AS (SELECT *, sign(x) AS s FROM c WHERE abs(x) > 3), n AS (SELECT *, CASE WHEN lag(s) OVER w = s AND CASE WHEN tick - lag(tick) OVER w > 1 THEN pt - lag(t) OVER w ELSE 0 END <= 0.15 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY drive ORDER BY tick)),
l AS (SELECT *, sum(new) OVER (PARTITION BY drive ORDER BY tick) AS lobe FROM n) SELECT drive, CAST(lobe AS BIGINT) AS lobe, any_value(s) :: DOUBLE AS sign, round(min(t), 4) AS t_start, round(max(t), 4) AS t_end, round(arg_max(cum, t) - arg_min(cum, t), 6) AS area FROM l GROUP BY drive, lobe""")
def yaw_lobes(spark, sf):
    """Lobes of the yaw rate, compared by tests with a loop over the samples."""
    t = ticks(spark, sf).select("drive", "t", F.round("yaw_dps", 4).alias("yaw_dps"))  # limits are then met alike in both engines
    out = islands.lobes(t, "yaw_dps", "drive", "t", 3.0, 0.15)
    return out.select("drive", F.col("lobe").cast("long").alias("lobe"), "sign", F.round("t_start", 4).alias("t_start"), F.round("t_end", 4).alias("t_end"), F.round("area", 6).alias("area"))


@query(f"""WITH {TICKS}, h AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY tick) AS r FROM ticks WHERE ax_mps2 < -3), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive ORDER BY tick) > 0.3 THEN 1 ELSE 0 END AS n FROM h), i AS (SELECT *, sum(n) OVER (PARTITION BY drive ORDER BY tick) AS run FROM g)
SELECT drive, CAST(run AS BIGINT) AS run, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM i GROUP BY drive, run HAVING max(t) - min(t) >= 0.1""")
def merged_runs(spark, sf):
    return islands.intervals(ticks(spark, sf), F.col("ax_mps2") < -3, "drive", "t", DT, merge_gap=0.3, min_duration=0.1).withColumn("run", F.col("run").cast("long"))


@query("""WITH e AS (SELECT user_id AS drive, ts, value, event_id FROM events), s AS (SELECT drive, event_id, row_number() OVER (PARTITION BY drive ORDER BY value DESC, event_id) AS rank FROM e) SELECT drive, event_id, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 3""")
def top_per_drive(spark, sf):
    w = Window.partitionBy("drive").orderBy(F.desc("v"), "event_id")
    return signals(spark, sf).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("drive", "event_id", "rank")
