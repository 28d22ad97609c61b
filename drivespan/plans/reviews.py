"""Queries of review sets and their scoring, and of the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import review as rv
from drivespan.plans.base import DRAW, SIG, TICKS, query, rounded, signals, table, ticks
from drivespan.streaming import jobs

_EP = "ep AS (SELECT *, CASE WHEN risky THEN 'P' ELSE 'N' END || CASE WHEN n < 10 THEN '0' || n ELSE '' || n END AS eid FROM (SELECT *, row_number() OVER (PARTITION BY risky ORDER BY drive, t) AS n FROM (SELECT drive, t, v > 250 AS risky FROM sig WHERE channel = 'error' AND event_id % 3 <> 0)))"


def _episodes(spark, sf):
    s = signals(spark, sf).filter("channel = 'error'")
    risky = F.when(F.col("event_id") % 3 != 0, F.col("v") > 250)
    return rv.episodes(s.select("drive", F.col("t").alias("t_start"), (F.col("t") + 10).alias("t_end"), risky.alias("risky")), "drive", "t_start")


@query(f"WITH {SIG}, {_EP} SELECT drive, t AS t_start, risky, eid AS event_id FROM ep")
def review_episodes(spark, sf):
    return _episodes(spark, sf).select("drive", "t_start", "risky", "event_id")


@query(f"WITH {SIG}, {_EP} SELECT eid AS event_id, CAST(k AS INTEGER) AS k, round(t - 2 + k * 0.5, 4) AS t_eval FROM ep, (SELECT unnest(range(0, 27)) AS k)")
def evaluation_timeline(spark, sf):
    return rv.timeline(_episodes(spark, sf), 2.0, 1.0, 0.5).select("event_id", "k", F.round("t_eval", 4).alias("t_eval"))


@query("SELECT event_id, f // 1200 AS segment, (f % 1200) / 20 AS second, f % 1200 AS frame FROM (SELECT event_id, CAST(round(value * 20) AS BIGINT) AS f FROM events)")
def segment_of_time(spark, sf):
    seg, sec, frame = rv.to_segment(F.col("v"), 60.0, 20.0)
    return signals(spark, sf).select("event_id", seg.alias("segment"), sec.alias("second"), frame.alias("frame"))


@query("SELECT event_id, round(value - 0.2 - (3 - i) * 0.5, 5) AS t FROM events, (SELECT unnest(range(0, 4)) AS i)")
def backward_frames(spark, sf):
    return signals(spark, sf).select("event_id", F.explode(rv.backward_times(F.col("v"), 4, 0.5, 0.2)).alias("t")).withColumn("t", F.round("t", 5))


@query("""WITH e AS (SELECT event_id, user_id, unnest(range(0, 5)) AS i FROM events), w AS (SELECT event_id, user_id, event_id + i AS f FROM e), h AS (SELECT event_id AS f FROM events WHERE event_id % 3 = 0) SELECT event_id, count(*) AS needed, count(h.f) AS available, count(*) - count(h.f) AS missing FROM w LEFT JOIN h ON h.f = w.f GROUP BY 1""")
def frames_available(spark, sf):
    s = signals(spark, sf).select("event_id", F.lit(0).alias("k"), F.lit(1).alias("key"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("event_id") + i).alias("times"))
    have = signals(spark, sf).filter("event_id % 3 = 0").select(F.lit(1).alias("key"), F.col("event_id").alias("frame_t"))
    return rv.available_frames(s, have, "key", "times").drop("k")


@query(f"""WITH {SIG}, e AS (SELECT drive, t AS te, event_id FROM sig WHERE channel = 'signup'), s AS (SELECT drive, t, v FROM sig WHERE channel = 'view'), a AS (SELECT e.*, e.te - 3600 AS q FROM e), b AS (SELECT e.*, e.te - 93600 AS q FROM e),
x AS (SELECT a.drive, a.event_id, s.v, s.t FROM a ASOF LEFT JOIN s ON s.drive = a.drive AND a.q >= s.t), y AS (SELECT b.event_id, s.v, s.t FROM b ASOF LEFT JOIN s ON s.drive = b.drive AND b.q >= s.t)
SELECT x.drive, x.event_id, x.v AS ctx_a, y.v AS ctx_b, greatest(x.t, y.t) AS source_t FROM x JOIN y ON x.event_id = y.event_id""")
def causal_context(spark, sf):
    s = signals(spark, sf)
    rows = s.filter("channel = 'view'").select("drive", "t", F.col("v").alias("a"), F.col("v").alias("b"))
    e = s.filter("channel = 'signup'").select("drive", F.col("t").alias("t_eval"), "event_id")
    return rv.causal_context(e, rows, "drive", "t", {"a": 0.0, "b": 90000.0}, 3600.0).select("drive", "event_id", "ctx_a", "ctx_b", "source_t")


@query(f"WITH {TICKS} SELECT drive, tick, 'v=' || printf('%.2f', v_mps) || ' lead=' || coalesce(printf('%.2f', lead_m), '-') AS text FROM ticks")
def context_text(spark, sf):
    t = ticks(spark, sf).select("drive", "tick", F.col("v_mps").alias("v"), F.col("lead_m").alias("lead"))
    return t.select("drive", "tick", rv.rendered({"v": 2, "lead": 2}).alias("text"))


@query(f"""WITH {TICKS}, r AS (SELECT drive, tick, row_number() OVER (PARTITION BY drive ORDER BY tick) AS i, count(*) OVER (PARTITION BY drive) AS n FROM ticks), s AS (SELECT *, row_number() OVER (PARTITION BY drive, (n - i) * 8 // n ORDER BY tick DESC) AS f FROM r) SELECT drive, tick FROM s WHERE n <= 8 OR f = 1""")
def thinned_frames(spark, sf):
    return rv.thinned(ticks(spark, sf).select("drive", "tick"), ["drive"], "tick", 8)


@query("""SELECT event_id, list_filter([CASE WHEN event_id % 5 = 0 THEN 'not_an_object' END, CASE WHEN event_id % 5 = 1 THEN 'missing:p' END, CASE WHEN event_id % 5 = 2 THEN 'type:p' END, CASE WHEN event_id % 5 = 3 THEN 'unknown:z' END, CASE WHEN event_id % 5 = 4 AND event_type = 'error' THEN 'enum:state' END, CASE WHEN event_id % 5 IN (3, 4) AND value > 400 THEN 'bounds:p' END], lambda x: x IS NOT NULL) AS errors FROM events""")
def answer_errors(spark, sf):
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.lit("no")).when(k == 1, F.lit('{"state":"view"}')).when(k == 2, F.lit('{"state":"view","p":"x"}')).when(k == 3, F.format_string('{"state":"view","p":%s,"z":1}', F.col("v").cast("string"))).otherwise(F.format_string('{"state":"%s","p":%s}', F.col("channel"), F.col("v").cast("string")))
    errors = rv.answer_errors(F.col("body"), {"state": "string", "p": "number"}, {"state": ["view", "click", "signup", "purchase"]}, {"p": (0.0, 400.0)})
    return signals(spark, sf).withColumn("body", body).select("event_id", errors.alias("errors"))


_RUNS = "a AS (SELECT drive, t, event_id, v > 60 AS al FROM sig), n AS (SELECT *, sum((al AND NOT coalesce(p, false))::INT) OVER (PARTITION BY drive ORDER BY t) AS run FROM (SELECT *, lag(al) OVER (PARTITION BY drive ORDER BY t) AS p FROM a)), i AS (SELECT *, row_number() OVER (PARTITION BY drive, run ORDER BY t) AS i FROM n WHERE al)"


@query(f"WITH {SIG}, {_RUNS} SELECT drive, CAST(run AS BIGINT) AS run, min(t) AS first, max(t) FILTER (WHERE i = 3) AS confirmed, max(t) AS last, count(*) AS n FROM i GROUP BY drive, run HAVING count(*) >= 3")
def alarm_runs(spark, sf):
    return rv.alarm_runs(signals(spark, sf), "drive", "t", F.col("v") > 60, 3)


@query("""WITH c AS (SELECT event_type, sum((value > 250 AND event_id % 2 = 0)::INT) AS tp, sum((value <= 250 AND event_id % 2 = 0)::INT) AS fp, sum((value > 250 AND event_id % 2 = 1)::INT) AS fn, sum((value <= 250 AND event_id % 2 = 1)::INT) AS tn FROM events GROUP BY 1), k AS (SELECT *, tp + fp + fn + tn AS n FROM c)
SELECT event_type AS channel, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / n, 6) AS accuracy, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) AS kappa FROM k""")
def clip_scores(spark, sf):
    out = rv.clip_scores(signals(spark, sf), ["channel"], F.col("v") > 250, F.col("event_id") % 2 == 0)
    return out.select("channel", "tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query(f"WITH {SIG}, {_RUNS}, f AS (SELECT drive, min(first) AS first FROM (SELECT drive, run, min(t) AS first FROM i GROUP BY drive, run HAVING count(*) >= 3) GROUP BY drive), o AS (SELECT drive, min(t) AS onset FROM sig WHERE v > 350 GROUP BY drive) SELECT o.drive, onset, first, first - onset AS delay FROM o LEFT JOIN f ON f.drive = o.drive")
def detection_delay(spark, sf):
    s = signals(spark, sf)
    first = rv.alarm_runs(s, "drive", "t", F.col("v") > 60, 3).groupBy("drive").agg(F.min("first").alias("first"))
    return rv.detection_delay(first, s.filter("v > 350").groupBy("drive").agg(F.min("t").alias("onset")), "drive")


@query(f"""WITH {SIG}, e AS (SELECT drive, t AS a, t + 600 AS b FROM sig WHERE channel = 'error'), f AS (SELECT drive, t FROM sig s WHERE channel <> 'error' AND NOT EXISTS (SELECT 1 FROM e WHERE e.drive = s.drive AND e.a <= s.t + 20000 AND e.b >= s.t - 20000)),
r AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY {DRAW.format("'11:' || drive || ':' || CAST(round(t * 1e6) AS BIGINT)")}, t) AS pick FROM f) SELECT drive, round(t, 4) AS t, pick FROM r WHERE pick <= 5""")
def control_times(spark, sf):
    """Control times away from every error, picked by hash; tests check the distances."""
    s = signals(spark, sf)
    ev = s.filter("channel = 'error'").select("drive", F.col("t").alias("b_start"), (F.col("t") + 600).alias("b_end"))
    return rv.controls_away(s.filter("channel <> 'error'").select("drive", "t"), ev, "drive", 20000.0, 40000.0, 5, 11).select("drive", F.round("t", 4).alias("t"), F.col("pick").cast("long").alias("pick"))


_SHEET = "s AS (SELECT event_id AS id, user_id AS drive, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + 5000 AS b, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' ELSE 'what' END AS w FROM events WHERE event_type = 'click'), l AS (SELECT user_id AS drive, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + 5000 AS b FROM events WHERE event_type = 'view')"


@query(f"WITH {_SHEET} SELECT id, w = 'yes' AS risky FROM s WHERE w IN ('yes', 'no') AND NOT EXISTS (SELECT 1 FROM l WHERE l.drive = s.drive AND l.a <= s.b AND l.b >= s.a)")
def imported_sheet(spark, sf):
    s = signals(spark, sf)
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("no"), F.lit("unclear"), F.lit("what")), (F.col("event_id") % 4 + 1).cast("int"))
    sheet = s.filter("channel = 'click'").select(F.col("event_id").alias("id"), "drive", F.col("t").alias("a_start"), (F.col("t") + 5000).alias("a_end"), word.alias("verdict"))
    labels = s.filter("channel = 'view'").select("drive", F.col("t").alias("b_start"), (F.col("t") + 5000).alias("b_end"))
    return rv.import_sheet(sheet, labels, "drive", 20000.0)[0].select("id", "risky")


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.event_stream(spark, sf, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id AS drive, CAST(floor(epoch_us(ts) / 1e6 / 86400.0) AS BIGINT) AS day, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_extremes(spark, sf):
    """The window filter's extremes as a stream over the file source, run over what is there."""
    s = _stream(spark, sf).withColumnRenamed("user_id", "drive")
    out = jobs.run_to_table(jobs.window_extremes(s, ["drive"], "ts", "value", "1 day", "1 hour"), "complete")
    return out.select("drive", F.floor(F.unix_micros("win_start") / 86400e6).alias("day"), "lo", "hi", "n")


@query(f"WITH {SIG}, {_RUNS} SELECT drive, round(min(t), 5) AS first, round(max(t) FILTER (WHERE i = 3), 5) AS confirmed FROM i GROUP BY drive, run HAVING count(*) >= 3")
def stream_alarms(spark, sf):
    """Debounced alarms with state kept between batches."""
    s = _stream(spark, sf).select(F.col("user_id").alias("drive"), (F.unix_micros("ts") / 1e6).alias("t"), (F.col("value") > 60).alias("alarm"))
    return jobs.run_to_table(jobs.debounced(s, "drive", "t", "alarm", 3), "append").select("drive", F.round("first", 5).alias("first"), F.round("confirmed", 5).alias("confirmed"))


@query("""WITH e AS (SELECT user_id AS drive, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, sum(CASE WHEN t - l <= 43200 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY drive ORDER BY t) AS l FROM e)) SELECT drive, round(min(t), 4) AS t_start, round(max(t) + 43200, 4) AS t_end, count(*) AS segments FROM g GROUP BY drive, g""")
def stream_drives(spark, sf):
    """A drive's rows once it has paused for half a day."""
    s = _stream(spark, sf).withColumnRenamed("user_id", "drive")
    out = jobs.run_to_table(jobs.completed_drives(s, "drive", "ts", "12 hours", "1 hour"), "complete")
    return out.select("drive", F.round(F.unix_micros("start") / 1e6, 4).alias("t_start"), F.round(F.unix_micros("end") / 1e6, 4).alias("t_end"), "segments")


@query("SELECT user_id AS device, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS drive, round(min(epoch_us(ts)) / 1e6, 4) AS t_start, round(max(epoch_us(ts)) / 1e6, 4) AS t_end, count(*) AS segments FROM events GROUP BY 1, 2")
def stream_next_drives(spark, sf):
    """A device's drives, each let go when the next one has begun, with a last flush: days stand for drives."""
    s = _stream(spark, sf).withColumn("drive", F.floor(F.unix_micros("ts") / 86400e6))
    out = jobs.run_all_drives(s, "user_id", "drive", "ts", "2 hours")
    return out.select("device", "drive", rounded("t_start", 4).alias("t_start"), rounded("t_end", 4).alias("t_end"), "segments")
