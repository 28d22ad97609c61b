"""Queries of the report chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import reports as rp
from drivespan.plans.align import _PLACES, places
from drivespan.plans.base import DRAW, DT, SIG, TICKS, query, signals, table, ticks
from drivespan.plans.detect import _BRAKE, _events


def _brakes(spark, sf):
    e = _events(spark, sf, "hard_brake")
    return e.select("drive", F.concat_ws(":", "drive", F.round(F.col("t_start") * 20).cast("long")).alias("id"), "t_start", "t_end")


_EVENTS = f"{_BRAKE}, ev AS (SELECT drive, drive || ':' || CAST(round(t_start * 20) AS BIGINT) AS id, t_start, t_end FROM hard_brake)"


@query(f"""WITH {TICKS}, {_EVENTS}, m AS (SELECT e.id, max(k.v_mps) AS v_max, min(k.ax_mps2) AS ax_min FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start - 0.2 AND e.t_end + 0.2 GROUP BY e.id), c AS (SELECT *, NOT coalesce(v_max > 20, false) AS f1, NOT coalesce(ax_min < -5.5, false) AS f2 FROM m)
SELECT id, round(v_max, 5) AS v_max, concat_ws('|', CASE WHEN f1 THEN 'fast' END, CASE WHEN f2 THEN 'hard' END) AS failed, CASE WHEN NOT f1 AND NOT f2 THEN 'plausible' WHEN f1 AND f2 THEN 'implausible' ELSE 'doubtful' END AS verdict FROM c""")
def remeasured_events(spark, sf):
    m = rp.remeasure(_brakes(spark, sf), ticks(spark, sf), "drive", "t", 0.2, {"v_max": F.max("v_mps"), "ax_min": F.min("ax_mps2")}, 1.0)
    return rp.judged(m, {"fast": F.col("v_max") > 20, "hard": F.col("ax_min") < -5.5}, 1).select("id", F.round("v_max", 5).alias("v_max"), "failed", "verdict")


@query(f"WITH {TICKS}, g AS (SELECT *, sum(CASE WHEN lead_id IS NOT DISTINCT FROM p AND tick > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY tick) AS run FROM (SELECT *, lag(lead_id) OVER (PARTITION BY drive ORDER BY tick) AS p FROM ticks)) SELECT drive, lead_id AS value, CAST(run AS BIGINT) AS run, round(min(t), 5) AS t_start, round(max(t), 5) AS t_end, count(*) AS n FROM g GROUP BY drive, lead_id, run")
def value_runs(spark, sf):
    return rp.value_runs(ticks(spark, sf), "drive", "t", "lead_id").select("drive", "value", "run", F.round("t_start", 5).alias("t_start"), F.round("t_end", 5).alias("t_end"), "n")


@query("""WITH l AS (SELECT quantile_cont(value, 0.95) AS q FROM events WHERE event_id % 3 = 0) SELECT event_type AS channel, round(q, 5) AS "limit", round(avg((value > q)::INT), 6) AS rate, count(*) AS n FROM events, l WHERE event_id % 3 <> 0 GROUP BY event_type, q""")
def control_rates(spark, sf):
    return rp.control_rates(signals(spark, sf), "channel", F.col("event_id") % 3 == 0, "v").select("channel", F.round("limit", 5).alias("limit"), F.round("rate", 6).alias("rate"), "n")


@query(f"WITH {TICKS} SELECT drive, round(sum((abs(ay_mps2) > 3)::INT) * 0.05, 4) AS truth_s, round(sum((abs(ay_mps2) > 3 AND v_mps > 5)::INT) * 0.05, 4) AS scope_s, round(sum((abs(ay_mps2) > 3 AND v_mps > 5 AND abs(yaw_dps) > 4)::INT) / nullif(sum((abs(ay_mps2) > 3 AND v_mps > 5)::INT), 0), 5) AS recall FROM ticks GROUP BY drive")
def truth_recall(spark, sf):
    out = rp.truth_recall(ticks(spark, sf), "drive", F.abs("ay_mps2") > 3, F.col("v_mps") > 5, F.abs("yaw_dps") > 4, DT)
    return out.select("drive", F.round("truth_s", 4).alias("truth_s"), F.round("scope_s", 4).alias("scope_s"), F.round("recall", 5).alias("recall"))


@query(f"WITH {TICKS} SELECT (abs(ay_mps2) >= 1)::INT + (abs(ay_mps2) >= 3)::INT AS bin, count(*) AS n, round(avg(ax_mps2 - ay_mps2), 5) AS bias, round(stddev_samp(ax_mps2 - ay_mps2), 5) AS sd, round(corr(ax_mps2, ay_mps2), 5) AS r FROM ticks WHERE ax_mps2 IS NOT NULL AND ay_mps2 IS NOT NULL GROUP BY 1")
def error_by_bin(spark, sf):
    return rp.error_by_bin(ticks(spark, sf), "ax_mps2", "ay_mps2", [1.0, 3.0]).select("bin", "n", *(F.round(c, 5).alias(c) for c in ("bias", "sd", "r")))


@query(f"WITH {TICKS} SELECT CASE WHEN abs(yaw_dps) < 5 THEN 'straight' ELSE 'turn' END AS class, CAST(floor(v_mps / 10) AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(ay_mps2, 0.05), 5) AS p05, round(quantile_cont(ay_mps2, 0.5), 5) AS p50, round(quantile_cont(ay_mps2, 0.95), 5) AS p95 FROM ticks WHERE ay_mps2 IS NOT NULL GROUP BY 1, 2")
def residual_table(spark, sf):
    k = F.when(F.abs("yaw_dps") < 5, "straight").otherwise("turn")
    return rp.residual_table(ticks(spark, sf), k, "v_mps", 10.0, "ay_mps2").select("class", "bin", "n", *(F.round(c, 5).alias(c) for c in ("p05", "p50", "p95")))


@query("""WITH r AS (SELECT l_orderkey % 6 AS fold, CASE WHEN l_linenumber = 1 THEN (l_orderkey + 1) % 6 END AS b, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT a.fold, regr_slope(r.y, r.x) AS s, regr_intercept(r.y, r.x) AS c FROM (SELECT DISTINCT fold FROM r) a JOIN r ON r.fold <> a.fold AND r.b IS DISTINCT FROM a.fold GROUP BY a.fold) SELECT r.fold, round(s, 3) AS slope, count(*) AS n, round(sqrt(avg(pow(y - c - s * x, 2))), 2) AS rmse FROM r JOIN f ON f.fold = r.fold GROUP BY r.fold, s""")
def blocked_cv(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 6).alias("fold"), F.col("l_orderkey").alias("o"), "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = rp.blocked_cv(df, "fold", F.when(F.col("l_linenumber") == 1, (F.col("o") + 1) % 6), "x", "y")
    return out.select("fold", F.round("slope", 3).alias("slope"), "n", F.round("rmse", 2).alias("rmse"))


@query(f"""WITH {SIG}, d AS (SELECT drive, t, t - lag(t) OVER (PARTITION BY drive ORDER BY t) AS d FROM sig), m AS (SELECT drive, median(d) AS m FROM d GROUP BY drive), g AS (SELECT d.*, coalesce(d > 3 * m, false) AS gap FROM d JOIN m ON m.drive = d.drive), s AS (SELECT *, sum(gap::INT) OVER (PARTITION BY drive ORDER BY t) AS s FROM g), x AS (SELECT drive, s, max(t) - min(t) AS len, sum(CASE WHEN gap THEN d ELSE 0 END) AS lost FROM s GROUP BY drive, s)
SELECT drive, count(*) AS segments, round(max(len), 3) AS longest, round(sum(lost), 3) AS gap_s, round(sum(len) / (sum(len) + sum(lost)), 6) AS covered FROM x GROUP BY drive""")
def coverage_gaps(spark, sf):
    out = rp.coverage_gaps(signals(spark, sf), ["drive"], "t", 3.0)
    return out.select("drive", "segments", F.round("longest", 3).alias("longest"), F.round("gap_s", 3).alias("gap_s"), F.round("covered", 6).alias("covered"))


@query(f"""WITH {TICKS}, u AS (SELECT drive, t, lead_id IS NOT DISTINCT FROM lag(lead_id) OVER w AND brake_level IS NOT DISTINCT FROM lag(brake_level) OVER w AND lag(1) OVER w IS NOT NULL AS same FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)), o AS (SELECT drive, t - lag(t) OVER (PARTITION BY drive ORDER BY t) AS d FROM u WHERE NOT same)
SELECT n.drive, n.n, count(*) AS updates, round(median(d), 5) AS median_s, round(max(d), 5) AS longest_s FROM o JOIN (SELECT drive, count(*) AS n FROM ticks GROUP BY drive) n ON n.drive = o.drive GROUP BY n.drive, n.n""")
def signal_updates(spark, sf):
    return rp.updates(ticks(spark, sf), "drive", "t", ["lead_id", "brake_level"]).select("drive", "n", "updates", F.round("median_s", 5).alias("median_s"), F.round("longest_s", 5).alias("longest_s"))


@query(f"""WITH {SIG}, q AS (SELECT drive, quantile_cont(abs(v), 0.9) AS q FROM sig GROUP BY drive), h AS (SELECT s.* FROM sig s JOIN q ON q.drive = s.drive WHERE abs(v) > q.q), g AS (SELECT *, sum(CASE WHEN t - l <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY drive ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY drive ORDER BY t) AS l FROM h)) SELECT drive, CAST(g AS BIGINT) AS "group", min(t) AS t_start, max(t) AS t_end, max(abs(v)) AS peak, count(*) AS n FROM g GROUP BY drive, g""")
def exceedance_groups(spark, sf):
    return rp.exceedance_groups(signals(spark, sf), "drive", "t", "v", 0.9, 172800.0)


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment AS y FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x, CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END AS y FROM customer WHERE c_custkey % 3 <> 0), m AS (SELECT a.k AS ka, b.k AS kb, a.x IS DISTINCT FROM b.x AS dx, a.y IS DISTINCT FROM b.y AS dy FROM a FULL JOIN b ON a.k = b.k),
s AS (SELECT sum((ka IS NOT NULL AND kb IS NOT NULL)::INT)::BIGINT AS both_, sum((kb IS NULL)::INT)::BIGINT AS oa, sum((ka IS NULL)::INT)::BIGINT AS ob, sum((ka IS NOT NULL AND kb IS NOT NULL AND dx)::INT)::BIGINT AS cx, sum((ka IS NOT NULL AND kb IS NOT NULL AND dy)::INT)::BIGINT AS cy FROM m) SELECT 'x' AS "column", both_ AS "both", cx AS changed, oa AS only_a, ob AS only_b FROM s UNION ALL SELECT 'y', both_, cy, oa, ob FROM s""")
def compared_runs(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("y"))
    b = c.filter("k % 3 <> 0").select("k", F.when(F.col("k") % 7 != 0, F.col("x")).alias("x"), F.when(F.col("k") % 11 == 0, "OTHER").otherwise(F.col("y")).alias("y"))
    return rp.compare_runs(c.filter("k % 5 <> 0"), b, "k", ["x", "y"])


@query("WITH r AS (SELECT event_id, user_id AS drive, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS turn FROM events) SELECT event_id, drive, CAST(turn AS INTEGER) AS turn FROM r WHERE turn <= 3 ORDER BY turn, drive LIMIT 100")
def even_selection(spark, sf):
    return rp.even_selection(signals(spark, sf), "drive", [F.desc("v"), F.col("event_id")], 3, 100).select("event_id", "drive", "turn")


@query(f"""WITH {TICKS}, {_EVENTS} SELECT e.id, round(sqrt(avg(k.yaw_dps ** 2) FILTER (WHERE k.t < e.t_start)), 5) AS rms_before, round(sqrt(avg(k.yaw_dps ** 2) FILTER (WHERE k.t > e.t_end)), 5) AS rms_after FROM ev e JOIN ticks k ON k.drive = e.drive AND k.t BETWEEN e.t_start - 0.5 AND e.t_end + 0.5 GROUP BY e.id""")
def behaviour_after(spark, sf):
    return rp.before_after(_brakes(spark, sf), ticks(spark, sf), "drive", "t", "yaw_dps", 0.5, 0.5, 1.0).select("id", F.round("rms_before", 5).alias("rms_before"), F.round("rms_after", 5).alias("rms_after"))


@query(f"""WITH {TICKS}, r AS (SELECT * FROM ticks WHERE ay_mps2 IS NOT NULL), p AS (SELECT drive, arg_max(t, (abs(ay_mps2), -t)) AS tp, max(abs(ay_mps2)) AS m FROM r GROUP BY drive), o AS (SELECT r.drive, max(t) FILTER (WHERE abs(ay_mps2) < 0.4737 * m) AS t0 FROM r JOIN p ON p.drive = r.drive WHERE t < tp GROUP BY r.drive) SELECT p.drive, round(tp, 5) AS t_peak, round(t0, 5) AS t_onset, t0 IS NULL AS censored FROM p LEFT JOIN o ON o.drive = p.drive""")
def event_onsets(spark, sf):
    return rp.onset(ticks(spark, sf).filter("ay_mps2 is not null"), "drive", "t", "ay_mps2", 0.4737).select("drive", F.round("t_peak", 5).alias("t_peak"), F.round("t_onset", 5).alias("t_onset"), "censored")


@query(f"""WITH {TICKS}, p AS (SELECT drive, arg_max(t, (v_mps, -t)) AS tp, max(v_mps) AS m FROM ticks GROUP BY drive), e AS (SELECT k.drive, max(t) FILTER (WHERE v_mps <= 0.5 * m AND t < tp) AS a, min(t) FILTER (WHERE v_mps <= 0.5 * m AND t > tp) AS b FROM ticks k JOIN p ON p.drive = k.drive GROUP BY k.drive) SELECT k.drive, round(min(t), 5) AS t_start, round(max(t), 5) AS t_end FROM ticks k JOIN e ON e.drive = k.drive WHERE (a IS NULL OR t > a) AND (b IS NULL OR t < b) GROUP BY k.drive""")
def event_extents(spark, sf):
    return rp.span_around(ticks(spark, sf), "drive", "t", "v_mps", 0.5).select("drive", F.round("t_start", 5).alias("t_start"), F.round("t_end", 5).alias("t_end"))


@query("""WITH k AS (SELECT user_id AS drive, epoch_us(ts) / 1e6 AS t, value AS v FROM events), w AS (SELECT drive, v, unnest(generate_series(CAST(floor((t - 345600) / 86400.0) AS BIGINT) + 1, CAST(floor(t / 86400.0) AS BIGINT))) AS w FROM k) SELECT drive, w * 86400.0 :: DOUBLE AS win_start, max(v) AS hi, count(*) AS n FROM w GROUP BY drive, w""")
def hopping_windows(spark, sf):
    return rp.hopping(signals(spark, sf), ["drive"], "t", 345600.0, 86400.0, [F.max("v").alias("hi"), F.count("*").alias("n")])


@query(f"""WITH {TICKS}, m AS (SELECT drive, min(t) FILTER (WHERE abs(steer_deg) >= 100) AS a, min(t) FILTER (WHERE abs(yaw_dps) >= 18.5) AS b FROM ticks GROUP BY drive) SELECT drive, CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL OR a <= b THEN 'steer_deg' ELSE 'yaw_dps' END AS first, round(least(a, b), 5) AS t_first FROM m""")
def first_movers(spark, sf):
    return rp.first_mover(ticks(spark, sf), "drive", "t", {"steer_deg": 100.0, "yaw_dps": 18.5}).withColumn("t_first", F.round("t_first", 5))


@query(f"""WITH {SIG}, a AS (SELECT event_id AS id, drive, floor(v / 100) AS b FROM sig WHERE channel = 'error'), p AS (SELECT event_id AS control, drive, floor(v / 100) AS b, row_number() OVER (PARTITION BY drive, floor(v / 100) ORDER BY {DRAW.format("'5:' || event_id")}, event_id) AS r FROM sig WHERE channel <> 'error'),
m AS (SELECT a.id, p.control, row_number() OVER (PARTITION BY a.id ORDER BY p.r) AS pick FROM a JOIN p ON p.drive = a.drive AND p.b = a.b AND p.r <= 3 AND p.control <> a.id) SELECT * FROM m WHERE pick <= 2""")
def matched_controls(spark, sf):
    """Controls of the same drive and value bin by hash; tests check the matching."""
    s = signals(spark, sf).withColumnRenamed("event_id", "id")
    return rp.matched_controls(s.filter("channel = 'error'"), s.filter("channel <> 'error'"), "drive", "v", 100.0, 2, 5).withColumn("pick", F.col("pick").cast("long"))


@query("WITH c AS (SELECT event_type AS channel, avg(value) AS m, count(*) AS n FROM events GROUP BY 1) SELECT channel, 'mean' AS gate, m > 50 AS passed FROM c UNION ALL SELECT channel, 'size', n > 2000 FROM c")
def acceptance_gates(spark, sf):
    c = signals(spark, sf).groupBy("channel").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return rp.gates(c, {"mean": F.col("m") > 50, "size": F.col("n") > 2000}).select("channel", "gate", "passed")


@query("""SELECT user_id % 4 AS kind, round(avg((value > 60)::INT) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg((value > 60)::INT) FILTER (WHERE event_type = 'error'), 6) AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def condition_rates(spark, sf):
    s = signals(spark, sf).filter("channel in ('click', 'error')").withColumn("kind", F.col("drive") % 4)
    return rp.rate_table(s, ["kind"], "channel", ["click", "error"], F.col("v") > 60).select("kind", F.round("click", 6).alias("click"), F.round("error", 6).alias("error"))


@query("""WITH n AS (SELECT user_id AS drive, event_type AS channel, count(*) AS n, min(event_id) AS id FROM events WHERE value > 100 GROUP BY 1, 2), p AS (SELECT DISTINCT user_id AS drive, event_type AS channel FROM events WHERE event_type = 'click') SELECT p.drive, p.channel, CASE WHEN n = 1 THEN id END AS id, coalesce(n = 1, false) AS ok FROM p LEFT JOIN n ON n.drive = p.drive AND n.channel = p.channel""")
def exact_picks(spark, sf):
    s = signals(spark, sf).withColumnRenamed("event_id", "id")
    return rp.exactly_one(s.filter("channel = 'click'").select("drive", "channel").distinct(), s.filter("v > 100"), ["drive", "channel"])


@query(f"WITH {TICKS}, s AS (SELECT unnest([-1, 0, 2]) AS shift), m AS (SELECT s.shift, abs(a.ax_mps2 - b.ax_mps2) AS d FROM s CROSS JOIN ticks b JOIN ticks a ON a.drive = b.drive AND a.tick = b.tick + s.shift) SELECT shift, count(d) AS n, round(median(d), 5) AS p50, round(quantile_cont(d, 0.95), 5) AS p95 FROM m GROUP BY shift")
def shift_agreement(spark, sf):
    t = ticks(spark, sf)
    return rp.shift_agreement(t, t, "drive", "tick", "ax_mps2", [-1, 0, 2]).select("shift", "n", F.round("p50", 5).alias("p50"), F.round("p95", 5).alias("p95"))


@query(f"""WITH {TICKS}, u AS (SELECT drive, tick, coalesce(ax_mps2, 0) AS x, coalesce(ay_mps2, 0) AS y, 9.8 + v_mps / 100 AS z FROM ticks), m AS (SELECT drive, avg(x) AS a, avg(y) AS b, avg(z) AS c FROM u GROUP BY drive), n AS (SELECT drive, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM m)
SELECT u.drive, tick, round((1 - a * a / (1 + c)) * x - a * b / (1 + c) * y - a * z, 5) AS x_level, round(a * x + b * y + c * z, 5) AS z_level FROM u JOIN n ON n.drive = u.drive""")
def mount_levelling(spark, sf):
    u = ticks(spark, sf).select("drive", "tick", F.coalesce("ax_mps2", F.lit(0.0)).alias("x"), F.coalesce("ay_mps2", F.lit(0.0)).alias("y"), (F.col("v_mps") / 100 + 9.8).alias("z"))
    return rp.levelling(u, "drive", "x", "y", "z").select("drive", "tick", F.round("x_level", 5).alias("x_level"), F.round("z_level", 5).alias("z_level"))


@query(f"""WITH {_PLACES}, s AS (SELECT vec_id % 3 AS kind, x AS x1, y AS y1, x + 12 AS x2, y - 9 AS y2 FROM p), d AS (SELECT a.vec_id AS id, s.kind, a.x - x1 AS px, a.y - y1 AS py, least(greatest(((a.x - x1) * 12.0 - (a.y - y1) * 9.0) / 225.0, 0), 1) AS u FROM p a, s), e AS (SELECT id, kind, sqrt((px - u * 12) ** 2 + (py + u * 9) ** 2) AS dist FROM d) SELECT id, kind, round(min(dist), 4) AS dist FROM e WHERE dist <= 40 GROUP BY id, kind""")
def structure_distance(spark, sf):
    p = places(spark, sf).withColumnRenamed("vec_id", "id")
    s = p.select((F.col("id") % 3).alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 12).alias("x2"), (F.col("y") - 9).alias("y2"))
    return rp.segment_distance(p.select("id", "x", "y"), s, 40.0).withColumn("dist", F.round("dist", 4))
