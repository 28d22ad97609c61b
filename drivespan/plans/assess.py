"""Queries of decoding, evaluation, quality and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.functions import vehicle as vf
from drivespan.operators import decode as dc, evaluation as ev, export as ex, quality as ql
from drivespan.plans.base import DRAW, SIG, TICKS, query, signals, table, ticks
from drivespan.plans.detect import RULES

_FRAMES = "fr AS (SELECT doc_id AS drive, len(text) * 0.01 AS t, doc_id % 3 + 100 AS address, CASE WHEN doc_id % 10 = 0 THEN 129 ELSE 1 END AS src, substr(sha256(CAST(doc_id AS VARCHAR)), 1, CASE WHEN doc_id % 17 = 0 THEN 10 ELSE 16 END) AS h FROM documents)"
_PAD = "rpad(h, 16, '0')"


def frames(spark, sf):
    """Documents read as frames: an address and a payload of 5 or 8 bytes from the id's digest."""
    d = table(spark, sf, "documents")
    n = F.when(F.col("doc_id") % 17 == 0, 10).otherwise(16)
    return d.select(F.col("doc_id").alias("drive"), (F.length("text") * F.lit(0.01)).alias("t"), (F.col("doc_id") % 3 + 100).alias("address"), F.when(F.col("doc_id") % 10 == 0, 129).otherwise(1).alias("src"), F.unhex(F.sha2(F.col("doc_id").cast("string"), 256).substr(F.lit(1), n)).alias("payload"))


@query(f"WITH {_FRAMES} SELECT drive, ('0x' || substr({_PAD}, 1, 8))::BIGINT AS high, ('0x' || substr({_PAD}, 9, 8))::BIGINT AS low FROM fr")
def payload_words(spark, sf):
    h, l = dc.payload_halves(F.col("payload"))
    return frames(spark, sf).select("drive", h.alias("high"), l.alias("low"))


_FIELD = lambda a, n: f"(('0x' || substr({_PAD}, {a // 4 + 1}, {n // 4}))::BIGINT)"


@query(f"""WITH {_FRAMES}, ok AS (SELECT * FROM fr WHERE src < 128) SELECT drive, 'speed' AS channel, {_FIELD(8, 16)} * 0.01 :: DOUBLE AS v FROM ok WHERE address = 100 UNION ALL
SELECT drive, 'accel_x', (CASE WHEN {_FIELD(28, 12)} >= 2048 THEN {_FIELD(28, 12)} - 4096 ELSE {_FIELD(28, 12)} END * 0.005 :: DOUBLE + 1.0) * 9.80665 FROM ok WHERE address = 101 UNION ALL SELECT drive, 'steer', CASE WHEN {_FIELD(40, 16)} >= 32768 THEN {_FIELD(40, 16)} - 65536 ELSE {_FIELD(40, 16)} END * 0.1 :: DOUBLE FROM ok WHERE address = 100""")
def decoded_signals(spark, sf):
    specs = [
        {"channel": "speed", "address": 100, "bus": 1, "start": 8, "length": 16, "factor": 0.01}, {"channel": "accel_x", "address": 101, "bus": 1, "start": 28, "length": 12, "signed": True, "factor": 0.005, "offset": 1.0, "scale": vf.G},
        {"channel": "steer", "address": 100, "bus": 1, "start": 40, "length": 16, "signed": True, "factor": 0.1},
    ]
    return dc.decode(frames(spark, sf), specs, keys=("drive",))


@query(f"WITH {_FRAMES}, s(channel, address) AS (VALUES ('speed', 100), ('ghost', 107)) SELECT channel FROM s WHERE address NOT IN (SELECT address FROM fr)")
def absent_signals(spark, sf):
    return dc.absent(frames(spark, sf), [{"channel": "speed", "address": 100, "bus": 1}, {"channel": "ghost", "address": 107, "bus": 1}])


@query(f"WITH {_FRAMES} SELECT drive, address FROM fr WHERE address = 101 AND src < 128")
def own_frames(spark, sf):
    return dc.frames_of(frames(spark, sf), 101, 1).select("drive", "address")


@query()
def byte_orders(spark, sf):
    """The likelier byte order of each address, compared by tests with a direct count."""
    return dc.byte_order(frames(spark, sf), "address", 8, 16, 0.01, 0.0, 200.0)


@query("""WITH d AS (SELECT o_custkey AS drive, date_diff('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS idx FROM orders), u AS (SELECT DISTINCT drive, idx FROM d), g AS (SELECT *, idx - row_number() OVER (PARTITION BY drive ORDER BY idx) AS g FROM u), r AS (SELECT drive, g, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY drive, g),
b AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY n DESC, first) AS k FROM r), p AS (SELECT * FROM b WHERE k = 1 ORDER BY drive LIMIT 50) SELECT u.drive, u.idx FROM u JOIN p ON u.drive = p.drive WHERE u.idx BETWEEN p.first AND least(p.last, p.first + 2)""")
def work_list(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("drive"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1992 * 12 - 1).cast("long").alias("idx"))
    return dc.work_list(o, "drive", "idx", 50, 3)


@query("""WITH p(nation, prof) AS (VALUES (2, 'n2'), (5, 'n5')), q(seg, prof) AS (VALUES ('BUILDING', 'sb')) SELECT c_custkey AS id, coalesce(p.prof, q.prof) AS profile, CASE WHEN coalesce(p.prof, q.prof) IS NULL THEN 'skipped:unknown_vehicle' ELSE 'ok' END AS status FROM customer LEFT JOIN p ON p.nation = c_nationkey LEFT JOIN q ON q.seg = c_mktsegment""")
def vehicle_profiles(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("dongle"), F.col("c_mktsegment").alias("platform"))
    p = spark.createDataFrame([("2", None, "n2"), ("5", None, "n5"), (None, "BUILDING", "sb")], "dongle string, platform string, profile string")
    return dc.match_profiles(d, p).select("id", "profile", "status")


@query("""SELECT user_id AS drive, ts_day AS t, avg(m) AS v FROM (SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 / 86400.0) AS BIGINT) AS ts_day, event_type, max(value) AS m FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) GROUP BY 1, 2 HAVING count(*) = 2""")
def derived_channel(spark, sf):
    s = signals(spark, sf).withColumn("t", F.floor(F.col("t") / 86400.0))
    return dc.combined(s, ["drive", "t"], ["click", "view"], "both").select("drive", "t", "v")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def remaining_work(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return dc.remaining(d, d.filter("doc_id % 4 = 0"), ["doc_id"])


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DRAW.format("'7:' || doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE r <= greatest(1, ceil(n * 0.1))""")
def stratified_sample(spark, sf):
    """A tenth of each language's documents by hash."""
    return dc.stratified(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.1, 7)


_LAB = "e AS (SELECT event_id AS id, user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 7200 AS e FROM events WHERE event_type = 'click'), l AS (SELECT user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 7200 AS e, value > 250 AS risky FROM events WHERE event_type = 'error')"


def _labelled(spark, sf):
    s = signals(spark, sf)
    a = s.filter("channel = 'click'").select(F.col("event_id").alias("id"), "drive", F.col("t").alias("a_start"), (F.col("t") + 7200).alias("a_end"))
    b = s.filter("channel = 'error'").select("drive", F.col("t").alias("b_start"), (F.col("t") + 7200).alias("b_end"), (F.col("v") > 250).alias("risky"))
    return a, b


@query(f"WITH {_LAB} SELECT e.id, bool_or(l.risky) AS risky FROM e LEFT JOIN l ON l.drive = e.drive AND l.s <= e.e AND l.e >= e.s GROUP BY e.id")
def interval_labels(spark, sf):
    return ev.label_intervals(*_labelled(spark, sf), "drive", 20000.0).select("id", "risky")


@query("""WITH w AS (SELECT user_id AS drive, CAST(floor(epoch_us(ts) / 1e6 / 86400.0) AS BIGINT) AS win, max(value) > 200 AS keep FROM events GROUP BY 1, 2), e AS (SELECT event_id AS id, user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 100000 AS e FROM events WHERE event_type = 'view'),
x AS (SELECT id, drive, unnest(generate_series(CAST(floor(s / 86400.0) AS BIGINT), CAST(floor(e / 86400.0) AS BIGINT))) AS win FROM e) SELECT id, bool_or(keep) AS any_kept, bool_and(coalesce(keep, false)) AS all_kept FROM x LEFT JOIN w ON w.drive = x.drive AND w.win = x.win GROUP BY id""")
def event_retention(spark, sf):
    s = signals(spark, sf)
    w = s.withColumn("win", F.floor(F.col("t") / 86400.0)).groupBy("drive", "win").agg((F.max("v") > 200).alias("keep"))
    e = s.filter("channel = 'view'").select(F.col("event_id").alias("id"), "drive", F.col("t").alias("a_start"), (F.col("t") + 100000).alias("a_end"))
    return ev.retention(e, w, ["drive"], 86400.0)


@query("SELECT event_id, (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a, true) AND coalesce(b, true) AS rejected FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value < 100 END AS a, CASE WHEN event_id % 3 <> 0 THEN user_id % 2 = 0 END AS b FROM events)")
def unknown_aware_reject(spark, sf):
    s = signals(spark, sf)
    a, b = F.when(F.col("event_id") % 5 != 0, F.col("v") < 100), F.when(F.col("event_id") % 3 != 0, F.col("drive") % 2 == 0)
    return s.select("event_id", ev.quiet_rejects([a, b]).alias("rejected"))


@query("""WITH r AS (SELECT value > 400 AS a, event_type = 'error' AS b, event_id % 10 = 0 AS c FROM events) SELECT 'big' AS branch, round(avg(a::INT), 6) AS single, round(avg((a AND NOT b AND NOT c)::INT), 6) AS marginal, round(avg((b OR c)::INT), 6) AS leave_one_out FROM r UNION ALL
SELECT 'error', round(avg(b::INT), 6), round(avg((b AND NOT a AND NOT c)::INT), 6), round(avg((a OR c)::INT), 6) FROM r UNION ALL SELECT 'tenth', round(avg(c::INT), 6), round(avg((c AND NOT a AND NOT b)::INT), 6), round(avg((a OR b)::INT), 6) FROM r""")
def branch_contributions(spark, sf):
    out = ev.branch_contributions(signals(spark, sf), {"big": F.col("v") > 400, "error": F.col("channel") == "error", "tenth": F.col("event_id") % 10 == 0})
    return out.select("branch", *(F.round(c, 6).alias(c) for c in ("single", "marginal", "leave_one_out")))


@query("SELECT unnest([0.05 :: DOUBLE, 0.2 :: DOUBLE]) AS rate, round(unnest([quantile_cont(value, 0.95), quantile_cont(value, 0.8)]), 6) AS threshold FROM events")
def rate_thresholds(spark, sf):
    return ev.thresholds_at(signals(spark, sf), "v", [0.05, 0.2]).withColumn("threshold", F.round("threshold", 6))


@query("""SELECT a AS th_l_quantity, b AS th_l_extendedprice, count(*) AS n, CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS hits FROM lineitem, (SELECT unnest([10.0 :: DOUBLE, 30.0 :: DOUBLE]) AS a), (SELECT unnest([1000.0 :: DOUBLE, 40000.0 :: DOUBLE]) AS b) WHERE l_quantity >= a AND l_extendedprice >= b GROUP BY 1, 2""")
def condition_grid(spark, sf):
    return ev.condition_grid(table(spark, sf, "lineitem"), {"l_quantity": [10.0, 30.0], "l_extendedprice": [1000.0, 40000.0]}, F.col("l_returnflag") == "R")


@query("""WITH r AS (SELECT value AS s, value < 300 AS a, event_type <> 'error' AS b FROM events) SELECT 'small' AS condition, round(sum(CASE WHEN a THEN s ELSE 0 END), 4) AS alone_s, round(sum(CASE WHEN b AND NOT a THEN s ELSE 0 END), 4) AS sole_s FROM r UNION ALL SELECT 'fine', round(sum(CASE WHEN b THEN s ELSE 0 END), 4), round(sum(CASE WHEN a AND NOT b THEN s ELSE 0 END), 4) FROM r""")
def rejection_breakdown(spark, sf):
    out = ev.rejection_breakdown(signals(spark, sf), {"small": F.col("v") < 300, "fine": F.col("channel") != "error"}, "v")
    return out.select("condition", F.round("alone_s", 4).alias("alone_s"), F.round("sole_s", 4).alias("sole_s"))


@query(f"""WITH p AS (SELECT user_id AS drive, sum(value) AS s, count(value) AS n FROM events GROUP BY 1), u AS (SELECT p.*, r, {DRAW.format("'1:' || r || ':' || drive")} AS u FROM p, range(200) x(r)),
m AS (SELECT r, sum(w * s) / sum(w * n) AS mean FROM (SELECT *, {" + ".join(f"(u >= {p!r})::INT" for p in ev._POISSON)} AS w FROM u) GROUP BY r) SELECT (SELECT round(sum(s) / sum(n), 6) FROM p) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def cluster_bootstrap(spark, sf):
    """Mean value with an interval from resampled drives; tests check coverage and that equal seeds agree."""
    out = ev.bootstrap(signals(spark, sf), "drive", "v", 200, 1)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""WITH t AS (SELECT user_id, count(*) AS n, sum((value > 250)::INT) AS k, sum((event_type = 'error')::INT) AS e, sum((value > 250 AND event_type = 'error')::INT) AS b FROM events GROUP BY 1)
SELECT user_id AS drive, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high,
round(((b + (n - k - e + b)) / n - (k * e + (n - k) * (n - e)) / (n * n)) / (1 - (k * e + (n - k) * (n - e)) / (n * n)), 6) AS kappa FROM t""")
def binomial_helpers(spark, sf):
    big, err = F.col("v") > 250, F.col("channel") == "error"
    t = signals(spark, sf).groupBy("drive").agg(F.count("*").alias("n"), F.sum((big & err).cast("int")).alias("a"), F.sum((big & ~err).cast("int")).alias("b"), F.sum((~big & err).cast("int")).alias("c"), F.sum((~big & ~err).cast("int")).alias("d"))
    low, high = vf.wilson(F.col("a") + F.col("b"), F.col("n"))
    return t.select("drive", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(vf.cohen_kappa(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("kappa"))


_LOG_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(f"""WITH t AS (SELECT sum((value > 250 AND event_type = 'error')::INT) :: BIGINT AS a, sum((value > 250 AND event_type <> 'error')::INT) :: BIGINT AS b, sum((NOT value > 250 AND event_type = 'error')::INT) :: BIGINT AS c, sum((NOT value > 250 AND event_type <> 'error')::INT) :: BIGINT AS d FROM events),
x AS (SELECT t.*, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM t), p AS (SELECT *, {_LOG_CHOOSE.format("(a + b)", "x")} + {_LOG_CHOOSE.format("(c + d)", "(a + c - x)")} - {_LOG_CHOOSE.format("(a + b + c + d)", "(a + c)")} AS lp FROM x)
SELECT a, b, c, d, round(any_value(a / (a + b)), 8) AS rate_with, round(any_value(c / (c + d)), 8) AS rate_without, round(least(sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END), 1), 5) AS p FROM p, (SELECT lp AS own FROM p WHERE x = a) GROUP BY a, b, c, d""")
def presence_comparison(spark, sf):
    """Outcome rates with Fisher's p; tests sum the hypergeometric terms."""
    out = ev.compare_presence(signals(spark, sf), F.col("v") > 250, F.col("channel") == "error")
    return out.select("a", "b", "c", "d", F.round("rate_with", 8).alias("rate_with"), F.round("rate_without", 8).alias("rate_without"), F.round("p", 5).alias("p"))


@query(f"""WITH {TICKS}, u AS (SELECT drive, tick, 'ax_mps2' AS name, ax_mps2 AS x FROM ticks UNION ALL SELECT drive, tick, 'abs_flag', abs_flag FROM ticks), g AS (SELECT *, CASE WHEN x > 0.5 AND NOT coalesce(lag(x) OVER (PARTITION BY drive, name ORDER BY tick) > 0.5, true) THEN 1 ELSE 0 END AS edge FROM u)
SELECT name, round(count(x) / count(*), 6) AS valid, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.95), 6) AS q95, round(avg((x > 0.5)::INT), 6) AS on_ratio, CAST(sum(edge) AS BIGINT) AS edges FROM g GROUP BY name""")
def column_profile(spark, sf):
    out = ql.column_profile(ticks(spark, sf), "drive", "tick", ["ax_mps2", "abs_flag"])
    return out.select("name", *(F.round(c, 6).alias(c) for c in ("valid", "q05", "q50", "q95", "on_ratio")), "edges")


@query(f"WITH {TICKS} SELECT count(ax_mps2) AS n, round(quantile_cont(ax_mps2, 0.1), 6) AS q10, round(quantile_cont(ax_mps2, 0.9), 6) AS q90 FROM ticks WHERE tick % 5 = 0")
def strided_quantiles(spark, sf):
    return ql.strided_quantiles(ticks(spark, sf), "ax_mps2", "tick", 5, (0.1, 0.9)).select("n", F.round("q10", 6).alias("q10"), F.round("q90", 6).alias("q90"))


@query(f"WITH {TICKS} SELECT drive, max((lead_m IS NOT NULL)::INT) AS lead_m_has, max(lead_m) AS lead_m_max, max((abs_flag IS NOT NULL)::INT) AS abs_flag_has, max(abs_flag) AS abs_flag_max FROM ticks GROUP BY drive")
def flag_availability(spark, sf):
    return ql.availability(ticks(spark, sf), ["drive"], ["lead_m", "abs_flag"])


@query(f"WITH {SIG}, p AS (SELECT drive, channel, (count(*) - 1) / nullif(max(t) - min(t), 0) AS r, min(v) AS lo, max(v) AS hi FROM sig GROUP BY ALL) SELECT channel, round(median(r) * 86400, 6) AS per_day, min(lo) AS low, max(hi) AS high FROM p GROUP BY channel")
def channel_rates(spark, sf):
    return ql.channel_rates(signals(spark, sf), "drive", "channel", "t", "v").select("channel", F.round(F.col("rate") * 86400, 6).alias("per_day"), "low", "high")


@query(f"WITH {TICKS} SELECT drive, count(*) AS n, round(corr(yaw_dps, steer_deg), 5) AS r, round(regr_slope(steer_deg, yaw_dps), 5) AS slope, round(sqrt(avg((steer_deg - yaw_dps) ** 2)), 5) AS rmse, round(max(abs(steer_deg - yaw_dps)), 5) AS max_abs, CASE WHEN count(*) < 30 THEN 'unknown' WHEN corr(yaw_dps, steer_deg) >= 0.3 THEN 'same' WHEN corr(yaw_dps, steer_deg) <= -0.3 THEN 'opposite' ELSE 'unclear' END AS verdict FROM ticks GROUP BY drive")
def pair_agreement(spark, sf):
    out = ql.agreement(ticks(spark, sf), ["drive"], "yaw_dps", "steer_deg")
    return out.select("drive", "n", *(F.round(c, 5).alias(c) for c in ("r", "slope", "rmse", "max_abs")), ql.sign_verdict(F.col("r"), F.col("n")).alias("verdict"))


@query(f"""WITH {TICKS}, e AS (SELECT *, sum((lead_id IS DISTINCT FROM lag_id)::INT) OVER (PARTITION BY drive ORDER BY tick) AS episode FROM (SELECT *, lag(lead_id) OVER (PARTITION BY drive ORDER BY tick) AS lag_id FROM ticks))
SELECT drive, CAST(episode AS BIGINT) AS episode, count(*) AS n, round(regr_slope(lead_m, t), 4) AS slope, round(avg(v_mps), 5) AS vrel FROM e GROUP BY drive, episode""")
def range_rate_check(spark, sf):
    from pyspark.sql import Window

    t = ticks(spark, sf)
    new = ~F.col("lead_id").eqNullSafe(F.lag("lead_id").over(Window.partitionBy("drive").orderBy("tick")))
    k = t.select("drive", "t", F.col("lead_m").alias("distance"), F.col("v_mps").alias("rel_speed"), new.alias("new_track"))
    return ql.range_rate_check(k, "drive", "t").select("drive", "episode", "n", F.round("slope", 4).alias("slope"), F.round("vrel", 5).alias("vrel"))


@query(f"WITH {SIG} SELECT drive, round(min(d), 4) AS least, round(median(d), 4) AS median, round(max(d), 4) AS most FROM (SELECT drive, t - lag(t) OVER (PARTITION BY drive ORDER BY t) AS d FROM sig) GROUP BY drive")
def timestamp_jitter(spark, sf):
    return ql.jitter(signals(spark, sf), "drive", "t").select("drive", *(F.round(c, 4).alias(c) for c in ("least", "median", "most")))


@query(f"WITH {TICKS}, o AS (SELECT drive % 20 AS vehicle, corr(yaw_dps, steer_deg) AS r, count(*) AS n FROM ticks GROUP BY 1), p AS (SELECT corr(yaw_dps, steer_deg) AS a FROM ticks) SELECT vehicle, round(r, 5) AS r, n, CAST(coalesce(CASE WHEN n >= 20 AND abs(r) >= 0.5 THEN sign(r) WHEN abs(a) >= 0.5 THEN sign(a) ELSE 0 END, 0) AS INTEGER) AS sign FROM o, p")
def sign_calibration(spark, sf):
    t = ticks(spark, sf).select((F.col("drive") % 20).alias("vehicle"), F.col("yaw_dps").alias("reference"), F.col("steer_deg").alias("sensor"))
    return ql.sign_decision(t, "vehicle").select("vehicle", F.round("r", 5).alias("r"), "n", "sign")


_SIGMA = "b AS (SELECT drive % 8 + 5 AS v, yaw_dps AS x FROM ticks), m AS (SELECT v, median(x) AS med FROM b GROUP BY v), s AS (SELECT b.v, m.med, count(x) AS n, 1.4826 * median(abs(x - med)) AS sigma FROM b JOIN m ON b.v = m.v GROUP BY b.v, m.med)"


def _sigma(spark, sf):
    return ql.robust_sigma(ticks(spark, sf).select((F.col("drive") % 8 + 5).alias("v"), F.col("yaw_dps").alias("x")), ["v"], "x")


@query(f"WITH {TICKS}, {_SIGMA} SELECT v, round(med, 5) AS median, n, round(sigma, 5) AS sigma FROM s")
def robust_sigma(spark, sf):
    return _sigma(spark, sf).select("v", F.round("median", 5).alias("median"), "n", F.round("sigma", 5).alias("sigma"))


@query(f"""WITH {TICKS}, {_SIGMA}, q AS (SELECT sum(n) AS w, sum(n / (v * v)) AS x, sum(n * sigma * sigma) AS y, sum(n / (v * v) / (v * v)) AS xx, sum(n / (v * v) * sigma * sigma) AS xy FROM s), f AS (SELECT *, greatest((w * xy - x * y) / (w * xx - x * x), 0) AS b2 FROM q) SELECT round(sqrt(greatest((y - b2 * x) / w, 0)), 4) AS a, round(sqrt(b2), 4) AS b FROM f""")
def noise_fit(spark, sf):
    return ql.noise_fit(_sigma(spark, sf), "v", "sigma", "n").select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"""WITH {TICKS}, q AS (SELECT drive, quantile_cont(steer_deg, 0.05) AS lo, quantile_cont(steer_deg, 0.95) AS hi FROM ticks GROUP BY drive) SELECT t.drive, round(sum(yaw_dps * steer_deg) / nullif(sum(yaw_dps * yaw_dps), 0), 5) AS slope, count(*) AS n FROM ticks t JOIN q ON q.drive = t.drive WHERE steer_deg BETWEEN lo AND hi GROUP BY t.drive""")
def trimmed_fit(spark, sf):
    return ql.trimmed_fit(ticks(spark, sf), "drive", "yaw_dps", "steer_deg").withColumn("slope", F.round("slope", 5))


@query(f"WITH {TICKS} SELECT 'hard_brake' AS rule, min(ax_mps2) AS reached, -3.0 :: DOUBLE AS threshold, -3 - min(ax_mps2) AS margin FROM ticks UNION ALL SELECT 'side_pull', max(abs(ay_mps2)), 4.0, max(abs(ay_mps2)) - 4 FROM ticks UNION ALL SELECT 'hard_accel', max(ax_mps2), 5.0, max(ax_mps2) - 5 FROM ticks")
def threshold_margins(spark, sf):
    return ql.threshold_margins(ticks(spark, sf), RULES)


@query("""WITH h AS (SELECT CAST('0x' || substr(md5(event_type || '|' || user_id || '|' || event_id), 1, 13) AS BIGINT) AS h FROM events) SELECT count(*) AS n, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS total, bit_xor(h) AS mixed FROM h""")
def table_fingerprint(spark, sf):
    """A digest of a table that doesn't depend on row order; tests shuffle the rows."""
    return ql.fingerprint(signals(spark, sf).select(F.col("channel").alias("a"), F.col("drive").alias("b"), F.col("event_id").alias("c"))).withColumn("total", F.col("total").cast("string"))


@query("SELECT CASE WHEN u IS NULL THEN 'none' WHEN u % 2 = 0 THEN 'found' ELSE 'missing' END AS state, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 <> 0 THEN event_id END AS u FROM events) GROUP BY 1")
def reference_check(spark, sf):
    s = signals(spark, sf).select(F.when(F.col("event_id") % 9 != 0, F.col("event_id")).alias("u"))
    return ql.references(s, s.filter("u % 2 = 0"), "u")


@query("""WITH k AS (SELECT event_id, concat_ws(chr(10), 'driver', CAST(user_id AS VARCHAR), CAST(event_id % 4 AS VARCHAR), CAST(round(CAST(value AS DECIMAL(20, 6)) - 3, 2) AS DECIMAL(20, 2))::VARCHAR, event_type, 'rules') AS k FROM events) SELECT event_id, 'nm_' || substr(sha256(k), 1, 16) AS stable_id FROM k""")
def stable_ids(spark, sf):
    s = signals(spark, sf)
    start = F.col("v").cast("decimal(20,6)") - 3
    return s.select("event_id", ex.stable_id(F.lit("driver"), F.col("drive").cast("string"), F.col("event_id") % 4, start, F.col("channel"), F.lit("rules")).alias("stable_id"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS text, list_filter(string_split(CASE WHEN event_id % 2 = 0 THEN event_type || '|' || 'x' ELSE '|' END, '|'), lambda x: x <> '') AS parts, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS flag, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S') AS iso FROM events""")
def cleaned_values(spark, sf):
    s = signals(spark, sf)
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(" NaN ")).otherwise(F.concat(F.lit(" "), "channel"))
    parts = ex.split_pipe(F.when(F.col("event_id") % 2 == 0, F.concat("channel", F.lit("|x"))).otherwise(F.lit("|")))
    flag = ex.to_bool(F.element_at(F.array(F.lit("True"), F.lit("0"), F.lit("?")), (F.col("event_id") % 3 + 1).cast("int")))
    return s.select("event_id", ex.clean_text(raw).alias("text"), parts.alias("parts"), flag.alias("flag"), F.substring(ex.utc_iso(F.floor("t").cast("double")), 1, 19).alias("iso"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS known, CASE WHEN event_id % 3 = 0 THEN '{"source":{"dataset":"driver"},"score":{"value":' || event_id || '}}' ELSE '{"source":{"dataset":"driver"}}' END AS json FROM events""")
def provenance_and_json(spark, sf):
    s = signals(spark, sf)
    record = {"a": (F.when(F.col("event_id") % 2 == 0, F.col("v")), "copied"), "b": (F.lit("x"), "constant"), "c": (F.when(F.col("event_id") % 3 == 0, F.col("v")), "derived")}
    values, sources, missing = ex.provenance(record)
    json = ex.pruned_json({"source": {"dataset": F.lit("driver"), "extra": F.lit(None).cast("string")}, "score": {"value": F.when(F.col("event_id") % 3 == 0, F.col("event_id"))}})
    return s.select("event_id", (F.cardinality(values) + 0 * F.cardinality(sources) + 0 * F.size(missing)).alias("known"), json.alias("json"))


@query("""WITH c AS (SELECT event_id AS cand, user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 40000 AS e FROM events WHERE event_type = 'signup'), e AS (SELECT event_id AS id, user_id AS drive, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 1000 AS e FROM events WHERE event_type = 'click')
SELECT e.id, min(c.cand) AS cand FROM e JOIN c ON c.drive = e.drive AND e.s >= c.s AND e.e <= c.e AND e.s <= c.e GROUP BY e.id HAVING count(*) = 1""")
def containing_candidate(spark, sf):
    s = signals(spark, sf)
    e = s.filter("channel = 'click'").select(F.col("event_id").alias("id"), "drive", F.col("t").alias("t_start"), (F.col("t") + 1000).alias("t_end"))
    c = s.filter("channel = 'signup'").select(F.col("event_id").alias("cand"), "drive", F.col("t").alias("b_start"), (F.col("t") + 40000).alias("b_end"))
    return ex.containing_candidate(e, c, "drive", 43200.0)


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE round(c_acctbal, 0) END AS x, c_custkey % 2 = 0 AND c_acctbal <> round(c_acctbal, 0) AS conflict FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def merged_by_priority(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    rounded = c.filter("k % 2 = 0 or k % 3 = 0").withColumn("x", F.round("x", 0))
    return ex.merge_by_priority([c.filter("k % 2 = 0"), rounded], "k", "x")


@query("SELECT event_id, (value > 450)::INT + (user_id % 7 = 0)::INT AS n FROM events WHERE value > 450 OR user_id % 7 = 0")
def validation_errors(spark, sf):
    s = signals(spark, sf)
    errors = ex.validation_errors([("score.value", F.col("v") <= 450, "too large"), ("source.drive", F.col("drive") % 7 != 0, "not allowed")])
    return s.select("event_id", F.size(errors).alias("n")).filter("n > 0")


@query("SELECT event_type AS channel, count(*) AS n, count(DISTINCT event_id) AS n_ids, round(avg((event_id % 4 = 0)::INT), 6) AS missing_v FROM events GROUP BY 1")
def export_report(spark, sf):
    s = signals(spark, sf).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("v")))
    return ex.missing_report(s, ["channel"], ["v"]).withColumn("missing_v", F.round("missing_v", 6))


@query("SELECT event_id, CASE WHEN CAST(floor(value * 20 + 1e-9) AS BIGINT) < 6000 THEN CAST(floor(value * 20 + 1e-9) AS BIGINT) END AS frame FROM events")
def video_frames(spark, sf):
    return signals(spark, sf).select("event_id", ex.video_frame(F.col("v"), 20.0, 6000).alias("frame"))
