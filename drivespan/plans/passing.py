"""Queries of passages, null samples, same-place baselines, spans and lateral windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivespan.operators import candidates as cd, passages as ps
from drivespan.plans.align import _PLACES
from drivespan.plans.base import DRAW, DT, TICKS, query, rounded, ticks
from drivespan.plans.chains import _EVENTS, _brakes
from drivespan.plans.places import _points

_NEAR = "lead_m < 20"
_PASS = f"""nh AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive ORDER BY tick) > 0.075 THEN 1 ELSE 0 END AS nw FROM ticks WHERE {_NEAR}), ni AS (SELECT *, sum(nw) OVER (PARTITION BY drive ORDER BY tick) AS run FROM nh),
pa AS (SELECT drive, 'feature' AS kind, min(t) AS a, max(t) AS b FROM ni GROUP BY drive, run HAVING max(t) - min(t) >= 0.2 UNION ALL SELECT drive, 'null', min(t), max(t) FROM ticks GROUP BY drive, floor(round(t / 0.25, 9)) HAVING count(*) >= 5 AND bool_and(coalesce(lead_m > 26, false))),
pm AS (SELECT p.drive, p.kind, p.a, p.b, avg(abs(yaw_dps)) FILTER (WHERE t < a) AS before, avg(abs(yaw_dps)) FILTER (WHERE t BETWEEN a AND b) AS on_, avg(abs(yaw_dps)) FILTER (WHERE t > b) AS after, max(abs(yaw_dps)) FILTER (WHERE t BETWEEN a AND b) AS most, avg(abs(yaw_dps)) FILTER (WHERE t BETWEEN a AND b) - avg(abs(yaw_dps)) FILTER (WHERE NOT t BETWEEN a AND b) AS rise
FROM pa p JOIN ticks k ON k.drive = p.drive AND k.t BETWEEN p.a - 0.5 AND p.b + 0.5 GROUP BY ALL)"""


def _metrics(spark, sf):
    t = ticks(spark, sf)
    spans = ps.passages(t, F.expr(_NEAR), F.col("lead_m") > 26, "drive", "t", DT, 0.2, 0.25)
    return ps.passage_metrics(spans, t, "drive", "t", "yaw_dps", 0.5, 5.0)


@query(f"WITH {TICKS}, {_PASS} SELECT drive, kind, round(a, 6) AS t_start, round(b, 6) AS t_end, round(before, 6) AS before, round(on_, 6) AS \"on\", round(after, 6) AS after, round(most, 6) AS most, round(rise, 6) AS rise FROM pm")
def feature_passages(spark, sf):
    """Passages near a feature and far from all, with what lies before, on and after them."""
    return _metrics(spark, sf).select("drive", "kind", *(F.round(c, 6).alias(c) for c in ("t_start", "t_end", "before", "on", "after", "most", "rise")))


@query(f"""WITH {TICKS}, {_PASS}, r AS (SELECT drive, kind, a, round(most, 9) AS most, round(rise, 9) AS rise FROM pm), n AS (SELECT * FROM r WHERE kind = 'null'), f AS (SELECT * FROM r WHERE kind = 'feature'),
p AS (SELECT f.drive, f.a, CASE WHEN f.most IS NOT NULL THEN 100.0 * (SELECT count(*) FROM n WHERE n.most < f.most) / (SELECT count(most) FROM n) END AS p_most, CASE WHEN f.rise IS NOT NULL THEN 100.0 * (SELECT count(*) FROM n WHERE n.rise < f.rise) / (SELECT count(rise) FROM n) END AS p_rise FROM f)
SELECT drive, round(a, 6) AS t_start, round(p_most, 6) AS p_most, round(p_rise, 6) AS p_rise, round((p_most + p_rise) / 2, 6) AS score FROM p""")
def ranked_passages(spark, sf):
    """A passage's metrics as percentiles among the null passages, and their mean."""
    m = _metrics(spark, sf).withColumns({"most": F.round("most", 9), "rise": F.round("rise", 9)})
    out, null = m.filter("kind = 'feature'").select("drive", "t_start", "most", "rise"), m.filter("kind = 'null'")
    for c in ("most", "rise"):
        out = ps.percentile_in_null(out, null, c, f"p_{c}")
    return out.select("drive", F.round("t_start", 6).alias("t_start"), F.round("p_most", 6).alias("p_most"), F.round("p_rise", 6).alias("p_rise"), F.round((F.col("p_most") + F.col("p_rise")) / 2, 6).alias("score"))


@query(f"""WITH {TICKS}, {_EVENTS}, w AS (SELECT drive, tick // 10 AS win, min(t) AS a, max(t) AS b, max(abs(yaw_dps)) AS m, avg(v_mps) AS v FROM ticks GROUP BY 1, 2), q AS (SELECT * FROM w WHERE m < 18 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.drive = w.drive AND ev.t_start <= w.b + 0.3 AND ev.t_end >= w.a - 0.3)),
r AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY {DRAW.format("'5:' || drive || ':' || win")}, win) AS k FROM q) SELECT drive, win, round(v, 6) AS v FROM r WHERE k <= 3""")
def quiet_windows(spark, sf):
    """Quiet windows away from events, drawn as a null distribution."""
    w = ticks(spark, sf).groupBy("drive", F.floor(F.col("tick") / 10).alias("win")).agg(F.min("t").alias("a_start"), F.max("t").alias("a_end"), F.max(F.abs("yaw_dps")).alias("m"), F.avg("v_mps").alias("v"))
    e = _brakes(spark, sf).select("drive", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    return ps.quiet_sample(w, e, "drive", F.col("m") < 18, 0.3, 3, 5, 2.0).select("drive", "win", F.round("v", 6).alias("v"))


@query(f"""WITH {_PLACES}, q AS (SELECT vec_id AS id, label AS drive, x, y, hdg, (vec_id * 7919 % 1000) :: DOUBLE AS s FROM p), d AS (SELECT a.id, b.drive, median(b.s) AS m FROM q a JOIN q b ON a.drive <> b.drive AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 60 AND least((((a.hdg - b.hdg) % 360 + 360) % 360), 360 - (((a.hdg - b.hdg) % 360 + 360) % 360)) <= 50 GROUP BY 1, 2)
SELECT id, count(*) AS drives, median(m) AS baseline FROM d GROUP BY id HAVING count(*) >= 3""")
def place_baseline(spark, sf):
    """What other drives show at the same place and heading: the median of their medians."""
    return ps.same_place_baseline(_points(spark, sf), "x", "y", "hdg", "drive", "strength", 60.0, 50.0)


@query(f"""WITH {TICKS}, {_EVENTS}, k AS (SELECT unnest(range(0, 4)) AS k), s AS (SELECT id, drive, k, t_start + k / 3.0 * (t_end - t_start) AS t_at FROM ev, k) SELECT s.id, CAST(s.k AS INTEGER) AS k, round(s.t_at, 6) AS t_at, round(t.yaw_dps, 6) AS value FROM s ASOF LEFT JOIN ticks t ON t.drive = s.drive AND round(s.t_at, 9) >= round(t.t, 9)""")
def event_spans(spark, sf):
    """An event's span in four rows, each with the latest value."""
    e = _brakes(spark, sf)
    t = ticks(spark, sf).withColumn("t", F.round("t", 9))
    at = ps.span_table(e.withColumns({"t_start": F.round("t_start", 12), "t_end": F.round("t_end", 12)}), t, "drive", "t", "yaw_dps", 4)
    return at.select("id", "k", F.round("t_at", 6).alias("t_at"), F.round("value", 6).alias("value"))


_W, _H = 12, 4
_U = f"((tick - win * {_H} - {(_W - 1) / 2}) * 0.05)"
_M2 = sum((i - (_W - 1) / 2) ** 2 for i in range(_W)) * DT**2 / _W
_M4 = sum((i - (_W - 1) / 2) ** 4 for i in range(_W)) * DT**4 / _W


@query(f"""WITH {TICKS}, o AS (SELECT unnest(range(0, {_W // _H})) AS o), r AS (SELECT drive, tick // {_H} - o AS win, tick, yaw_dps AS x, lag(yaw_dps) OVER (PARTITION BY drive, o ORDER BY tick) AS p FROM ticks, o), w AS (SELECT * FROM r WHERE win >= 0 AND tick BETWEEN win * {_H} AND win * {_H} + {_W - 1}),
f AS (SELECT drive, win, count(*) FILTER (WHERE tick > win * {_H} AND sign(x) * sign(p) < 0) AS flips, count(x) AS n, avg(x) AS a, avg(x * {_U}) AS b, avg(x * {_U} * {_U}) - {_M2!r} * avg(x) AS c, avg(x * x) AS q FROM w GROUP BY drive, win HAVING count(x) = {_W}),
e AS (SELECT drive, win, flips, sqrt(greatest(q - a * a - b * b / {_M2!r} - c * c / {_M4 - _M2 * _M2!r}, 0)) AS residual FROM f) SELECT drive, win, flips, round(residual, 5) AS residual, CASE WHEN residual < 3 THEN 'flat' WHEN residual >= 8 THEN 'wild' ELSE 'curved' END AS kind FROM e""")
def lateral_windows(spark, sf):
    """Short windows of lateral motion by their swings about a parabola."""
    return ps.lateral_windows(ticks(spark, sf), "drive", "tick", "yaw_dps", _W, _H, DT, 3.0, 8.0).withColumn("residual", F.round("residual", 5))


@query(f"""WITH {TICKS}, l AS (SELECT drive, tick // 25 AS "group", min(t) AS a, max(t) AS b FROM ticks WHERE drive % 2 = 0 GROUP BY 1, 2) SELECT l.drive, l."group", round(avg(v_mps), 6) AS v_mps_mean, min(ax_mps2) AS ax_mps2_min, round(arg_max(yaw_dps, (abs(yaw_dps), -t)), 6) AS yaw_dps_absmax FROM l JOIN ticks k ON k.drive = l.drive AND k.t BETWEEN l.a AND l.b GROUP BY 1, 2""")
def label_features(spark, sf):
    """The features of candidates, over the intervals of labels."""
    t = ticks(spark, sf)
    labels = t.filter("drive % 2 = 0").groupBy("drive", F.floor(F.col("tick") / 25).alias("group")).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    out = cd.context(labels, t, "drive", "t", [("v_mps", "mean"), ("ax_mps2", "min"), ("yaw_dps", "absmax")], 5.0)
    return out.select("drive", "group", rounded("v_mps_mean", 6).alias("v_mps_mean"), "ax_mps2_min", rounded("yaw_dps_absmax", 6).alias("yaw_dps_absmax"))
