"""Queries of fits with effects, recursive filters and spectra."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from drivespan.operators import drive_checks as ck, panels as pn, recursive as rc, stats as ss, timegrid as tg
from drivespan.plans.base import DT, RATE, SIG, TICKS, fir_sql, query, signals, table, ticks


def _two_way_sql(keys: str) -> str:
    """Slope of y on x with effects of a and of b (three levels), from table r(a, b, x, y): b as two dummies, a's means taken off."""
    names = {"x": "x", "d1": "(b = 'A')::INT", "d2": "(b = 'N')::INT", "y": "y"}
    off = ", ".join(f"{e} - avg({e}) OVER (PARTITION BY a) AS {n}" for n, e in names.items())
    s = lambda u, v: f"sum({u} * {v})"
    return f"""w AS (SELECT {off} FROM r), m AS (SELECT count(*) AS n, {s('x', 'x')} AS xx, {s('x', 'd1')} AS x1, {s('x', 'd2')} AS x2, {s('d1', 'd1')} AS d11, {s('d1', 'd2')} AS d12, {s('d2', 'd2')} AS d22, {s('x', 'y')} AS xy, {s('d1', 'y')} AS y1, {s('d2', 'y')} AS y2 FROM w)
SELECT {keys} round((xy * (d11 * d22 - d12 * d12) - x1 * (y1 * d22 - y2 * d12) + x2 * (y1 * d12 - y2 * d11)) / (xx * (d11 * d22 - d12 * d12) - x1 * (x1 * d22 - x2 * d12) + x2 * (x1 * d12 - x2 * d11)), 4) AS slope, n FROM m"""


@query(f"WITH r AS (SELECT l_suppkey AS a, l_returnflag AS b, l_quantity AS x, l_extendedprice AS y FROM lineitem), {_two_way_sql('')}")
def two_way_effects(spark, sf):
    """Price on quantity with supplier and return flag effects."""
    return pn.two_way_slope(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), "n")


@query()
def two_way_interval(spark, sf):
    """Price on quantity with supplier and part group effects, and an interval over suppliers; tests compare with dummy-variable least squares of every replicate."""
    rows = table(spark, sf, "lineitem").withColumn("place", F.col("l_partkey") % 40)
    return pn.two_way_bootstrap(rows, "l_suppkey", "place", "l_quantity", "l_extendedprice", 12, 7)


def _motion(spark, sf):
    """Ticks with yaw in rad/s, speed, steer by delays of 0, 1 and 2 ticks, and a fold of drives."""
    w = Window.partitionBy("drive").orderBy("tick")
    r, v = F.radians("yaw_dps"), F.col("v_mps")
    t = ticks(spark, sf).select("drive", "tick", r.alias("r"), v.alias("v"), *(F.lag("steer_deg", k).over(w).alias(f"s{k}") for k in range(3)))
    return t.filter("v > 2 and s2 is not null").select("*", (F.col("r") / F.col("v")).alias("x1"), (F.col("r") * F.col("v")).alias("x2"), (F.col("drive") % 4).alias("fold"))


_MOTION = f"""{TICKS}, lagged AS (SELECT drive, tick, radians(yaw_dps) AS r, v_mps AS v, steer_deg AS s0, lag(steer_deg, 1) OVER w AS s1, lag(steer_deg, 2) OVER w AS s2 FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)),
mo AS (SELECT drive, tick, r, v, r / v AS x1, r * v AS x2, drive % 4 AS fold, s0, s1, s2 FROM lagged WHERE v > 2 AND s2 IS NOT NULL),
dl AS (SELECT *, 0.0 :: DOUBLE AS delay, s0 AS y FROM mo UNION ALL SELECT *, 0.05, s1 FROM mo UNION ALL SELECT *, 0.1, s2 FROM mo)"""


@query(f"""WITH {_MOTION}, fo AS (SELECT DISTINCT fold AS test FROM mo), tr AS (SELECT test, d.* FROM dl d JOIN fo ON d.fold <> test),
c AS (SELECT *, x1 - avg(x1) OVER g AS c1, x2 - avg(x2) OVER g AS c2, y - avg(y) OVER g AS cy, avg(x1) OVER g AS m1, avg(x2) OVER g AS m2, avg(y) OVER g AS my FROM tr WINDOW g AS (PARTITION BY test, delay, drive)),
f AS (SELECT test, delay, (sum(c1 * cy) * sum(c2 * c2) - sum(c2 * cy) * sum(c1 * c2)) / (sum(c1 * c1) * sum(c2 * c2) - sum(c1 * c2) ** 2) AS a, (sum(c2 * cy) * sum(c1 * c1) - sum(c1 * cy) * sum(c1 * c2)) / (sum(c1 * c1) * sum(c2 * c2) - sum(c1 * c2) ** 2) AS b FROM c GROUP BY test, delay),
s AS (SELECT c.test AS fold, c.delay, f.a, f.b, stddev_pop(degrees(r - v * (y - (my - f.a * m1 - f.b * m2)) / (f.a + f.b * v * v))) AS sigma, count(*) AS n FROM c JOIN f ON f.test = c.test AND f.delay = c.delay GROUP BY ALL)
SELECT fold, round(arg_min(delay, (sigma, delay)), 6) AS delay, round(arg_min(a, (sigma, delay)), 4) AS a, round(arg_min(b, (sigma, delay)), 4) AS b, round(min(sigma), 4) AS sigma, arg_min(n, (sigma, delay)) AS n FROM s GROUP BY fold""")
def delay_fits(spark, sf):
    """For each fold of drives the steer delay and coefficients that leave the least yaw residual in all other folds."""
    yaw = lambda y, a, b: F.degrees(F.col("r") - F.col("v") * y / (a + b * F.col("v") ** 2))
    out = pn.fold_fits(_motion(spark, sf), "drive", "fold", "x1", "x2", {0.0: "s0", 0.05: "s1", 0.1: "s2"}, yaw)
    return out.select("fold", F.round("delay", 6).alias("delay"), *(F.round(c, 4).alias(c) for c in ("a", "b", "sigma")), "n")


_SHARE = 0.05 / (0.3 + 0.05)


@query(f"""WITH RECURSIVE {TICKS}, y AS (SELECT drive, tick, steer_deg AS y FROM ticks WHERE tick = 0 UNION ALL SELECT t.drive, t.tick, y.y + (t.steer_deg - y.y) * {_SHARE!r} FROM y JOIN ticks t ON t.drive = y.drive AND t.tick = y.tick + 1) SELECT drive, tick, round(y, 6) AS lagged FROM y""")
def recursive_lag(spark, sf):
    """A first-order lag of 0.3 s over whole drives, begun at the first value."""
    return rc.filtered(ticks(spark, sf), rc.first_order(0.3, RATE), "drive", "tick", "steer_deg", "lagged", settled=True).withColumn("lagged", F.round("lagged", 6))


@query(f"""WITH RECURSIVE {TICKS}, tau AS (SELECT unnest([0.0 :: DOUBLE, 0.1, 0.3]) AS tau), y AS (SELECT tau, drive, tick, steer_deg AS y FROM ticks, tau WHERE tick = 0 UNION ALL SELECT tau, t.drive, t.tick, y.y + (t.steer_deg - y.y) * 0.05 / (tau + 0.05) FROM y JOIN ticks t ON t.drive = y.drive AND t.tick = y.tick + 1),
s AS (SELECT y.drive, tau, stddev_pop(t.yaw_dps - y.y / 5) AS sigma FROM y JOIN ticks t ON t.drive = y.drive AND t.tick = y.tick GROUP BY 1, 2) SELECT drive, round(arg_min(tau, (sigma, tau)), 6) AS tau, round(min(sigma), 5) AS sigma FROM s GROUP BY drive""")
def lag_constants(spark, sf):
    """For each drive the time constant, of a grid, at which the lagged steering leaves the least deviation of yaw."""
    taus = {"lag0": 0.0, "lag1": 0.1, "lag2": 0.3}
    rows = rc.filtered_by(ticks(spark, sf), {c: rc.first_order(tau, RATE) for c, tau in taus.items()}, "drive", "tick", "steer_deg", settled=True, keep=("yaw_dps",))
    s = rows.groupBy("drive").agg(*(F.stddev_pop(F.col("yaw_dps") - F.col(c) / 5).alias(c) for c in taus))
    best = F.array_min(F.array(*(F.struct(F.col(c).alias("sigma"), F.lit(tau).alias("tau")) for c, tau in taus.items())))
    return s.select("drive", F.round(best["tau"], 6).alias("tau"), F.round(best["sigma"], 5).alias("sigma"))


@query()
def whole_body_weighting(spark, sf):
    """The vertical whole-body weighting as a recursive filter over whole drives; tests compare with a sequential one and with the standard's gains."""
    return rc.filtered(ticks(spark, sf), rc.weighting("Wk", RATE), "drive", "tick", "ax_mps2", "weighted")


_N = 16
_HANN = f"(0.5 - 0.5 * cos(2 * pi() * i / {_N}))"
_POWER = 1 / (RATE * sum((0.5 - 0.5 * math.cos(2 * math.pi * k / _N)) ** 2 for k in range(_N)))


@query(f"""WITH {TICKS}, o AS (SELECT unnest([0, 1]) AS o), i AS (SELECT drive, tick // {_N // 2} - o AS win, tick - (tick // {_N // 2} - o) * {_N // 2} AS i, yaw_dps AS x, steer_deg AS y FROM ticks, o),
f AS (SELECT *, x - avg(x) OVER g AS xm, y - avg(y) OVER g AS ym, count(*) OVER g AS k FROM i WINDOW g AS (PARTITION BY drive, win)), b AS (SELECT unnest(range(0, {_N // 2 + 1})) AS bin),
d AS (SELECT drive, win, bin, sum({_HANN} * xm * cos(2 * pi() * bin * i / {_N})) AS xr, -sum({_HANN} * xm * sin(2 * pi() * bin * i / {_N})) AS xi, sum({_HANN} * ym * cos(2 * pi() * bin * i / {_N})) AS yr, -sum({_HANN} * ym * sin(2 * pi() * bin * i / {_N})) AS yi FROM f, b WHERE k = {_N} GROUP BY drive, win, bin),
p AS (SELECT drive, bin, count(*) AS n, {_POWER!r} * CASE WHEN bin IN (0, {_N // 2}) THEN 1 ELSE 2 END AS c, sum(xr * xr + xi * xi) AS pxx, sum(yr * yr + yi * yi) AS pyy, sum(xr * yr + xi * yi) AS re, sum(xr * yi - xi * yr) AS im FROM d GROUP BY drive, bin),
h AS (SELECT *, bin * {RATE / _N} AS hz, (re * re + im * im) / nullif(pxx * pyy, 0) AS coh, CASE WHEN bin * {RATE / _N} < 3 THEN 'slow' ELSE 'fast' END AS band FROM p WHERE bin * {RATE / _N} >= 1 AND bin * {RATE / _N} < 9)
SELECT drive, band, round(sum(c * pxx / n) * {RATE / _N}, 3) AS power_x, round(sum(c * pyy / n) * {RATE / _N}, 2) AS power_y, round(sqrt(sum(c * pyy) / sum(c * pxx)), 4) AS ratio, round(avg(coh), 5) AS coherence, max(n) AS windows FROM h GROUP BY drive, band""")
def welch_bands(spark, sf):
    """Band powers, their ratio and the coherence of yaw and steering, from tapered half-overlapping windows."""
    s = rc.spectra(ticks(spark, sf), "drive", "tick", "yaw_dps", "steer_deg", _N, RATE)
    out = rc.band_summaries(s, ["drive"], {"slow": (1.0, 3.0), "fast": (3.0, 9.0)}, RATE, _N)
    return out.select("drive", "band", F.round("power_x", 3).alias("power_x"), F.round("power_y", 2).alias("power_y"), F.round("ratio", 4).alias("ratio"), F.round("coherence", 5).alias("coherence"), "windows")


@query()
def direction_offsets(spark, sf):
    """Offsets of windows of ten ticks, their interval, and the harmonic in a heading with its permutation p; tests compare with a loop that draws the same."""
    w = ticks(spark, sf).groupBy("drive", F.floor(F.col("tick") / 10).alias("win")).agg(F.avg("yaw_dps").alias("off"), (F.sum("yaw_dps") * 3.0).alias("heading"))
    return pn.direction_offsets(w, "drive", ["win"], "off", "heading", 40, 11)


_TAPS = [0.25, 0.5, 0.25]


@query(f"""WITH {TICKS}, f AS (SELECT drive, regr_slope(ay_mps2, v_mps * radians(yaw_dps)) AS b, regr_intercept(ay_mps2, v_mps * radians(yaw_dps)) AS a FROM ticks GROUP BY drive), e AS (SELECT t.drive, tick, ay_mps2 IS NULL AS gap, a + b * v_mps * radians(yaw_dps) AS pred, ay_mps2 - (a + b * v_mps * radians(yaw_dps)) AS r FROM ticks t JOIN f ON f.drive = t.drive)
SELECT drive, tick, round(pred, 6) AS predicted, round(CASE WHEN NOT bool_or(gap) OVER (PARTITION BY drive ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) THEN {fir_sql('r', _TAPS)} END, 6) AS residual FROM e WINDOW w AS (PARTITION BY drive ORDER BY tick)""")
def lateral_residuals(spark, sf):
    """Lateral acceleration by a model fitted to each drive, and the band of what is left, null near gaps."""
    t = ticks(spark, sf).withColumns({"x": F.col("v_mps") * F.radians("yaw_dps"), "one": F.lit(1.0)})
    fit = ss.fit_with_r2(t, ["drive"], ["one", "x"], "ay_mps2").select("drive", "b_0", "b_1")
    d = t.join(fit, "drive").withColumn("predicted", F.col("b_0") + F.col("b_1") * F.col("x"))
    near = tg.dilate(F.col("ay_mps2").isNull(), "drive", "tick", 3)
    band = tg.fir(F.col("ay_mps2") - F.col("predicted"), "drive", "tick", _TAPS)
    return d.select("drive", "tick", F.round("predicted", 6).alias("predicted"), F.round(F.when(~near, band), 6).alias("residual"))


@query(f"""WITH {TICKS}, d AS (SELECT drive, (lead(v_mps) OVER w - lag(v_mps) OVER w) / 0.1 AS dv, ax_mps2 AS ax FROM ticks WINDOW w AS (PARTITION BY drive ORDER BY tick)), k AS (SELECT * FROM d WHERE dv IS NOT NULL AND ax IS NOT NULL)
SELECT drive, count(*) AS n, round(sqrt(avg((dv - ax) ** 2)) / nullif(sqrt(avg(ax ** 2)), 0), 6) AS norm, round(regr_r2(dv, ax), 6) AS r2 FROM k GROUP BY drive""")
def signal_relations(spark, sf):
    """How far a signal's derivative is from the signal that should be it: the residual's norm over the signal's, and R^2, by drive."""
    t = ticks(spark, sf).select("drive", tg.derivative(F.col("v_mps"), "drive", "tick", DT).alias("dv"), F.col("ax_mps2").alias("ax")).filter("dv is not null and ax is not null")
    rms = lambda c: F.sqrt(F.avg(c**2))
    return t.groupBy("drive").agg(F.count("*").alias("n"), F.round(rms(F.col("dv") - F.col("ax")) / F.nullif(rms(F.col("ax")), F.lit(0.0)), 6).alias("norm"), F.round(F.corr("dv", "ax") ** 2, 6).alias("r2"))


@query(f"""WITH {TICKS}, l AS (SELECT unnest(range(-3, 4)) AS lag), m AS (SELECT a.drive, l.lag, corr(a.yaw_dps, b.steer_deg) AS r FROM ticks a CROSS JOIN l JOIN ticks b ON b.drive = a.drive AND b.tick = a.tick + l.lag GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY r DESC, abs(lag), lag DESC) AS n FROM m)
SELECT a.drive, a.tick, a.yaw_dps, b.steer_deg FROM ticks a JOIN k ON k.drive = a.drive AND k.n = 1 JOIN ticks b ON b.drive = a.drive AND b.tick = a.tick + k.lag""")
def clocks_by_correlation(spark, sf):
    """One signal moved by the lag at which it agrees best with another in its drive."""
    t = ticks(spark, sf)
    lags = ck.drive_lags(t, "yaw_dps", "steer_deg", "drive", "tick", list(range(-3, 4))).select("drive", "lag")
    return ck.synchronised(t.select("drive", "tick", "yaw_dps"), t.select("drive", "tick", "steer_deg"), lags, "drive", "tick")


@query(f"""WITH {SIG}, c AS (SELECT drive % 3 AS platform, channel AS grade, CASE WHEN drive % 3 = 0 THEN v > 60 WHEN drive % 3 = 1 THEN v > 90 OR channel = 'error' END AS kept FROM sig)
SELECT platform, grade, count(*) AS n, count(*) FILTER (WHERE kept) AS n_kept, round(count(*) FILTER (WHERE kept) / count(*), 6) AS share FROM c WHERE kept IS NOT NULL GROUP BY ROLLUP (platform, grade)""")
def retention_by_platform(spark, sf):
    """What fixed conditions of each platform keep, by platform and grade with totals; platforms without conditions are left out."""
    sets = {0: F.col("v") > 60, 1: (F.col("v") > 90) | (F.col("channel") == "error")}
    out = ck.retention(signals(spark, sf).withColumn("platform", F.col("drive") % 3), sets, "platform", "channel")
    return out.select("platform", F.col("channel").alias("grade"), "n", "n_kept", F.round("share", 6).alias("share"))
