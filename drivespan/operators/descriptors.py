"""What happened around an event: descriptors of its shape, which sensor moved first, and a ladder of explanations.

Rows meet events in one bucketed range join, and everything about an event is a conditional aggregate or an ordered window over its rows, whose number its window bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators.joins import points_in
from drivespan.operators.rules import condition
from drivespan.sources.scratch import checkpointed


def around(events: DataFrame, rows: DataFrame, key: str, t: str, peak: str, before: float, after: float, bucket: float) -> DataFrame:
    """rows within [peak - before, peak + after] of an event (key, id, peak), with id and dt, the seconds since the peak."""
    # dt is rounded, so that rows at the ends count whatever their times' last digits
    spans = events.select(key, "id", F.col(peak).alias("__peak"), (F.col(peak) - before - 1e-6).alias("b_start"), (F.col(peak) + after + 1e-6).alias("b_end"))
    near = points_in(rows, spans, key, t, bucket).withColumn("dt", F.round(F.col(t) - F.col("__peak"), 9)).drop("b_start", "b_end", "__peak")
    return near.filter(F.col("dt").between(-before, after))


def swings(near: DataFrame, x: str, frac: float) -> DataFrame:
    """(id, swings, decay, decrement): local extremes of x of at least frac of the largest, neighbours of one sign as one; how often they change sides, the ratio of the one after the largest to it, and the mean fall
    of the logarithm from one to the next from the largest on (a least-squares slope; null with fewer than three)."""
    w = Window.partitionBy("id").orderBy("dt")
    mag = F.abs(x)
    d = near.filter(F.col(x).isNotNull()).select("id", "dt", x, F.max(mag).over(Window.partitionBy("id")).alias("top"), F.lag(mag).over(w).alias("a"), F.lead(mag).over(w).alias("b"))
    peaks = d.filter((mag > F.col("a")) & (mag > F.col("b")) & (mag >= frac * F.col("top")) & (F.col("top") > 0)).select("id", "dt", mag.alias("mag"), F.signum(x).alias("side"))
    peaks = peaks.withColumn("run", F.sum(F.when(F.col("side") == F.lag("side").over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = peaks.groupBy("id", "run").agg(F.max("mag").alias("mag"))
    o = Window.partitionBy("id")
    runs = runs.withColumn("most", F.first("run").over(o.orderBy(F.desc("mag"), "run"))).withColumn("best", F.max("mag").over(o))
    k = F.when(F.col("run") >= F.col("most"), (F.col("run") - F.col("most")).cast("double"))
    return runs.groupBy("id").agg((F.count("*") - 1).alias("swings"), (F.max(F.when(F.col("run") == F.col("most") + 1, F.col("mag"))) / F.max("best")).alias("decay"), F.when(F.count(k) >= 3, -F.regr_slope(F.log("mag"), k)).alias("decrement"))


def described(events: DataFrame, rows: DataFrame, key: str, t: str, axes: list[str], swing: str, ratio: str, manoeuvre: dict[str, float], wheels: tuple[list[str], list[str]], v: str, cfg: dict, bucket: float = 10.0) -> DataFrame:
    """A row for each event (key, id, t_peak) with the shape of its rows.

    peak_<axis>: greatest |axis| within span_s; swings, decay and decrement of `swing` within swing_s; side: of the first row there of at least half its peak; settle_s: seconds until ratio is below settle_ratio, within settle_s;
    range_<column> within manoeuvre_s on either side, and manoeuvre: one exceeds its limit; spike: at most spike_rows rows above half the peak on every axis; crossing_hz: sign changes of the first axis in its span over
    twice its seconds; wheel columns (left, right; front first): log2 of the greatest left over the greatest right, and the seconds from the front's to the rear's greatest, beside what the speed at the peak and the
    wheelbase let expect. Events without rows have no row; unknown parts are null.
    """
    widest = max(cfg["span_s"], cfg["manoeuvre_s"], cfg["settle_s"], *(abs(x) for x in cfg["swing_s"]), cfg["wheel_s"])
    near = checkpointed(around(events, rows, key, t, "t_peak", widest, widest, bucket))
    c, dt = F.col, F.col("dt")
    span, move = F.abs(dt) <= cfg["span_s"], F.abs(dt) <= cfg["manoeuvre_s"]
    within = dt.between(*cfg["swing_s"])
    out = {f"peak_{a}": F.max(F.when(span, F.abs(a))) for a in axes}
    out |= {f"range_{m}": F.max(F.when(move, c(m))) - F.min(F.when(move, c(m))) for m in manoeuvre}
    out["settle_s"] = F.min(F.when((dt >= 0) & (dt <= cfg["settle_s"]) & (F.coalesce(c(ratio), F.lit(0.0)) < cfg["settle_ratio"]), dt))
    left, right = wheels
    roll = F.when(F.abs(dt) <= cfg["wheel_s"], F.lit(1.0))
    side = lambda names: F.max(F.greatest(*(roll * c(n) for n in names)) if len(names) > 1 else roll * c(names[0]))
    axle = lambda k: F.greatest(c(left[k]), c(right[k]))
    at = lambda k: F.min_by(F.when(roll.isNotNull(), dt), F.when(roll.isNotNull() & axle(k).isNotNull(), F.struct(-axle(k), dt)))
    out |= {"wheel_side": F.log2(side(left) / F.nullif(side(right), F.lit(0.0))), "wheel_lag_s": at(1) - at(0), "speed": F.min_by(v, F.when(c(v).isNotNull(), F.struct(F.abs(dt), dt)))}
    base = near.groupBy(key, "id").agg(*(e.alias(n) for n, e in out.items()))
    top = near.groupBy("id").agg(F.max(F.when(within, F.abs(swing))).alias("__swing"), *(F.max(F.when(span, F.abs(a))).alias(f"__p{i}") for i, a in enumerate(axes)))
    w = Window.partitionBy("id").orderBy("dt")
    first = F.when(span & c(axes[0]).isNotNull() & (c(axes[0]) != 0), F.signum(axes[0]))
    marked = near.join(top, "id").withColumn("__before", F.last(first, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    shape = marked.groupBy("id").agg(
        F.min_by(F.signum(swing), F.when(within & (F.abs(swing) >= 0.5 * c("__swing")), dt)).alias("side"),
        *(F.sum(F.when(span & (F.abs(a) > 0.5 * c(f"__p{i}")), 1).otherwise(0)).alias(f"__n{i}") for i, a in enumerate(axes)),
        F.sum(F.when(first.isNotNull() & (first != c("__before")), 1).otherwise(0)).alias("__x"), (F.max(F.when(first.isNotNull(), dt)) - F.min(F.when(first.isNotNull(), dt))).alias("__s"),
    )
    shape = shape.select("id", "side", reduce(Column.__and__, (c(f"__n{i}") <= cfg["spike_rows"] for i in range(len(axes)))).alias("spike"), (c("__x") / F.nullif(2 * c("__s"), F.lit(0.0))).alias("crossing_hz"))
    met = base.join(shape, "id").join(swings(near.filter(within), swing, cfg["swing_frac"]), "id", "left")
    large = reduce(Column.__or__, (F.coalesce(c(f"range_{m}") > limit, F.lit(False)) for m, limit in manoeuvre.items()))
    return met.select(*base.columns, (cfg["wheelbase"] / F.greatest("speed", F.lit(0.1))).alias("wheel_lag_expected_s"), large.alias("manoeuvre"), "side", "spike", "crossing_hz", F.coalesce("swings", F.lit(0)).alias("swings"), "decay", "decrement")


def first_exceedances(events: DataFrame, rows: DataFrame, key: str, t: str, onset: str, sensors: dict[str, float], base: tuple[float, float], look: tuple[float, float], noise: float, bucket: float = 10.0) -> DataFrame:
    """(key, id, lag_<sensor>, move_<sensor>, order) of events (key, id, onset): when each sensor first leaves its base, in seconds since the onset, and by how much at most from the onset on.

    The base is the median over base[0] <= dt < base[1]; a sensor has left it beyond its limit, or beyond `noise` robust deviations of the base's rows, whichever is more. order names the sensors that moved, first ones first.
    Without rows to take a base from, a sensor has not moved.
    """
    near = around(events, rows, key, t, onset, max(-base[0], -look[0]), max(look[1], 0.0), bucket)
    w, dt = Window.partitionBy("id"), F.col("dt")
    old = (dt >= base[0]) & (dt < base[1])
    near = near.withColumns({f"__b_{s}": F.percentile(F.when(old, F.col(s)), 0.5).over(w) for s in sensors})
    near = near.withColumns({f"__n_{s}": 1.4826 * F.percentile(F.when(old, F.abs(F.col(s) - F.col(f"__b_{s}"))), 0.5).over(w) for s in sensors})
    off = {s: F.col(s) - F.col(f"__b_{s}") for s in sensors}
    limit = {s: F.greatest(F.lit(float(x)), noise * F.coalesce(f"__n_{s}", F.lit(0.0))) for s, x in sensors.items()}
    moved = {s: F.min(F.when(dt.between(*look) & (F.abs(off[s]) > limit[s]), dt)).alias(f"lag_{s}") for s in sensors}
    most = {s: F.max_by(off[s], F.when((dt >= 0) & dt.between(*look) & off[s].isNotNull(), F.struct(F.abs(off[s]), -dt))).alias(f"move_{s}") for s in sensors}
    out = near.groupBy(key, "id").agg(*moved.values(), *most.values())
    ranked = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"lag_{s}").alias("lag"), F.lit(s).alias("sensor")) for s in sensors)), lambda x: x["lag"].isNotNull()))
    return out.withColumn("order", F.array_join(F.transform(ranked, lambda x: x["sensor"]), ">"))


def holds(columns: list[str], tests: list[dict]) -> Column:
    """All tests (feature, op, threshold) hold; one on a column that is not there does not."""
    return reduce(Column.__and__, (condition(F.col(x["feature"]), x["op"], float(x["threshold"])) if x["feature"] in columns else F.lit(False) for x in tests), F.lit(True))


def explained(df: DataFrame, ladder: list[dict], reasons: list[dict], otherwise: str) -> DataFrame:
    """df with hypothesis, the label of the ladder's first rung that holds, and reasons, the labels of all that hold joined by " / ".

    A rung or reason is a dict: label, and any_of, a list of lists of tests, one of which must hold as a whole. A rung may also ask for reasons (with_reasons).
    """
    test = lambda r: reduce(Column.__or__, (holds(df.columns, t) for t in r.get("any_of", [])), F.lit(False))
    out = df.withColumn("reasons", F.array_join(F.array_compact(F.array(*(F.when(test(r), F.lit(r["label"])) for r in reasons))), " / "))
    said = F.lit(otherwise)
    for r in reversed(ladder):
        said = F.when(test(r) | (F.lit(bool(r.get("with_reasons"))) & (F.col("reasons") != "")), F.lit(r["label"])).otherwise(said)
    return out.withColumn("hypothesis", said)
