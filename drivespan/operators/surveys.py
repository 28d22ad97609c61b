"""Surveys of recordings: radar tracks, poses on a grid, accuracies, inventories, compare segments and band agreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators import islands, timegrid as tg
from drivespan.operators.joins import asof, overlap_join, points_in
from drivespan.operators.stats import before_range, ranged


def radar_tracks(frames: DataFrame, key: str, t: str, address: str, first: int, count: int, fields: dict[str, Column], score_first: int, score: Column, min_score: float, max_distance: float) -> DataFrame:
    """(key, t, track, ...): the points of the track messages at `count` addresses from `first` on, a track being its address.

    fields: distance and valid, and whatever else is decoded. The score comes from the sibling address, as it was last. A point stays if it is nearer than max_distance, and
    valid or scored above min_score.
    """
    within = lambda a: F.col(address).between(a, a + count - 1)
    own = lambda a: F.struct(F.col(key).alias("key"), (F.col(address) - (a - first)).alias("track")).alias("__k")
    points = frames.filter(within(first)).select(own(first), F.col(t), *(c.alias(n) for n, c in fields.items()))
    scores = frames.filter(within(score_first)).select(own(score_first), F.col(t), score.cast("double").alias("score"))
    met = asof(points, scores, "__k", t, "score", out="score")
    kept = met.filter((F.col("distance") < max_distance) & (F.coalesce("valid", F.lit(False)) | F.coalesce(F.col("score") > min_score, F.lit(False))))
    return kept.select(F.col("__k.key").alias(key), t, F.col("__k.track").alias("track"), *fields, "score")


def interpolated(grid: DataFrame, samples: DataFrame, key: str, t: str, columns: list[str]) -> DataFrame:
    """grid with the columns of samples, linear between the samples on either side, and `nearest_s` to the nearer one; nulls outside the samples. One order by time serves all columns."""
    row = F.struct(F.col(t).cast("double").alias("t"), *(F.col(c).cast("double").alias(c) for c in columns))
    kind = samples.select(row.alias("s")).schema["s"].dataType
    a = grid.select(*grid.columns, F.col(t).cast("double").alias("__t"), F.lit(1).alias("__is"), F.lit(None).cast(kind).alias("__s"))
    b = samples.filter(F.col(t).isNotNull()).select(key, F.col(t).cast("double").alias("__t"), F.lit(0).alias("__is"), row.alias("__s"))
    w = Window.partitionBy(key)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("__a", F.last("__s", ignorenulls=True).over(w.orderBy("__t", "__is").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("__b", F.last("__s", ignorenulls=True).over(w.orderBy(F.desc("__t"), "__is").rowsBetween(Window.unboundedPreceding, 0)))
    span = F.col("__b.t") - F.col("__a.t")
    share = F.when(span > 0, (F.col("__t") - F.col("__a.t")) / span).otherwise(0.0)
    line = {c: F.col(f"__a.{c}") + share * (F.col(f"__b.{c}") - F.col(f"__a.{c}")) for c in columns}
    return both.filter("__is = 1").select(*grid.columns, *(c.alias(n) for n, c in line.items()), F.least(F.col("__t") - F.col("__a.t"), F.col("__b.t") - F.col("__t")).alias("nearest_s"))


def attach_track(grid: DataFrame, pose: DataFrame, key: str, t: str, v: str, ahead: float) -> DataFrame:
    """grid with the front wheels' x and y, heading, distance along the road, unix time, and seconds to the nearest pose.

    pose: (key, t, x, y, heading in degrees from north, unix) of a camera `ahead` metres behind the wheels. Headings are interpolated as directions.
    """
    p = pose.withColumns({"__e": F.sin(F.radians("heading")), "__n": F.cos(F.radians("heading"))})
    g = interpolated(grid, p, key, t, ["x", "y", "__e", "__n", "unix"])
    size = F.greatest(F.hypot("__e", "__n"), F.lit(1e-9))
    w = tg.by(key, t)
    step = F.coalesce(F.col(v), F.lit(0.0)) * F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    g = g.withColumns({"x": F.col("x") + ahead * F.col("__e") / size, "y": F.col("y") + ahead * F.col("__n") / size, "heading": F.pmod(F.degrees(F.atan2("__e", "__n")), F.lit(360.0)), "__step": step})
    return g.withColumn("distance", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__e", "__n", "__step")


def clip_features(df: DataFrame, clip: str, order: str, v: str, yaw: str, dt: float, fast: float, straight: float, smooth: int, reach: int) -> DataFrame:
    """(clip, fast_s, straight_s, v_median, v_max): seconds above `fast`, and of these while the smoothed yaw stays below `straight` within `reach` rows."""
    w = tg.by(clip, order)
    d = df.withColumn("__y", F.abs(F.avg(yaw).over(w.rowsBetween(-smooth, smooth))))
    d = d.withColumn("__m", F.max("__y").over(w.rowsBetween(-reach, reach)))
    hot = F.coalesce(F.col(v) > fast, F.lit(False))
    sec = lambda c: F.count(F.when(c, 1)) * dt
    return d.groupBy(clip).agg(sec(hot).alias("fast_s"), sec(hot & F.coalesce(F.col("__m") < straight, F.lit(False))).alias("straight_s"), F.percentile(v, 0.5).alias("v_median"), F.max(v).alias("v_max"))


def landmark_errors(passes: DataFrame, line: str, x: str, y: str, heading: str, centre: tuple[float, float]) -> DataFrame:
    """passes with along and cross, metres from the centre along the heading and to its right, and along_dev from the line's median."""
    e, n = F.sin(F.radians(heading)), F.cos(F.radians(heading))
    dx, dy = F.col(x) - centre[0], F.col(y) - centre[1]
    p = passes.withColumns({"along": dx * e + dy * n, "cross": dx * n - dy * e})
    return p.join(p.groupBy(line).agg(F.percentile("along", 0.5).alias("__m")), line).withColumn("along_dev", F.col("along") - F.col("__m")).drop("__m")


def pooled_deviation(errors: DataFrame, line: str, along: str = "along") -> DataFrame:
    """(n, pooled, radius): the deviation pooled over the lines, and the radius that covers two passes' difference in nineteen of twenty cases, from 5 to 15 m."""
    g = errors.groupBy(line).agg(F.count(along).alias("k"), F.var_pop(along).alias("v"))
    s = g.agg(F.sum("k").alias("n"), F.sqrt(F.sum(F.col("k") * F.col("v")) / F.greatest(F.sum("k") - F.count("*"), F.lit(1))).alias("pooled"))
    return s.withColumn("radius", F.least(F.greatest(F.ceil(2 * 2**0.5 * F.col("pooled")).cast("double"), F.lit(5.0)), F.lit(15.0)))


def site_scatter(events: DataFrame, site: str, drive: str, along: str, cross: str) -> DataFrame:
    """(site, drives, n, along_sd, cross_sd) of the sites that two drives or more have events at."""
    g = events.groupBy(site).agg(F.countDistinct(drive).alias("drives"), F.count("*").alias("n"), F.stddev_samp(along).alias("along_sd"), F.stddev_samp(cross).alias("cross_sd"))
    return g.filter("drives >= 2")


def accuracy_quantiles(fixes: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys with the number, median and 95th percentile of the known accuracies."""
    return fixes.filter(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.95).alias("p95"))


def effective_rate(samples: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys with the samples' real rate: intervals over the time that they span."""
    return samples.groupBy(*keys).agg(F.try_divide((F.count(t) - 1).cast("double"), F.max(t) - F.min(t)).alias("hz"))


def blanked(df: DataFrame, rates: DataFrame, keys: list[str], least_hz: float, columns: list[str]) -> DataFrame:
    """df with the columns null where the key's rate stays below the limit, or is unknown."""
    ok = F.coalesce(F.col("hz") >= least_hz, F.lit(False))
    return df.join(rates, keys, "left").withColumns({c: F.when(ok, F.col(c)) for c in columns}).drop("hz")


def impact_metrics(rows: DataFrame, hits: DataFrame, key: str, t: str, measured: str, predicted: str, first: tuple[float, float], share: float, impact: tuple[float, float], before: tuple[float, float], lags: list[int], dt: float, bucket: float) -> DataFrame:
    """(id, first_sign, first_dt, r0, r_best, lag, precursor) of each hit (key, id, t_hit): the sign and time at which the measured series first reaches `share` of its greatest
    size in `first`; its correlation with the prediction in `impact` at no lag and at the best one (seconds); and the greatest size in `before` over that in all three windows."""
    w = tg.by(key, t)
    moved = {f"__m{i}": (F.lead(measured, k).over(w) if k > 0 else F.lag(measured, -k).over(w) if k else F.col(measured)) for i, k in enumerate(lags)}
    lo, hi = min(first[0], impact[0], before[0]), max(first[1], impact[1], before[1])
    spans = hits.select(key, "id", "t_hit", (F.col("t_hit") + lo).alias("b_start"), (F.col("t_hit") + hi).alias("b_end"))
    m = points_in(rows.select(key, t, measured, predicted).withColumns(moved), spans, key, t, bucket).withColumn("__d", F.col(t) - F.col("t_hit"))
    inside = lambda r: F.col("__d").between(*r)
    top = m.groupBy("id").agg(F.max(F.when(inside(first), F.abs(measured))).alias("__top"))
    m = m.join(top, "id")
    reach = F.when(inside(first) & (F.abs(measured) >= share * F.col("__top")) & (F.col("__top") > 1e-6), F.struct(F.col("__d").alias("d"), F.signum(measured).alias("s")))
    r = {k: F.corr(F.when(inside(impact), F.col(f"__m{i}")), F.when(inside(impact), F.col(predicted))) for i, k in enumerate(lags)}
    g = m.groupBy("id").agg(F.min(reach).alias("f"), *(c.alias(f"r{i}") for i, c in enumerate(r.values())), F.try_divide(F.max(F.when(inside(before), F.abs(measured))), F.max(F.abs(measured))).alias("precursor"))
    best = F.array_max(F.array_compact(F.array(*(F.when(F.col(f"r{i}").isNotNull(), F.struct(F.round(F.col(f"r{i}"), 9).alias("r"), F.lit(-abs(k)).alias("a"), F.lit(k * dt).alias("lag"))) for i, k in enumerate(lags)))))
    return g.select("id", F.coalesce(F.col("f.s").cast("int"), F.lit(0)).alias("first_sign"), F.col("f.d").alias("first_dt"), F.col(f"r{lags.index(0)}").alias("r0"), best["r"].alias("r_best"), best["lag"].alias("lag"), "precursor")


def wheel_side(rows: DataFrame, spans: DataFrame, key: str, t: str, wheels: dict[str, str], bucket: float) -> DataFrame:
    """(id, ratio, side, lag): right over left of the wheels' effective values (fl, fr, rl, rr) inside each span (key, id, t_start, t_end), the stronger side, and how much later its rear wheel peaks than its front one."""
    s = spans.select(key, "id", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    m = points_in(rows.select(key, t, *wheels.values()), s, key, t, bucket)
    rms = {w: F.sqrt(F.avg(F.col(c) ** 2)).alias(w) for w, c in wheels.items()}
    peak = {w: F.max_by(t, F.struct(F.abs(c), -F.col(t))).alias(f"t_{w}") for w, c in wheels.items()}
    g = m.groupBy("id").agg(*rms.values(), *peak.values())
    right, left = F.col("fr") + F.col("rr"), F.col("fl") + F.col("rl")
    return g.select("id", F.try_divide(right, left).alias("ratio"), F.when(right > left, "right").otherwise("left").alias("side"), F.when(right > left, F.col("t_rr") - F.col("t_fr")).otherwise(F.col("t_rl") - F.col("t_fl")).alias("lag"))


def screen_mask(df: DataFrame, block: str, order: str, v: str, yaw: str, turning: Column, least_v: float, most_yaw: float, window: int, margin: int, edge: int) -> DataFrame:
    """df with `screened`: fast, straight over `window` rows, no indicator within `margin` rows, and not within `edge` rows of the block's ends."""
    w, all_ = tg.by(block, order), Window.partitionBy(block)
    row, n = F.row_number().over(w), F.count("*").over(all_)
    mean = F.abs(F.avg(yaw).over(w.rowsBetween(-(window // 2), window // 2)))
    ok = (F.col(v) >= least_v) & (mean < most_yaw) & ~tg.dilate(turning, block, order, margin) & (row > edge) & (row <= n - edge)
    return df.withColumn("screened", F.coalesce(ok, F.lit(False)))


def group_drives(files: DataFrame, car: str, tolerance: float) -> DataFrame:
    """files (id, car, t0, t1) with `drive`: the number of the run of a car's files, by start and end, in which neighbours begin and end within the tolerance of each other."""
    w = Window.partitionBy(car).orderBy("t0", "t1", "id")
    new = (F.abs(F.col("t0") - F.lag("t0").over(w)) > tolerance) | (F.abs(F.col("t1") - F.lag("t1").over(w)) > tolerance)
    return files.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("drive", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def overlapping_files(files: DataFrame, car: str, bucket: float) -> DataFrame:
    """(car, a, b, seconds): files (id, car, t0, t1) of a car that share time, each pair once."""
    side = lambda n: files.select(car, F.col("id").alias(n), F.col("t0").alias(f"{n}_start"), F.col("t1").alias(f"{n}_end"))
    met = overlap_join(side("a"), side("b"), car, bucket).filter("a < b")
    return met.select(car, "a", "b", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("seconds")).filter("seconds > 0")


def inventory_quantiles(df: DataFrame, keys: list[str], metrics: list[str], excited: Column) -> DataFrame:
    """keys and metric with n, left_out, p05 to p95 and the share of negative values, over the rows that are excited enough."""
    ok = F.coalesce(excited, F.lit(False))
    long = df.select(*keys, ok.alias("__ok"), F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("__x")) for m in metrics))))
    x = F.when(F.col("__ok"), F.col("__x"))
    q = F.percentile(x, F.array(*(F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95))))
    g = long.groupBy(*keys, "metric").agg(F.count(x).alias("n"), F.count(F.when(~F.col("__ok"), 1)).alias("left_out"), q.alias("q"), F.avg((x < 0).cast("int")).alias("negative"))
    return g.select(*keys, "metric", "n", "left_out", *(F.get("q", i).alias(f"p{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))), "negative")


def code_shares(df: DataFrame, keys: list[str], code: Column) -> DataFrame:
    """keys and code with their number and share within the keys; null is a code of its own."""
    g = df.withColumn("code", code).groupBy(*keys, "code").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def compare_segments(rows: DataFrame, candidates: DataFrame, block: str, t: str, screened: Column, width: float, least_rows: int, margin: float) -> DataFrame:
    """(block, seg, t0, t1, n, has_candidate): stretches of `width` seconds with at least so many screened rows, and whether a candidate (block, t_start, t_end) comes within the margin."""
    own = rows.filter(F.coalesce(screened, F.lit(False))).groupBy(block, F.floor(F.col(t) / width).alias("seg")).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    a = own.select(block, "seg", F.col("t0").alias("a_start"), F.col("t1").alias("a_end"))
    b = candidates.select(block, F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    hit = overlap_join(a, b, block, width, pad=margin).select(block, "seg").distinct().withColumn("__hit", F.lit(True))
    return own.join(hit, [block, "seg"], "left").select(block, "seg", "t0", "t1", "n", F.coalesce("__hit", F.lit(False)).alias("has_candidate"))


def capped_plan(needs: DataFrame, order: list[Column], size: str, cap: float, always: Column) -> DataFrame:
    """needs with `total`, the running sum of size in the order, and `selected`: within the cap, or always. The sum runs inside ranges of the order, plus the ranges before."""
    rows = ranged(needs, order)
    own = F.sum(size).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(F.broadcast(before_range(rows, F.sum(size))), "__range").withColumn("total", own + F.col("__before")).drop("__range", "__before")
    return out.withColumn("selected", F.coalesce(always, F.lit(False)) | (F.col("total") <= cap))


def band_terms(df: DataFrame, block: str, order: str, reference: Column, terms: dict[str, Column], taps: list[float]) -> DataFrame:
    """(block, term, sd, r, slope): of each term, filtered by the taps, its deviation, its correlation with the filtered reference, and the slope of the reference on it."""
    d = df.select(block, order, reference.alias("__ref"), *(c.alias(n) for n, c in terms.items()))
    d = d.select(block, tg.fir(F.col("__ref"), block, order, taps).alias("__ref"), *(tg.fir(F.col(n), block, order, taps).alias(n) for n in terms))
    long = d.select(block, "__ref", F.inline(F.array(*(F.struct(F.lit(n).alias("term"), F.col(n).alias("x")) for n in terms))))
    return long.groupBy(block, "term").agg(F.stddev_pop("x").alias("sd"), F.corr("x", "__ref").alias("r"), F.try_divide(F.covar_pop("x", "__ref"), F.var_pop("x")).alias("slope"))


def pooled_quantiles(df: DataFrame, mask: Column, quantities: dict[str, Column], shares: list[float]) -> DataFrame:
    """(quantity, n, mean, sd, p...) of each quantity over all rows where the mask holds."""
    own = df.filter(F.coalesce(mask, F.lit(False)))
    long = own.select(F.inline(F.array(*(F.struct(F.lit(n).alias("quantity"), c.cast("double").alias("x")) for n, c in quantities.items())))).filter("x is not null")
    g = long.groupBy("quantity").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.percentile("x", F.array(*(F.lit(p) for p in shares))).alias("q"))
    return g.select("quantity", "n", "mean", "sd", *(F.get("q", i).alias(f"p{round(100 * p):02d}") for i, p in enumerate(shares)))


def band_agreement(df: DataFrame, block: str, order: str, a: Column, b: Column, mask: Column, bands: dict[str, list[float]], least: int) -> DataFrame:
    """(block, n, r_..., ratio_...): over the rows where the mask holds, the correlation of two series in each band (its taps) and b's deviation over a's; blocks with fewer rows are left out."""
    d = df.withColumns({"__a": a, "__b": b, "__ok": F.coalesce(mask, F.lit(False))})
    d = d.withColumns({f"__{s}_{n}": tg.fir(F.col(f"__{s}"), block, order, taps) for s in "ab" for n, taps in bands.items()}).filter("__ok")
    aggs = [x for n in bands for x in (F.corr(f"__a_{n}", f"__b_{n}").alias(f"r_{n}"), F.try_divide(F.stddev_pop(f"__b_{n}"), F.stddev_pop(f"__a_{n}")).alias(f"ratio_{n}"))]
    return d.groupBy(block).agg(F.count("*").alias("n"), *aggs).filter(F.col("n") >= least)
