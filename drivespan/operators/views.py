"""Views of drives and events: catalogues, medians over time, comfort, window tables, priorities, reviews and sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.operators import islands, timegrid as tg
from drivespan.operators.joins import asof, heading_difference, near_pairs, overlap_join, points_in


def segment_catalogue(rows: DataFrame, drive: str, t: str, length: float, listed: DataFrame | None = None) -> DataFrame:
    """(drive, index, n, t0, t1) of every recorded segment of `length` seconds; with a catalogue (drive, ...), of the listed drives' only."""
    own = rows if listed is None else rows.join(listed.select(drive).distinct(), drive, "left_semi")
    return own.groupBy(drive, F.floor(F.col(t) / length).alias("index")).agg(F.count("*").alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"))


def controller_active(frames: DataFrame, key: str, t: str, src: Column, address: Column, flag: int, addresses: list[int], width: float) -> DataFrame:
    """(key, bin, n): bins of `width` seconds in which the controller sent frames of its own (the flag is set in src) on its addresses."""
    own = frames.filter((src.bitwiseAND(F.lit(flag)) != 0) & address.isin(*addresses))
    return own.groupBy(key, F.floor(F.col(t) / width).alias("bin")).agg(F.count("*").alias("n"))


def rolling_time_median(df: DataFrame, block: str, t: str, x: str, half: float, least: int) -> DataFrame:
    """df with `median` of the known x within half seconds (to the millisecond) of each row, from `least` values up, and `filled`: where there are fewer, the median is linear between the rows that have one, and null before the first and after the last."""
    w, around = tg.by(block, t), Window.partitionBy(block).orderBy((F.col(t) * 1000).cast("long")).rangeBetween(-int(half * 1000), int(half * 1000))
    own = F.when(F.count(x).over(around) >= least, F.percentile(x, 0.5).over(around))
    d = df.withColumn("__m", own).withColumn("__p", F.when(F.col("__m").isNotNull(), F.struct(F.col(t).alias("t"), F.col("__m").alias("m"))))
    a, b = F.last("__p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("__p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumns({"__a": a, "__b": b})
    line = F.col("__a.m") + (F.col(t) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t")) * (F.col("__b.m") - F.col("__a.m"))
    return d.withColumns({"filled": F.col("__m").isNull(), "median": F.coalesce("__m", line)}).drop("__m", "__p", "__a", "__b")


COMFORT = ((0.315, "not uncomfortable"), (0.63, "a little"), (1.0, "fairly"), (1.6, "uncomfortable"), (2.5, "very"))


def comfort_class(rms: Column) -> Column:
    """The class of a weighted acceleration by the lower of ISO 2631's overlapping limits; null stays null."""
    out = F.lit("extremely")
    for limit, name in reversed(COMFORT):
        out = F.when(rms < limit, name).otherwise(out)
    return F.when(rms.isNotNull(), out)


def ride_comfort(df: DataFrame, block: str, order: str, x: str, taps: list[float], rate_hz: float, window: int) -> DataFrame:
    """(block, rms, mtvv, vdv, comfort) of x weighted by the taps: the effective value, the greatest running one, the fourth-power dose, and the class."""
    d = df.withColumn("__w", tg.fir(F.col(x), block, order, taps)).withColumn("__r", tg.moving_rms(F.col("__w"), block, order, window))
    g = d.groupBy(block).agg(F.sqrt(F.avg(F.col("__w") ** 2)).alias("rms"), F.max("__r").alias("mtvv"), F.pow(F.sum(F.pow("__w", F.lit(4.0))) / rate_hz, 0.25).alias("vdv"))
    return g.withColumn("comfort", comfort_class(F.col("rms")))


def event_ride(rows: DataFrame, events: DataFrame, key: str, t: str, axes: dict[str, str], rate_hz: float, bucket: float) -> DataFrame:
    """(id, rms_..., vdv_..., crest, dominant) of each event (key, id, t_start, t_end): effective value and dose by axis, the dominant axis by dose, and its peak over its effective value."""
    spans = events.select(key, "id", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    m = points_in(rows.select(key, t, *axes.values()), spans, key, t, bucket)
    aggs = [a for n, c in axes.items() for a in (F.sqrt(F.avg(F.col(c) ** 2)).alias(f"rms_{n}"), F.pow(F.sum(F.pow(c, F.lit(4.0))) / rate_hz, 0.25).alias(f"vdv_{n}"), F.max(F.abs(c)).alias(f"__p_{n}"))]
    top = F.array_max(F.array(*(F.struct(F.round(F.col(f"vdv_{n}"), 9).alias("v"), F.lit(n).alias("n"), F.try_divide(F.col(f"__p_{n}"), F.col(f"rms_{n}")).alias("c")) for n in axes)))
    return m.groupBy("id").agg(*aggs).select("id", *(f"{k}_{n}" for n in axes for k in ("rms", "vdv")), top["c"].alias("crest"), top["n"].alias("dominant"))


def true_spans(df: DataFrame, mask: Column, block: str, t: str, step: float) -> DataFrame:
    """(block, start, end): the stretches in which mask holds, each half open: it ends a step after its last row."""
    return islands.intervals(df, mask, block, t, step).select(block, F.col("t_start").alias("start"), (F.col("t_end") + step).alias("end"))


def zeroed_sideslip(df: DataFrame, drive: str, course: Column, axis: Column, straight: Column) -> DataFrame:
    """df with beta, the angle from the camera's axis to the course wrapped to +-180 degrees, less its median in the drive's straight rows; null for drives without any."""
    d = df.withColumn("__b", F.pmod(course - axis + 180.0, F.lit(360.0)) - 180.0)
    zero = d.filter(F.coalesce(straight, F.lit(False))).groupBy(drive).agg(F.percentile("__b", 0.5).alias("__z"))
    return d.join(zero, drive, "left").withColumn("beta", F.col("__b") - F.col("__z")).drop("__b", "__z")


def window_table(df: DataFrame, keys: list[str], t: str, width: float, ranges: list[str], wheels: list[str], flags: list[str], v: str, yaw_dps: str) -> DataFrame:
    """keys and win with the range of each column, the greatest gap between the wheels, whether each flag was up, and ay_bound: the greatest speed times the greatest yaw rate."""
    gap = F.greatest(*wheels) - F.least(*wheels)
    aggs = [*((F.max(c) - F.min(c)).alias(f"{c}_range") for c in ranges), F.max(gap).alias("wheel_gap"), *(F.coalesce(F.max((F.col(c) > 0.5).cast("int")), F.lit(0)).alias(f"{c}_up") for c in flags)]
    return df.groupBy(*keys, F.floor(F.col(t) / width).alias("win")).agg(F.count("*").alias("n"), *aggs, (F.max(v) * F.radians(F.max(F.abs(yaw_dps)))).alias("ay_bound"))


def inherited_priority(events: DataFrame, candidates: DataFrame, block: str, bucket: float) -> DataFrame:
    """events (block, id, t_start, t_end, ...) with the least priority of the candidates (block, t_start, t_end, priority) that overlap each; null without any."""
    a = events.select(block, "id", F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    b = candidates.select(block, "priority", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    best = overlap_join(a, b, block, bucket).groupBy(block, "id").agg(F.min("priority").alias("priority"))
    return events.join(best, [block, "id"], "left")


def attached_review(sites: DataFrame, review: DataFrame, x: str, y: str, heading: str, radius: float, turn: float) -> DataFrame:
    """(id, review, dist) of each site (id, x, y, heading): the nearest review row (review, x, y, heading) within the radius whose heading differs by `turn` degrees at most, the lesser id of equals; nulls without any."""
    near = near_pairs(sites, review, x, y, radius).filter(heading_difference(F.col(heading), F.col(f"b_{heading}")) <= turn)
    best = near.groupBy("id").agg(F.min_by("b_review", F.struct("dist", "b_review")).alias("review"), F.min("dist").alias("dist"))
    return sites.select("id").join(best, "id", "left")


def daytime_best(events: DataFrame, site: str, unix: str, offset_h: float, hours: tuple[int, int], score: str, reasons: dict[str, Column]) -> DataFrame:
    """(site, best, score, reason): of each site's events whose local hour lies in the range, the strongest, the lesser id of equals, and the tests it passes as text."""
    hour = F.floor(F.pmod(F.col(unix) / 3600 + offset_h, F.lit(24.0)))
    day = events.filter((hour >= hours[0]) & (hour < hours[1])).withColumn("__r", F.concat_ws(", ", *(F.when(c, F.lit(n)) for n, c in reasons.items())))
    best = F.max_by(F.struct("id", score, "__r"), F.struct(F.col(score), -F.col("id"))).alias("b")
    return day.groupBy(site).agg(best).select(site, F.col("b.id").alias("best"), F.col(f"b.{score}").alias("score"), F.col("b.__r").alias("reason"))


def weather_with_fallback(events: DataFrame, minutes: DataFrame, reports: DataFrame, key: str, t: str, value: str, tolerance: float) -> DataFrame:
    """events with `weather` and `source`: the minute table's value at the event's minute, else the nearest report's within the tolerance, else null and none."""
    exact = minutes.groupBy(key, F.floor(F.col(t) / 60).alias("__min")).agg(F.max(value).alias("__exact"))
    d = asof(events, reports, key, t, value, "nearest", tolerance, out="__near").withColumn("__min", F.floor(F.col(t) / 60)).join(exact, [key, "__min"], "left")
    source = F.when(F.col("__exact").isNotNull(), "minute").when(F.col("__near").isNotNull(), "report").otherwise("none")
    return d.select(*events.columns, F.coalesce("__exact", "__near").alias("weather"), source.alias("source"))


def screening_pivot(events: DataFrame, hours: DataFrame, group: str, kind: str, kinds: list[str]) -> DataFrame:
    """(group, hours, n_..., per_hour_...) of each group: the number of events of each kind, and over its recorded hours (group, hours)."""
    n = events.groupBy(group).agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k}") for k in kinds))
    out = hours.join(n, group, "left").na.fill(0, [f"n_{k}" for k in kinds])
    return out.withColumns({f"per_hour_{k}": F.try_divide(F.col(f"n_{k}").cast("double"), F.col("hours")) for k in kinds})


def signal_sanity(df: DataFrame, keys: list[str], gyro: str, rate: str, v: str, other_v: str, stopped: float) -> DataFrame:
    """keys with the slope of the gyro on the heading rate, the gyro's mean at standstill, and the median ratio of two speeds above 5 m/s."""
    ratio = F.when(F.col(v) > 5.0, F.col(other_v) / F.col(v))
    return df.groupBy(*keys).agg(F.regr_slope(F.col(gyro), F.col(rate)).alias("slope"), F.avg(F.when(F.col(v) < stopped, F.col(gyro))).alias("stop_bias"), F.percentile(ratio, 0.5).alias("speed_ratio"))


def zero_offsets(df: DataFrame, drive: str, x: str, straight: Column, slow: Column) -> DataFrame:
    """(drive, all, straight, symmetric): the zero of x by three methods: the median of all rows, the median of the straight ones, and halfway between the 5th and 95th percentile of the faster ones."""
    fast = F.when(~F.coalesce(slow, F.lit(False)), F.col(x))
    q = F.percentile(fast, F.array(F.lit(0.05), F.lit(0.95)))
    g = df.groupBy(drive).agg(F.percentile(x, 0.5).alias("all"), F.percentile(F.when(straight, F.col(x)), 0.5).alias("straight"), q.alias("__q"))
    return g.select(drive, "all", "straight", ((F.get("__q", 0) + F.get("__q", 1)) / 2).alias("symmetric"))


def negative_clip_scores(alarms: DataFrame, clips: DataFrame, clip: str, seconds: str, flicker: float) -> DataFrame:
    """(clip, episodes, flicker_only, alarm_share, per_minute) of each clip (clip, seconds) without an event: its alarm episodes (clip, t_start, t_end), whether all are shorter than `flicker`, their share of the time and their number a minute."""
    g = alarms.groupBy(clip).agg(F.count("*").alias("episodes"), F.max(F.col("t_end") - F.col("t_start")).alias("__longest"), F.sum(F.col("t_end") - F.col("t_start")).alias("__s"))
    d = clips.join(g, clip, "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    return d.select(clip, "episodes", ((F.col("episodes") > 0) & (F.coalesce("__longest", F.lit(0.0)) < flicker)).alias("flicker_only"), F.try_divide(F.coalesce("__s", F.lit(0.0)), F.col(seconds)).alias("alarm_share"), F.try_divide(F.col("episodes") * 60.0, F.col(seconds)).alias("per_minute"))


def calm_controls(cases: DataFrame, rows: DataFrame, key: str, order: str, v: str, x: str, rows_around: int, limit: float, width: float, k: int, seed: int) -> DataFrame:
    """(id, control, pick): for each case (id, key, v) up to k rows (control) of its key and speed bin around which |x| stays below the limit, by hash. A bin is first thinned to what can be picked at all."""
    w = tg.by(key, order).rowsBetween(-rows_around, rows_around)
    calm = rows.withColumn("__m", F.max(F.abs(x)).over(w)).filter(F.col("__m") < limit).select(F.col("control"), key, F.floor(F.col(v) / width).alias("bin"))
    calm = calm.withColumn("__r", F.row_number().over(Window.partitionBy(key, "bin").orderBy(draw(seed, F.col("control")), "control"))).filter(F.col("__r") <= k + 1)
    m = cases.select("id", key, F.floor(F.col(v) / width).alias("bin")).join(calm, [key, "bin"]).filter("id <> control")
    return m.withColumn("pick", F.row_number().over(Window.partitionBy("id").orderBy("__r"))).filter(F.col("pick") <= k).select("id", "control", "pick")


def even_calm_segments(segments: DataFrame, windy: DataFrame, x: str, y: str, drive: str, radius: float, cap: int) -> DataFrame:
    """(drive, id, rank): calm segments (drive, id, x, y) with a windy point (x, y) within the radius, at most `cap` a drive, by id."""
    near = near_pairs(segments, windy, x, y, radius).select(drive, "id").distinct()
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(drive).orderBy("id"))).filter(F.col("rank") <= cap)


def smoothed_resample(grid: DataFrame, samples: DataFrame, key: str, t: str, x: str, rows: int, max_gap: float) -> DataFrame:
    """grid with x, the samples' centred mean over `rows` of them, linear between neighbours, and valid: whether these are at most max_gap apart. Outside the samples x is null and not valid."""
    from drivespan.operators.surveys import interpolated

    half = rows // 2
    s = samples.select(key, t, F.avg(x).over(tg.by(key, t).rowsBetween(-half, half)).alias(x), F.col(t).alias("__at"))
    w = tg.by(key, t)
    s = s.withColumns({"__next": F.coalesce(F.lead("__at").over(w), F.col("__at"))})
    near = asof(grid, s.withColumn("__gap", F.col("__next") - F.col("__at")), key, t, "__gap", out="__gap")
    out = interpolated(near, s, key, t, [x])
    exact = F.col("__gap_t") == F.col(t)
    return out.withColumn("valid", F.coalesce(F.col(x).isNotNull() & (exact | (F.col("__gap") <= max_gap)), F.lit(False))).select(*grid.columns, x, "valid")


def bin_modes(samples: DataFrame, key: str, t: str, width: float, over: Column, window: int, pad: int) -> DataFrame:
    """(key, bins, kept_window, kept_event): shares of the bins that are kept if any bin of their window of `window` bins is over, and if any bin within `pad` of them is."""
    b = samples.groupBy(key, F.floor(F.col(t) / width).alias("bin")).agg(F.bool_or(F.coalesce(over, F.lit(False))).alias("over"))
    near = Window.partitionBy(key).orderBy("bin").rangeBetween(-pad, pad)
    b = b.withColumns({"__w": F.bool_or("over").over(Window.partitionBy(key, F.floor(F.col("bin") / window))), "__e": F.bool_or("over").over(near)})
    return b.groupBy(key).agg(F.count("*").alias("bins"), F.avg(F.col("__w").cast("int")).alias("kept_window"), F.avg(F.col("__e").cast("int")).alias("kept_event"))


def with_fallbacks(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """df with each wanted column as the first of its sources that df has and that is not null; null where there is none."""
    have = lambda names: [F.col(n) for n in names if n in df.columns]
    return df.withColumns({out: F.coalesce(*have(names)) if have(names) else F.lit(None).cast("double") for out, names in wanted.items()})


def condition_losses(df: DataFrame, conditions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(condition, kept, kept_loosely, lost) for each (strict, loose) condition: rows that pass, that pass with the margin, and the difference. Null passes nothing."""
    n = lambda c: F.count(F.when(F.coalesce(c, F.lit(False)), 1))
    g = df.agg(*(n(c).alias(f"{k}{i}") for i, both in enumerate(conditions.values()) for k, c in zip("ab", both, strict=True)))
    return g.select(F.inline(F.array(*(F.struct(F.lit(name).alias("condition"), F.col(f"a{i}").alias("kept"), F.col(f"b{i}").alias("kept_loosely"), (F.col(f"b{i}") - F.col(f"a{i}")).alias("lost")) for i, name in enumerate(conditions)))))


def behaviour_ratio(rows: DataFrame, events: DataFrame, key: str, t: str, columns: list[str], v: str, yaw_dps: str, span: float, dt: float, bucket: float) -> DataFrame:
    """(id, ratio_..., offset) of each event (key, id, t_start, t_end): each column's effective value in the `span` seconds after it over that in those before, and the lateral offset after it, the integral of speed times the heading turned since its end."""
    s = events.select(key, "id", "t_start", "t_end", (F.col("t_start") - span).alias("b_start"), (F.col("t_end") + span).alias("b_end"))
    m = points_in(rows.select(key, t, v, yaw_dps, *(c for c in columns if c not in (v, yaw_dps))), s, key, t, bucket)
    before, after = F.col(t) < F.col("t_start"), F.col(t) > F.col("t_end")
    rms = lambda c, part: F.sqrt(F.avg(F.when(part, F.col(c) ** 2)))
    turned = F.sum(F.when(after, F.coalesce(yaw_dps, F.lit(0.0)) * dt)).over(Window.partitionBy("id").orderBy(t))
    m = m.withColumn("__y", F.when(after, F.col(v) * F.sin(F.radians(turned)) * dt))
    return m.groupBy("id").agg(*(F.try_divide(rms(c, after), rms(c, before)).alias(f"ratio_{c}") for c in columns), F.sum("__y").alias("offset"))


def jerk_feasibility(df: DataFrame, block: str, order: str, ax: str, filters: dict[str, list[float]], cruising: Column, braking: Column, dt: float) -> DataFrame:
    """(filter, noise, signal, separation): of the jerk of each filtered acceleration the 95th percentile of its size while cruising, its median while braking, and their ratio."""
    d = df.withColumns({f"__f{i}": tg.fir(F.col(ax), block, order, taps) for i, taps in enumerate(filters.values())})
    d = d.withColumns({f"__j{i}": F.abs(tg.derivative(F.col(f"__f{i}"), block, order, dt)) for i in range(len(filters))})
    long = d.select(cruising.alias("__c"), braking.alias("__b"), F.inline(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(f"__j{i}").alias("j")) for i, n in enumerate(filters)))))
    g = long.groupBy("filter").agg(F.percentile(F.when(F.col("__c"), F.col("j")), 0.95).alias("noise"), F.percentile(F.when(F.col("__b"), F.col("j")), 0.5).alias("signal"))
    return g.withColumn("separation", F.try_divide("signal", "noise"))


def first_by_priority(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, source, conflicts) over tables (key, value) in order of priority: the first known value, its table's place, and how many later tables know another one."""
    both = None
    for i, df in enumerate(tables):
        own = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias(value)).withColumn("source", F.lit(i))
        both = own if both is None else both.unionByName(own)
    w = Window.partitionBy(key).orderBy("source")
    return both.withColumn("__first", F.first(value).over(w)).groupBy(key).agg(F.min_by(value, "source").alias(value), F.min("source").alias("source"), F.count(F.when(F.col(value) != F.col("__first"), 1)).alias("conflicts"))


def review_rates(reviews: DataFrame, kind: str, light: str, hit: Column, control: Column) -> DataFrame:
    """(kind, light, n, rate, control_rate, lift): how often the reviewed rows of each kind and light show a feature, how often the control rows of that light do, and the ratio."""
    own, c = F.coalesce(hit, F.lit(False)).cast("int"), F.coalesce(control, F.lit(False))
    base = reviews.groupBy(light).agg(F.avg(F.when(c, own)).alias("control_rate"))
    g = reviews.filter(~c).groupBy(kind, light).agg(F.count("*").alias("n"), F.avg(own).alias("rate"))
    return g.join(base, light).select(kind, light, "n", "rate", "control_rate", F.try_divide("rate", "control_rate").alias("lift"))


def raw_flag_runs(samples: DataFrame, speed: DataFrame, drive: str, channel: str, t: str, v: str, limit: float, gap: float) -> DataFrame:
    """(drive, channel, run, t_start, t_end, n, speed): runs of a channel's raw samples above the limit, at most `gap` apart, with the speed (drive, t, v) nearest to their start."""
    w = Window.partitionBy(drive, channel).orderBy(t)
    s = samples.withColumn("__on", F.coalesce(F.col(v) > limit, F.lit(False)))
    new = F.col("__on") & (~F.coalesce(F.lag("__on").over(w), F.lit(False)) | (F.col(t) - F.lag(t).over(w) > gap))
    s = s.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__on")
    g = s.groupBy(drive, channel, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"))
    return asof(g.withColumn(t, F.col("t_start")), speed, drive, t, v, "nearest", out="speed").select(drive, channel, "run", "t_start", "t_end", "n", "speed")
