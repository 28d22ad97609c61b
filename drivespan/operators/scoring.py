"""Scores and flags of events: disturbances, gust peaks, impulsive responses, sites, targets, tiers and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators import islands
from drivespan.operators.joins import overlap_join, points_in
from drivespan.operators.stats import before_range, numbered, ranged


def known(c: Column, least: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(least))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """c held between two bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def percent_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with the average rank of x over its known values, divided by their number; null where x is. Distinct values are counted by ranges, so no window holds all rows."""
    values = ranged(df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("__c")), [F.asc(x)])
    own = F.sum("__c").over(Window.partitionBy("__range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.join(F.broadcast(before_range(values, F.sum("__c"))), "__range").select(x, (own + F.col("__before") - (F.col("__c") - 1) / 2).alias("__rank"))
    total = values.agg(F.sum("__c").alias("__all"))
    return df.join(ranks, x, "left").crossJoin(F.broadcast(total)).withColumn(out, F.col("__rank") / F.col("__all")).select(*df.columns, out)


def disturbance(heave: Column, roll: Column, pitch: Column) -> Column:
    """The geometric mean of the heave ratio and the greater one of roll and pitch; unknown ratios are 0."""
    return F.sqrt(known(heave) * F.greatest(known(roll), known(pitch)))


def strongest_of_overlaps(events: DataFrame, key: str, score: str, gap: float) -> DataFrame:
    """Events (key, t_start, t_end, score, ...) taken by start: one that begins at most gap after the end of the one kept last replaces it if stronger, else goes.

    A key's events are cut where one begins later than that after all ends before, which changes nothing and keeps each fold short.
    """
    row = F.struct("t_start", "t_end", score, F.struct(*events.columns).alias("all"))
    parts = islands.merge_intervals(events, key, "t_start", "t_end", gap + 1e-6).groupBy(key, "group").agg(F.array_sort(F.collect_list(row)).alias("e"))
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: (
        F.when((F.size(acc) == 0) | (x["t_start"] > last(acc)["t_end"] + gap), F.concat(acc, F.array(x)))
        .when(x[score] > last(acc)[score], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x)))
        .otherwise(acc)
    )
    kept = F.aggregate("e", F.filter("e", lambda x: F.lit(False)), step)
    return parts.select(F.explode(kept).alias("x")).select("x.all.*")


def gust_peaks(df: DataFrame, block: str, t: str, z1: str, z2: str, sets: dict[str, tuple[Column, Column]], limit: float, refractory: float, step: float) -> DataFrame:
    """(set, block, t_start, t_peak, t_end, z): for each set (mask, sign) the runs in which both signed scores reach the limit where the mask holds, with their peak.

    Runs that begin within `refractory` of the end of one kept go; the rest are kept in order of time.
    """
    tagged = [F.when(F.coalesce(mask, F.lit(False)), F.struct(F.lit(name).alias("set"), sign.cast("double").alias("sign"))) for name, (mask, sign) in sets.items()]
    rows = df.select(block, t, z1, z2, F.inline(F.array_compact(F.array(*tagged)))).withColumn("__z", F.least(F.col("sign") * F.col(z1), F.col("sign") * F.col(z2)))
    rows = rows.filter(F.col(z1).isNotNull() & F.col(z2).isNotNull() & (F.col("__z") >= limit)).withColumn("__b", F.struct("set", block))
    found = islands.runs(rows, F.lit(True), "__b", t, step).groupBy("__b", "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.max_by(t, F.struct("__z", -F.col(t))).alias("t_peak"), F.max("__z").alias("z"))
    parts = islands.merge_intervals(found, "__b", "t_start", "t_end", refractory + 1e-6).groupBy("__b", "group").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_peak", "t_end", "z"))).alias("e"))
    step_ = lambda acc, x: F.when((F.size(acc) == 0) | (x["t_start"] > F.element_at(acc, -1)["t_end"] + refractory), F.concat(acc, F.array(x))).otherwise(acc)
    kept = F.aggregate("e", F.filter("e", lambda x: F.lit(False)), step_)
    return parts.select("__b.*", F.explode(kept).alias("x")).select("set", block, "x.*")


def divergence_windows(df: DataFrame, events: DataFrame, block: str, t: str, braking: Column, sensor: Column, model: Column, gap: float, step: float, least: float, bucket: float) -> DataFrame:
    """(block, run, t_start, t_end, n, events): runs of braking in which |sensor| exceeds |model| by the gap, and how many events (block, t_start, t_end) overlap each."""
    runs = islands.intervals(df, braking & (F.abs(sensor) - F.abs(model) >= gap), block, t, step, 0.0, least)
    a = runs.select(block, "run", F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    b = events.select(block, F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    met = overlap_join(a, b, block, bucket).groupBy(block, "run").agg(F.count("*").alias("events"))
    return runs.join(met, [block, "run"], "left").select(block, "run", "t_start", "t_end", "n", F.coalesce("events", F.lit(0)).alias("events"))


def engagement_ratio(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys with the mean of the first of `columns` that df has; null if it has none."""
    found = next((c for c in columns if c in df.columns), None)
    return df.groupBy(*keys).agg((F.avg(found) if found else F.lit(None).cast("double")).alias("engaged"))


def linked_positives(events: DataFrame, key: str, within: float, bucket: float) -> DataFrame:
    """(key, a, b, gap): events (key, id, t_start, t_end) of one key at most `within` apart, each pair once; overlaps have a negative gap."""
    side = lambda n: events.select(key, F.col("id").alias(n), F.col("t_start").alias(f"{n}_start"), F.col("t_end").alias(f"{n}_end"))
    met = overlap_join(side("a"), side("b"), key, bucket, pad=within).filter("a < b")
    return met.select(key, "a", "b", (F.greatest("a_start", "b_start") - F.least("a_end", "b_end")).alias("gap"))


def target_flags(c: DataFrame, v_min: float, ax_limit: float, rate_limit: float, safety: list[str], forward: list[str]) -> DataFrame:
    """c with speed_ok, reaction, safety, forward and the targets t1 (speed and a reaction or safety system) and t2 (speed and a forward type). Columns that c lacks, and nulls, say no."""
    has = lambda n, test: F.coalesce(test(F.col(n)), F.lit(False)) if n in c.columns else F.lit(False)
    reaction = has("brake_max", lambda x: x > 0.5) | has("ax_min", lambda x: x < ax_limit) | has("gas_max", lambda x: x > 0) | has("steer_rate_absmax", lambda x: x > rate_limit)
    system = F.lit(False)
    for s in safety:
        system = system | has(s, lambda x: x > 0.5)
    ahead = F.exists(F.coalesce("event_types", F.array().cast("array<string>")), lambda x: x.isin(*forward))
    out = c.withColumns({"speed_ok": has("v_mean", lambda x: x >= v_min), "reaction": reaction, "safety": system, "forward": ahead})
    return out.withColumns({"t1": F.col("speed_ok") & (F.col("reaction") | F.col("safety")), "t2": F.col("speed_ok") & F.col("forward")})


def label_reactions(rows: DataFrame, labels: DataFrame, key: str, t: str, bucket: float, ax: str, ay: str, yaw: str, steer: str) -> DataFrame:
    """(id, ax_min, ax_max, ay_absmax, yaw_absmax, steer_range, steer_absmax) of the samples inside each label (key, id, t_start, t_end); nulls without any."""
    spans = labels.select(key, "id", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    big = lambda c: F.max(F.abs(c))
    g = points_in(rows.select(key, t, ax, ay, yaw, steer), spans, key, t, bucket).groupBy("id").agg(
        F.min(ax).alias("ax_min"), F.max(ax).alias("ax_max"), big(ay).alias("ay_absmax"), big(yaw).alias("yaw_absmax"), (F.max(steer) - F.min(steer)).alias("steer_range"), big(steer).alias("steer_absmax")
    )
    return labels.select("id").join(g, "id", "left")


def impulsive_response(rows: DataFrame, hits: DataFrame, key: str, t: str, heave: str, roll: str, window: float, core: float, near: tuple[float, float], rise_share: float, envelope: str, bucket: float) -> DataFrame:
    """(id, heave_peak, roll_peak, dt, concentration, rise): the heave peak near each hit (key, id, t_hit); the roll peak within `window` of it and how much later; the lesser share
    of heave's and roll's energy that lies within `core` of it; and how long before it the envelope was last at or below `rise_share` of its value there (window at most)."""
    spans = hits.select(key, "id", (F.col("t_hit") + near[0]).alias("b_start"), (F.col("t_hit") + near[1]).alias("b_end"))
    cols = list(dict.fromkeys([heave, roll, envelope]))
    x = rows.select(key, t, *cols)
    top = points_in(x, spans, key, t, bucket).filter(F.col(heave).isNotNull()).groupBy(key, "id").agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(envelope).alias("e")), F.struct(F.abs(heave), -F.col(t))).alias("p"), F.max(F.abs(heave)).alias("heave_peak"))
    wide = top.select(key, "id", "heave_peak", F.col("p.t").alias("__tp"), F.col("p.e").alias("__ep"), (F.col("p.t") - window).alias("b_start"), (F.col("p.t") + window).alias("b_end"))
    m = points_in(x, wide, key, t, bucket)
    inside = F.abs(F.col(t) - F.col("__tp")) <= core
    share = lambda c: F.try_divide(F.sum(F.when(inside, F.col(c) ** 2)), F.sum(F.col(c) ** 2))
    low = F.max(F.when((F.col(t) < F.col("__tp")) & (F.col(envelope) <= rise_share * F.col("__ep")), F.col(t)))
    g = m.groupBy("id", "heave_peak", "__tp").agg(F.max_by(t, F.struct(F.abs(roll), -F.col(t))).alias("__tr"), F.max(F.abs(roll)).alias("roll_peak"), F.least(share(heave), share(roll)).alias("concentration"), low.alias("__low"))
    return g.select("id", "heave_peak", "roll_peak", (F.col("__tr") - F.col("__tp")).alias("dt"), "concentration", F.coalesce(F.col("__tp") - F.col("__low"), F.lit(window)).alias("rise"))


def impulsive_score(features: DataFrame, wheel: str, wheel_min: float, no_wheel: float) -> DataFrame:
    """features with heave_pct, roll_pct and score: 100 times the geometric mean of both percent ranks, the concentration, and `no_wheel` where the wheel ratio stays below its limit."""
    out = percent_rank(percent_rank(features, "heave_peak", "heave_pct"), "roll_peak", "roll_pct")
    factor = F.when(F.col(wheel) >= wheel_min, 1.0).otherwise(no_wheel)
    return out.withColumn("score", 100 * F.sqrt(F.col("heave_pct") * F.col("roll_pct")) * clip(F.col("concentration")) * factor)


def flag_and_rank(sites: DataFrame, flags: dict[str, Column], voided: Column, void: list[str], ties: list[Column]) -> DataFrame:
    """sites with the flags, their number, and rank: most flags first, then `ties`. The flags in `void` do not count where `voided` holds."""
    off = F.coalesce(voided, F.lit(False))
    own = {f: F.coalesce(c, F.lit(False)) & (~off if f in void else F.lit(True)) for f, c in flags.items()}
    out = sites.withColumns(own).withColumn("n_flags", sum((F.col(f).cast("int") for f in flags), F.lit(0)))
    return numbered(out, [F.desc("n_flags"), *ties], "rank")


def mean_percent(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """df with the mean of the columns' percent ranks, times 100."""
    names = [f"__p{i}" for i in range(len(columns))]
    d = df
    for c, n in zip(columns, names, strict=True):
        d = percent_rank(d, c, n)
    return d.withColumn(out, 100 * sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)


def wind_score(polarity: Column, parts: list[tuple[Column, float]], turning: Column, others: Column, share: Column, wind: Column, cap: float = 6.0, enough: int = 5, full: float = 8.0) -> Column:
    """Behaviour times uniqueness times wind. Behaviour adds the scores whose sign is the polarity, capped, halved while turning; uniqueness is what share of enough
    other drives does less there, else a half; wind is its share of `full` from the polarity's side."""
    behaviour = sum((F.when(F.signum(z) == polarity, w * F.least(F.abs(z), F.lit(cap))).otherwise(0.0) for z, w in parts), F.lit(0.0))
    behaviour = behaviour * F.when(F.coalesce(turning, F.lit(False)), 0.5).otherwise(1.0)
    unique = F.when(others >= enough, 1.0 - F.coalesce(share, F.lit(0.5))).otherwise(0.5)
    return behaviour * unique * known(clip(polarity * wind / full))


def corrective_steer(rows: DataFrame, candidates: DataFrame, key: str, t: str, steer: str, before: tuple[float, float], after: tuple[float, float], bucket: float) -> DataFrame:
    """(id, steer_back): the greatest steer to the polarity's side after each candidate (key, id, t_peak, polarity), over the median before it."""
    spans = candidates.select(key, "id", "t_peak", "polarity", (F.col("t_peak") + before[0]).alias("b_start"), (F.col("t_peak") + after[1]).alias("b_end"))
    d = F.col(t) - F.col("t_peak")
    m = points_in(rows.select(key, t, steer), spans, key, t, bucket).withColumns({"__pre": F.when((d >= before[0]) & (d <= before[1]), F.col(steer)), "__post": F.when((d >= after[0]) & (d <= after[1]), F.col("polarity") * F.col(steer))})
    return m.groupBy("id", "polarity").agg(F.percentile("__pre", 0.5).alias("pre"), F.max("__post").alias("post")).select("id", (F.col("post") - F.col("polarity") * F.col("pre")).alias("steer_back"))


def cold_tier(country: Column, region: Column, altitude: Column, latitude: Column, heavy: dict, moderate: dict) -> tuple[Column, Column]:
    """(tier, reasons): heavy if any heavy test holds, else moderate if any of its tests does, else low; the tests that led there. heavy and moderate: countries, regions, altitude, latitude."""

    def tests(c: dict) -> Column:
        return F.array_compact(
            F.array(
                F.when(country.isin(*c["countries"]), F.concat(F.lit("country="), country)),
                F.when(region.isin(*c["regions"]), F.concat(F.lit("region="), region)),
                F.when(altitude >= c["altitude"], F.concat(F.lit("altitude="), F.round(altitude).cast("long").cast("string"))),
                F.when(F.abs(latitude) >= c["latitude"], F.concat(F.lit("latitude="), F.round(F.abs(latitude)).cast("long").cast("string"))),
            )
        )

    a, b = tests(heavy), tests(moderate)
    tier = F.when(F.size(a) > 0, "heavy").when(F.size(b) > 0, "moderate").otherwise("low")
    return tier, F.array_join(F.when(F.size(a) > 0, a).otherwise(b), "+")


def appearance_scores(side_white: Column, colour: Column, blue: Column, contrast: Column, saturation: Column, brightness: Column) -> dict[str, Column]:
    """Snow, gloom, wet and clear scores of a picture from 0 to 1, and whether it is dark; for ranking, not for limits."""
    lack = lambda c, full: clip(1.0 - c / full)
    return {
        "snow": side_white * lack(colour, 0.12),
        "gloom": (lack(colour, 0.20) + lack(blue, 0.10) + lack(contrast, 0.20)) / 3.0,
        "wet": lack(saturation, 0.15) * clip((brightness - 0.28) / 0.15),
        "clear": clip(colour / 0.15) * clip(blue / 0.25) * clip(contrast / 0.20),
        "dark": brightness < 0.25,
    }


def required_wind(lateral: Column, v: Column, mass: float, density: float, area: float, side_force: tuple[float, float], height: tuple[float, float]) -> tuple[Column, Column]:
    """The least and greatest side wind at 10 m that explain a lateral acceleration at a speed, over the ranges of side-force slope and height factor."""
    need = lambda slope, factor: 2 * mass * F.abs(lateral) / (density * area * slope * v) / factor
    return need(side_force[1], height[1]), need(side_force[0], height[0])


def judge_sustained(wind: Column, spread: Column, bank: Column, least: Column, explains: tuple[float, float], small: float, weak: float) -> tuple[Column, Column]:
    """(verdict, reasons). refute: the bank explains it, or the wind blows the other way, or its upper bound is a `weak` share of what is needed at least;
    support: the right way, the upper bound reaches the need, and the bank is small; else unknown."""
    high = wind + spread
    against = F.array_compact(F.array(F.when(bank.between(*explains), "bank"), F.when(high < 0, "opposite"), F.when(high < weak * least, "weak")))
    supports = F.coalesce((wind > 0) & (high >= least) & (F.abs(bank) < small), F.lit(False))
    verdict = F.when(wind.isNull(), "unknown").when(F.size(against) > 0, "refute").when(supports, "support").otherwise("unknown")
    return verdict, F.when(wind.isNotNull(), F.array_join(against, "+")).otherwise("no wind")


def judge_gust(gust: Column, needed: float) -> Column:
    """refute where the greatest gust near by stays below what could be seen, else unknown."""
    return F.when(gust < needed, "refute").otherwise("unknown")
