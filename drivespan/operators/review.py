"""Review sets and their scoring: episodes, evaluation timelines, causal context, answer checks, alarms, sheet import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.operators.joins import asof, overlap_join


def episodes(labels: DataFrame, drive: str, start: str) -> DataFrame:
    """labels with known risky and event_id: P01.. for risky and N01.. for others, by drive and start. The list is what people have labelled, so one window numbers it."""
    w = Window.partitionBy("risky").orderBy(drive, start)
    n = F.row_number().over(w).cast("string")
    return labels.filter("risky is not null").withColumn("event_id", F.concat(F.when(F.col("risky"), "P").otherwise("N"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def timeline(eps: DataFrame, pre: float, post: float, stride: float) -> DataFrame:
    """A row for every stride seconds from t_start - pre to t_end + post."""
    n = F.floor((F.col("t_end") + post - (F.col("t_start") - pre)) / stride + 1e-9)
    return eps.select("*", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.col("t_start") - pre + i * stride)).alias("k", "t_eval"))


def to_segment(t: Column, length: float, fps: float) -> tuple[Column, Column, Column]:
    """Segment, second in it, and frame of a time counted from the drive's start; a frame rounded up to the segment's end belongs to the next one."""
    frames = round(length * fps)
    f = F.round(t * fps).cast("long")
    return F.floor(f / frames).cast("long"), F.pmod(f, F.lit(frames)) / fps, F.pmod(f, F.lit(frames))


def backward_times(t: Column, n: int, spacing: float, guard: float = 0.0) -> Column:
    """n times that end at t - guard, spacing apart, in order."""
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: t - guard - i * spacing)


def available_frames(evals: DataFrame, frames: DataFrame, key: str, times: str) -> DataFrame:
    """(event_id, k, needed, available, missing) of each evaluation's frames against a listing (key, frame_t)."""
    want = evals.select("event_id", "k", key, F.explode(times).alias("frame_t"))
    met = want.join(frames.select(key, "frame_t", F.lit(1).alias("have")).distinct(), [key, "frame_t"], "left")
    return met.groupBy("event_id", "k").agg(F.count("*").alias("needed"), F.count("have").alias("available"), (F.count("*") - F.count("have")).alias("missing"))


def causal_context(evals: DataFrame, rows: DataFrame, key: str, t: str, columns: dict[str, float], guard: float) -> DataFrame:
    """evals (key, t_eval) with the latest value of each column at or before t_eval - guard - its look-ahead, and source_t, the latest time used, as proof that nothing of the future was seen."""
    out = evals
    for c, ahead in columns.items():
        shifted = out.withColumn(t, F.col("t_eval") - guard - ahead)
        out = asof(shifted, rows.filter(F.col(c).isNotNull()), key, t, c, out=f"ctx_{c}").drop(t)
    latest = F.greatest(*(F.col(f"ctx_{c}_t") for c in columns)) if len(columns) > 1 else F.col(f"ctx_{next(iter(columns))}_t")
    return out.withColumn("source_t", latest)


def rendered(columns: dict[str, int]) -> Column:
    """name=value pairs with fixed digits, - for nulls."""
    parts = [F.concat(F.lit(f"{c}="), F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f"%.{d}f", F.col(c)))) for c, d in columns.items()]
    return F.concat_ws(" ", *parts)


def thinned(frames: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """At most `limit` evenly spaced rows of each key, the last always among them."""
    w = Window.partitionBy(*keys)
    r = frames.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(w))
    slot = F.floor((F.col("__n") - F.col("__i")) * limit / F.col("__n"))
    r = r.withColumn("__s", slot).withColumn("__f", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(F.desc(order))))
    return r.filter((F.col("__n") <= limit) | (F.col("__f") == 1)).drop("__i", "__n", "__s", "__f")


def answer_errors(answer: Column, required: dict[str, str], enums: dict[str, list[str]], bounds: dict[str, tuple[float, float]]) -> Column:
    """An array of what is wrong with a JSON answer: not an object, missing, unknown, wrong type, outside an enumeration or bounds."""
    keys = F.json_object_keys(answer)
    value = {k: F.get_json_object(answer, f"$.{k}") for k in required}
    checks = [F.when(keys.isNull(), F.lit("not_an_object"))]
    for k, kind in required.items():
        here = F.array_contains(keys, k)
        checks.append(F.when(~here, F.lit(f"missing:{k}")))
        if kind == "number":
            checks.append(F.when(here & value[k].try_cast("double").isNull(), F.lit(f"type:{k}")))
        if kind == "boolean":
            checks.append(F.when(here & ~F.coalesce(value[k].isin("true", "false"), F.lit(False)), F.lit(f"type:{k}")))
    checks.append(F.when(F.size(F.array_except(keys, F.lit(list(required)))) > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort(F.array_except(keys, F.lit(list(required)))), ","))))
    for k, allowed in enums.items():
        checks.append(F.when(value[k].isNotNull() & ~value[k].isin(allowed), F.lit(f"enum:{k}")))
    for k, (lo, hi) in bounds.items():
        x = value[k].try_cast("double")
        checks.append(F.when((x < lo) | (x > hi), F.lit(f"bounds:{k}")))
    return F.array_compact(F.array(*checks))


def alarm_runs(states: DataFrame, key: str, order: str, alarm: Column, debounce: int) -> DataFrame:
    """(key, run, first, confirmed, last, n): runs of at least `debounce` consecutive alarm states; confirmed is where the run reached that length."""
    w = Window.partitionBy(key).orderBy(order)
    s = states.withColumn("__a", F.coalesce(alarm, F.lit(False))).withColumn("__new", (F.col("__a") & ~F.coalesce(F.lag("__a").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("__new").over(w)).filter("__a")
    s = s.withColumn("__i", F.row_number().over(Window.partitionBy(key, "run").orderBy(order)))
    return s.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(F.when(F.col("__i") == debounce, F.col(order))).alias("confirmed"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= debounce)


def clip_scores(answers: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """keys with the confusion counts, accuracy and Cohen's kappa."""
    from drivespan.functions.vehicle import cohen_kappa

    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    g = answers.groupBy(*keys).agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn"))
    c = F.col
    total = c("tp") + c("fp") + c("fn") + c("tn")
    return g.select(*keys, "tp", "fp", "fn", "tn", ((c("tp") + c("tn")) / F.nullif(total, F.lit(0))).alias("accuracy"), cohen_kappa(c("tp"), c("fp"), c("fn"), c("tn")).alias("kappa"))


def detection_delay(first_alarms: DataFrame, onsets: DataFrame, key: str) -> DataFrame:
    """(key, onset, first, delay): first alarm less human onset; without an alarm the delay is null."""
    return onsets.join(first_alarms, key, "left").select(key, "onset", "first", (F.col("first") - F.col("onset")).alias("delay"))


def controls_away(times: DataFrame, events: DataFrame, key: str, margin: float, bucket: float, n: int, seed: int) -> DataFrame:
    """Up to n times of each key that are at least margin from every event (key, b_start, b_end), picked by hash."""
    points = times.withColumns({"a_start": F.col("t"), "a_end": F.col("t")})
    free = overlap_join(points, events, key, bucket, "left_anti", pad=margin).drop("a_start", "a_end")
    return free.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy(draw(seed, F.col(key), F.round(F.col("t") * 1e6).cast("long")), "t"))).filter(F.col("pick") <= n)


VERDICTS = {"yes": True, "risky": True, "no": False, "fine": False, "unclear": None}


def import_sheet(sheet: DataFrame, labels: DataFrame, key: str, bucket: float) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a sheet (key, id, a_start, a_end, verdict): unknown words are rejected, undecided rows dropped, and rows that overlap a label (key, b_start, b_end) are never taken again."""
    table = sheet.sparkSession.createDataFrame(list(VERDICTS.items()), "verdict string, risky boolean")
    norm = sheet.withColumn("verdict", F.lower(F.trim("verdict")))
    rejected = norm.join(F.broadcast(table), "verdict", "left_anti")
    known = norm.join(F.broadcast(table), "verdict").filter("risky is not null")
    return overlap_join(known, labels, key, bucket, "left_anti"), rejected
