"""Candidates: events merged into intervals to review, scored, described and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators.islands import merge_intervals
from drivespan.operators.stats import numbered
from drivespan.operators.joins import overlap_join, points_in

#: Padding, merge gap, cap and bonus of the scoring.
SCORING = {"window_pad_s": 2.0, "merge_gap_s": 2.0, "max_severity_per_event": 3.0, "cooccurrence_bonus": 0.5}


def event_severity(cap: float | None) -> Column:
    """weight * min(1 + exceedance / |threshold|, cap); a threshold of 0 scales by 1."""
    scale = F.when(F.col("threshold") != 0, F.abs("threshold")).otherwise(1.0)
    raw = 1.0 + F.greatest(F.col("exceedance"), F.lit(0.0)) / scale
    return F.col("weight") * (F.least(raw, F.lit(float(cap))) if cap is not None else raw)


def grouped(events: DataFrame, block: str, cfg: dict = SCORING) -> DataFrame:
    """events with `group`, `p_start` and `p_end`: padded events share a group while each starts at most merge_gap_s after the latest end."""
    padded = events.withColumns({"p_start": F.col("t_start") - cfg["window_pad_s"], "p_end": F.col("t_end") + cfg["window_pad_s"]})
    return merge_intervals(padded, block, "p_start", "p_end", cfg["merge_gap_s"])


def build(events: DataFrame, spans: DataFrame, block: str, cfg: dict = SCORING) -> DataFrame:
    """Candidates: t_start and t_end clipped to the block's span (block, t0, t1), severity, n_events, sorted event_types and t_peak.

    Of several events of a type only the strongest counts; every type after the first adds the bonus. t_peak is the middle of the strongest event,
    uncapped, the earliest of equals.
    """
    g = grouped(events, block, cfg).withColumns({"sev": event_severity(cfg["max_severity_per_event"]), "raw": event_severity(None)})
    per_type = g.groupBy(block, "group", "event_type").agg(F.max("sev").alias("sev"), F.count("*").alias("n"), F.min("p_start").alias("s"), F.max("p_end").alias("e"), F.max(F.struct(F.col("raw"), (-F.col("t_start")).alias("neg"), ((F.col("t_start") + F.col("t_end")) / 2).alias("mid"))).alias("best"))
    out = per_type.groupBy(block, "group").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), (F.sum("sev") + cfg["cooccurrence_bonus"] * (F.count("*") - 1)).alias("severity"), F.sum("n").alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("event_types"), F.max("best").alias("best")
    )
    return out.join(spans, block).select(block, "group", F.greatest("s", "t0").alias("t_start"), F.least("e", "t1").alias("t_end"), "severity", "n_events", "event_types", F.col("best.mid").alias("t_peak"))


def context(candidates: DataFrame, rows: DataFrame, block: str, t: str, wanted: list[tuple[str, str]], bucket: float = 60.0) -> DataFrame:
    """(block, group, column_how ...): mean, min, max or signed absmax of columns over each candidate's interval, ends included; columns that rows lacks are left out."""
    wanted = [(c, h) for c, h in wanted if c in rows.columns]
    spans = candidates.select(block, "group", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    met = points_in(rows.select(block, t, *dict.fromkeys(c for c, _ in wanted)), spans, block, t, bucket)
    # a mean's sum runs in the order of time: it is the same, to the last bit, on every run
    order = Window.partitionBy(block, "group").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumns({f"__sum_{c}": F.sum(c).over(order) for c, h in wanted if h == "mean"})
    how = {"mean": lambda c: F.try_divide(F.max_by(f"__sum_{c}", t), F.count(c)), "min": F.min, "max": F.max, "absmax": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)), -F.col(t))))}
    return met.groupBy(block, "group").agg(*(how[h](c).alias(f"{c}_{h}") for c, h in wanted))


def priority(cands: DataFrame, urgent: list[str], low_alone: list[str]) -> DataFrame:
    """cands with tier (0 urgent, 1 several types, 2 one type, 3 only types that mean little alone) and pairs, the labels of its type pairs."""
    types = F.col("event_types")
    tier = F.when(F.arrays_overlap(types, F.lit(urgent)), 0).when(F.size(F.array_except(types, F.lit(low_alone))) == 0, 3).when(F.size(types) > 1, 1).otherwise(2)
    pairs = F.flatten(F.transform(types, lambda a, i: F.transform(F.slice(types, i + 2, F.greatest(F.size(types) - i - 1, F.lit(0))), lambda b: F.concat_ws("+", a, b))))
    return cands.withColumn("tier", tier).withColumn("pairs", pairs)


def pair_counts(events: DataFrame, block: str, window_s: float, bucket: float = 60.0) -> DataFrame:
    """(a, b, n): how many events of type a have any event of another type b of the same block within +-window_s."""
    a = events.select(block, F.col("event_type").alias("a"), F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    b = events.select(block, F.col("event_type").alias("b"), F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    met = overlap_join(a, b, block, bucket, pad=window_s).filter("a <> b").select(block, "a", "a_start", "a_end", "b").distinct()
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


def apply_rules(df: DataFrame, always: list[str], rules: list[dict], require_types: list[str] | None = None) -> DataFrame:
    """df with keep and reasons. always: flag columns that keep a row; rules: name with all_of and any_of conditions; with require_types, rules count only for rows that hold one of them. Null satisfies nothing."""
    from drivespan.operators.rules import condition

    hits = [F.when(condition(F.col(f), "gt", 0.5), F.lit(f)) for f in always if f in df.columns]
    typed = F.arrays_overlap("event_types", F.lit(require_types)) if require_types else F.lit(True)
    for r in rules:
        test = F.lit(True)
        for c in r.get("all_of", []):
            test = test & (condition(F.col(c["feature"]), c["op"], c["threshold"]) if c["feature"] in df.columns else F.lit(False))
        some = [condition(F.col(c["feature"]), c["op"], c["threshold"]) for c in r.get("any_of", []) if c["feature"] in df.columns]
        if r.get("any_of"):
            any_ = F.lit(False)
            for s in some:
                any_ = any_ | s
            test = test & any_
        hits.append(F.when(test & typed, F.lit(r["name"])))
    reasons = F.array_compact(F.array(*hits))
    return df.withColumn("reasons", F.array_join(reasons, "|")).withColumn("keep", F.size(reasons) > 0)


def rule_search(df: DataFrame, parts: dict[str, Column], positive: Column, most: int = 3) -> DataFrame:
    """(rule, n, hits, precision, recall) of every conjunction of up to `most` parts: rows become bit masks, equal masks are counted once, and only these counts meet the conjunctions."""
    import itertools

    names = list(parts)
    code = sum((F.coalesce(parts[n], F.lit(False)).cast("long") * F.lit(1 << i) for i, n in enumerate(names)), F.lit(0).cast("long"))
    counts = df.select(code.alias("code"), positive.cast("int").alias("y")).groupBy("code").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    combos = [(" & ".join(c), sum(1 << names.index(x) for x in c)) for k in range(1, most + 1) for c in itertools.combinations(names, k)]
    table = df.sparkSession.createDataFrame(combos, "rule string, mask long")
    met = counts.join(F.broadcast(table), F.col("code").bitwiseAND(F.col("mask")) == F.col("mask"))
    total = counts.agg(F.sum("y").alias("all_y"))
    out = met.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("y").alias("hits")).join(F.broadcast(total), F.lit(True))
    return out.select("rule", "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.col("all_y")).alias("recall"))


def top_per_case(df: DataFrame, cases: dict[str, Column], k: int, order: list[Column]) -> DataFrame:
    """(case, ..., rank): the first k rows of each case, a case being any boolean expression over df."""
    tagged = df.withColumn("case", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases.items())))))
    return tagged.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(*order))).filter(F.col("rank") <= k)


def focus_points(events: DataFrame, candidates: DataFrame, block: str, bucket: float = 60.0) -> DataFrame:
    """(block, group, focus, focus_type): the middle of the candidate's event whose type is rarest over all events, the earliest of equals."""
    rarity = events.groupBy("event_type").agg(F.count("*").alias("rarity"))
    a = candidates.select(block, "group", F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    b = events.join(F.broadcast(rarity), "event_type").select(block, "event_type", "rarity", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    met = overlap_join(a, b, block, bucket)
    key = F.struct("rarity", "b_start", "event_type")
    return met.groupBy(block, "group").agg(F.min_by((F.col("b_start") + F.col("b_end")) / 2, key).alias("focus"), F.min_by("event_type", key).alias("focus_type"))


def review_sheet(candidates: DataFrame, block: str, segment_s: float) -> DataFrame:
    """The candidates by falling severity, with rank, blank verdict columns, and whether one reaches over a segment's end.

    The rank is a place in ranges of the order, plus what stands in the ranges before.
    """
    crosses = F.floor(F.col("t_start") / segment_s) != F.floor(F.col("t_end") / segment_s)
    return numbered(candidates, [F.desc("severity"), F.asc(block), F.asc("t_start")], "rank").select("rank", block, "t_start", "t_end", "severity", F.array_join("event_types", "|").alias("event_types"), crosses.alias("crosses_segment"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("note"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys with n_a, n_b and delta of two runs' rows."""
    x = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    y = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return x.join(y, keys, "full").select(*keys, zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), (zero("n_b") - zero("n_a")).alias("delta"))


def round_robin(df: DataFrame, kind: str, groups: list[str], n: int, order: list[Column]) -> DataFrame:
    """n rows of each kind, taken in turn from its groups, the best of each first."""
    own = df.withColumn("turn", F.row_number().over(Window.partitionBy(kind, *groups).orderBy(*order)))
    return own.withColumn("pick", F.row_number().over(Window.partitionBy(kind).orderBy("turn", *groups))).filter(F.col("pick") <= n)


def funnel(df: DataFrame, stages: dict[str, Column], positive: Column) -> DataFrame:
    """(stage, n, hours, positives): rows that pass all stages up to each; a stage that no row passes has 0 and nulls."""
    held, sums, rows = F.lit(True), [], []
    for i, (name, c) in enumerate(stages.items()):
        held = held & F.coalesce(c, F.lit(False))
        sums += [F.count(F.when(held, 1)).alias(f"n{i}"), (F.sum(F.when(held, F.col("t_end") - F.col("t_start"))) / 3600).alias(f"h{i}"), F.sum(F.when(held, positive.cast("int"))).alias(f"p{i}")]
        rows.append(F.struct(F.lit(name).alias("stage"), F.col(f"n{i}").alias("n"), F.col(f"h{i}").alias("hours"), F.col(f"p{i}").alias("positives")))
    return df.agg(*sums).select(F.inline(F.array(*rows)))
