"""The derived feature table: longitudinal, lateral, lobes, lead vehicle and wheels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions import vehicle as vf
from drivespan.operators import timegrid as tg
from drivespan.operators.islands import lobes
from drivespan.operators.joins import points_in

WHEELS = ("ws_fl", "ws_fr", "ws_rl", "ws_rr")


def basic(df: DataFrame, block: str, order: str, dt: float, jerk_window: int = 9, wheelbase: float = 2.65, ratio: float = 15.0, understeer: float = 0.0025, l_r: float = 1.4, k: float = 0.003) -> DataFrame:
    """df with jerk, its windowed extremes, kinematic lateral acceleration and jerk, steering rate, model yaw rate and residual, model sideslip, friction demand and counter-steering.

    Columns whose inputs df lacks are left out, so the caller can branch on df.columns. Stages are chained on one partitioning by block.
    """
    has = set(df.columns)
    c = F.col
    if "ax_mps2" in has:
        df = df.withColumn("jerk_mps3", tg.derivative(c("ax_mps2"), block, order, dt))
        df = df.withColumns({"jerk_win_min": tg.rolling(c("jerk_mps3"), block, order, jerk_window, "min"), "jerk_win_mean": tg.rolling(c("jerk_mps3"), block, order, jerk_window, "mean")})
    if {"v_mps", "yaw_dps"} <= has:
        df = df.withColumn("ay_kin_mps2", c("v_mps") * F.radians("yaw_dps"))
        df = df.withColumn("lat_jerk_mps3", tg.derivative(c("ay_kin_mps2"), block, order, dt))
        df = df.withColumn("lat_jerk_win_absmax", tg.rolling(c("lat_jerk_mps3"), block, order, jerk_window, "absmax"))
        if "ay_mps2" in has:
            df = df.withColumn("ay_residual_mps2", c("ay_mps2") - c("ay_kin_mps2")).withColumn("beta_model_deg", vf.sideslip_model(c("v_mps"), c("yaw_dps"), c("ay_mps2"), l_r, k))
            df = df.withColumn("beta_sigma", c("beta_model_deg") / vf.sideslip_noise(c("v_mps"), 0.3, 0.15, l_r, k)).withColumn("beta_rate_dps", tg.derivative(c("beta_model_deg"), block, order, dt))
    if "steer_deg" in has:
        df = df.withColumn("steer_rate_dps", tg.derivative(c("steer_deg"), block, order, dt))
        if {"v_mps", "yaw_dps"} <= has:
            df = df.withColumn("yaw_expected_dps", vf.bicycle_yaw_rate(c("v_mps"), c("steer_deg"), wheelbase, ratio, understeer)).withColumn("yaw_residual_dps", c("yaw_dps") - c("yaw_expected_dps"))
            df = df.withColumn("counter_steer", vf.counter_steer(c("yaw_dps"), c("steer_rate_dps"), 5.0, 60.0))
            if "beta_model_deg" in df.columns:
                df = df.withColumn("beta_excess_deg", c("beta_model_deg") - vf.sideslip_expected(c("v_mps"), c("yaw_expected_dps"), l_r, k))
    if {"ax_mps2", "ay_mps2"} <= has:
        df = df.withColumn("friction_demand", vf.friction_demand(c("ax_mps2"), c("ay_mps2")))
    return df


def lead_features(df: DataFrame, block: str, order: str, dt: float, v_min: float = 1.0) -> DataFrame:
    """df with lead speed difference, headway, time to collision, headway rate and whether the gap to the same lead closes fast."""
    w = tg.by(block, order)
    same = (F.col("lead_id") == F.lag("lead_id").over(w)) & (F.col("lead_id") == F.lead("lead_id").over(w))
    df = df.withColumn("lead_vrel_mps", F.when(same, tg.derivative(F.col("lead_m"), block, order, dt)))
    df = df.withColumns({"thw_s": vf.time_headway(F.col("lead_m"), F.col("v_mps"), v_min), "ttc_s": vf.time_to_collision(F.col("lead_m"), F.col("lead_vrel_mps"), 0.5)})
    df = df.withColumn("thw_rate_s_per_s", F.when(same, tg.derivative(F.col("thw_s"), block, order, dt)))
    return df.withColumn("closing_fast", F.coalesce(F.col("thw_rate_s_per_s") <= -0.4, F.lit(False)).cast("double"))


def lead_from_tracks(tracks: DataFrame, block: str, t: str, half_width: float = 1.8, v_min: float = 5.0, moving: float = 3.0) -> DataFrame:
    """The nearest moving track inside the path that the car's yaw bends, one a (block, t). tracks: distance, lateral, rel_speed, track_id and the car's v and yaw beside them; an unknown own speed is 0 and so fails the moving test."""
    v = F.coalesce("v", F.lit(0.0))
    inside = F.abs(F.col("lateral") - vf.path_offset(F.col("distance"), F.col("v"), F.col("yaw"), v_min)) <= half_width
    kept = tracks.filter(inside & (v + F.col("rel_speed") >= moving))
    near = F.min_by(F.struct("distance", "rel_speed", "track_id"), F.struct("distance", "track_id"))
    return kept.groupBy(block, t).agg(near.alias("n")).select(block, t, F.col("n.distance").alias("lead_m"), F.col("n.rel_speed").alias("lead_vrel_mps"), F.col("n.track_id").alias("lead_id"))


def panic_brake(df: DataFrame, block: str, order: str, lookback: int, accel: float = 0.3, brake: float = -3.0) -> Column:
    """1.0 where braking is at or below `brake` and acceleration was above `accel` in the 2 * lookback + 1 rows that end here (the centred window shifted back keeps its width)."""
    had = F.max("ax_mps2").over(tg.by(block, order).rowsBetween(-2 * lookback, 0)) > accel
    return F.coalesce(had & (F.col("ax_mps2") <= brake), F.lit(False)).cast("double")


def pedal_panic_brakes(df: DataFrame, block: str, order: str, press_rows: int, react_rows: int, least_gas: float = 10.0, released: float = 2.0, brake: float = -2.0, rise: float = 0.2, out: str = "panic_brake_pedal") -> DataFrame:
    """df with 1.0 on the react_rows after a release of the pedal that is followed by deceleration and a rise of the brake."""
    w = tg.by(block, order)
    free = F.coalesce((F.col("gas_pct") < released) & (tg.rolling(F.col("gas_pct"), block, order, press_rows, "max") >= least_gas), F.lit(False))
    df = df.withColumn("__free", free)
    edge = F.col("__free") & ~F.coalesce(F.lag("__free").over(w), F.lit(False))
    ahead = w.rowsBetween(0, react_rows)
    hit = edge & (F.min("ax_mps2").over(ahead) <= brake) & (F.max("brake_level").over(ahead) - F.col("brake_level") >= rise) & F.lead(F.lit(1)).over(w).isNotNull()
    df = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return df.withColumn(out, F.coalesce(F.bool_or("__hit").over(w.rowsBetween(-react_rows, 0)), F.lit(False)).cast("double")).drop("__free", "__hit")


def cut_ins(df: DataFrame, block: str, order: str, t: str, persist: int, dt: float, least_jump: float = 3.0, least_drop: float = 5.0, most_appear: float = 40.0, v_min: float = 5.0, most_thw: float = 1.5, window_s: float = 2.0) -> DataFrame:
    """(block, t, before_m, after_m, thw_after): nearer leads that appear or take over, with medians over `persist` rows on either side; one within window_s of a counted one is the same cut-in."""
    w = tg.by(block, order)
    valid, before = F.col("lead_m").isNotNull(), F.lag("lead_m").over(w)
    ids = F.coalesce("lead_id", F.lit(-1))
    appeared = valid & before.isNull() & F.lag(F.lit(1)).over(w).isNotNull()
    swapped = valid & (ids != F.lag(ids).over(w)) & (F.col("lead_m") - before <= -least_jump)
    after, back = w.rowsBetween(0, persist - 1), w.rowsBetween(-persist, -1)
    med = lambda c, f: F.percentile(c, 0.5).over(f)
    rows = df.select(block, F.col(t).alias("t"), appeared.alias("appeared"), F.coalesce(swapped, F.lit(False)).alias("swapped"), med("lead_m", after).alias("after_m"), med("thw_s", after).alias("thw_after"), F.avg("v_mps").over(after).alias("speed"), med("lead_m", back).alias("before_m"), F.count(F.lit(1)).over(after).alias("n"))
    hit = rows.filter("(appeared or swapped)").filter(((F.col("n") - 1) * dt >= persist * dt * 0.8) & (F.col("speed") >= v_min) & (F.col("thw_after") <= most_thw))
    near = F.when(F.col("before_m").isNotNull() & ~F.col("appeared"), F.col("before_m") - F.col("after_m") >= least_drop).otherwise(F.col("after_m") <= most_appear)
    hit = hit.filter(near)
    # counted ones hold off later ones for window_s: a fold over the block's hits, cut where they are further apart
    order_t = Window.partitionBy(block).orderBy("t")
    hit = hit.withColumn("__new", F.when(F.col("t") - F.lag("t").over(order_t) >= window_s, 1).otherwise(0)).withColumn("__part", F.sum("__new").over(order_t))
    kept = F.aggregate(F.array_sort(F.collect_list("t")), F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= window_s), F.concat(acc, F.array(x))).otherwise(acc))
    first = hit.groupBy(block, "__part").agg(kept.alias("k")).select(block, F.explode("k").alias("t"))
    return hit.join(first, [block, "t"], "left_semi").select(block, "t", "before_m", "after_m", "thw_after")


def wheel_features(df: DataFrame, block: str, order: str, dt: float, track_width: float = 1.6, smooth: int = 5) -> DataFrame:
    """df with the spread of four wheel speeds raw and smoothed, the deepest single-wheel deceleration, and the spread's excess over what turning explains and over the block's median."""
    spread = F.greatest(*WHEELS) - F.least(*WHEELS)
    df = df.withColumn("ws_spread_mps", spread)
    df = df.withColumns({"ws_spread_smooth_mps": tg.moving_average(F.col("ws_spread_mps"), block, order, smooth), "wheel_decel_mps2": F.least(*(tg.derivative(F.col(c), block, order, dt) for c in WHEELS))})
    df = df.withColumn("__excess", F.col("ws_spread_mps") - F.abs(F.radians("yaw_dps")) * track_width)
    return df.withColumn("ws_spread_excess_mps", F.col("__excess") - F.coalesce(F.percentile("__excess", 0.5).over(Window.partitionBy(block)), F.lit(0.0))).drop("__excess")


def wheel_anomaly(block: str, order: str, rows: int, excess: float, v_min: float, ax: float, flag: str | None = None) -> Column:
    """1.0 where the excess spread is backed within +-rows by braking, or by the flag."""
    support = F.coalesce(F.abs("ax_mps2") > ax, F.lit(False))
    if flag:
        support = support | F.coalesce(F.col(flag) > 0.5, F.lit(False))
    over = F.coalesce((F.col("ws_spread_excess_mps") > excess) & (F.col("v_mps") > v_min), F.lit(False))
    return (over & tg.dilate(support, block, order, rows)).cast("double")


def yaw_deviation(df: DataFrame, block: str, order: str, window: int) -> DataFrame:
    """df with yaw_dev: the yaw rate less its running median, which keeps the steps of curves."""
    return df.withColumn("yaw_dev", F.col("yaw_dps") - tg.rolling(F.col("yaw_dps"), block, order, window, "median"))


def lane_changes(df: DataFrame, block: str, t: str, dt: float, enter: float = 2.0, gap: float = 0.2, pair_gap: float = 0.5, least_heading: float = 0.3, durations: tuple[float, float] = (0.4, 3.0), most_net: float = 2.0, v_min: float = 3.0, offsets: tuple[float, float] = (0.02, 6.0), bucket: float = 10.0) -> DataFrame:
    """(block, t_start, t_end, heading, net, offset_m): neighbouring lobes of opposite sign whose heading returns and whose lateral offset is that of a lane."""
    l = lobes(df, "yaw_dev", block, t, enter, gap)
    w = Window.partitionBy(block).orderBy("lobe")
    nxt = lambda c: F.lead(c).over(w)
    pairs = l.select(block, "lobe", "t_start", F.col("area").alias("a"), F.col("t_end").alias("mid"), nxt("t_start").alias("s2"), nxt("t_end").alias("t_end"), nxt("area").alias("b"))
    dur = F.col("t_end") - F.col("t_start")
    pairs = pairs.filter((F.signum("a") != F.signum("b")) & (F.col("s2") - F.col("mid") <= pair_gap) & (F.least(F.abs("a"), F.abs("b")) >= least_heading) & dur.between(*durations) & (F.abs(F.col("a") + F.col("b")) <= most_net))
    spans = pairs.select(block, "lobe", "t_start", "t_end", "a", "b", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    rows = points_in(df.select(block, F.col(t).alias("t"), "v_mps", "yaw_dev"), spans, block, "t", bucket)
    run = Window.partitionBy(block, "lobe").orderBy("t")
    psi = F.coalesce(F.sum(F.radians(F.coalesce("yaw_dev", F.lit(0.0))) * dt).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("side", F.coalesce("v_mps", F.lit(0.0)) * F.sin(psi))
    rows = rows.withColumn("step", F.coalesce((F.col("side") + F.lag("side").over(run)) / 2 * dt, F.lit(0.0)))
    out = rows.groupBy(block, "lobe", "t_start", "t_end", "a", "b").agg(F.sum("step").alias("offset_m"), F.avg("v_mps").alias("speed"))
    out = out.filter((F.col("speed") >= v_min) & F.abs("offset_m").between(*offsets))
    return out.select(block, "t_start", "t_end", ((F.abs("a") + F.abs("b")) / 2).alias("heading"), (F.col("a") + F.col("b")).alias("net"), "offset_m")


def chains(l: DataFrame, block: str, gap: float) -> DataFrame:
    """Lobes with `chain`: neighbours of opposite sign at most gap apart share one."""
    w = Window.partitionBy(block).orderBy("t_start")
    new = F.when((F.col("sign") != F.lag("sign").over(w)) & (F.col("t_start") - F.lag("t_end").over(w) <= gap), 0).otherwise(1)
    return l.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def weaving(df: DataFrame, block: str, t: str, enter: float = 2.0, gap: float = 0.2, chain_gap: float = 0.5, least: int = 3, least_ay: float = 0.5, least_rate: float = 20.0, most_net: float = 20.0, v_min: float = 3.0, bucket: float = 10.0) -> DataFrame:
    """(block, t_start, t_end, n, net): chains of at least `least` alternating lobes, each with lateral acceleration and steering rate behind it, that turn little altogether."""
    l = lobes(df, "yaw_dev", block, t, enter, gap)
    spans = l.select(block, "lobe", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    backed = points_in(df.select(block, F.col(t).alias("t"), "ay_kin_mps2", "steer_rate_dps", "v_mps"), spans, block, "t", bucket).groupBy(block, "lobe").agg(F.max(F.abs("ay_kin_mps2")).alias("ay"), F.max(F.abs("steer_rate_dps")).alias("rate"), F.avg("v_mps").alias("speed"))
    strong = l.join(backed, [block, "lobe"]).filter((F.col("ay") >= least_ay) & (F.col("rate") >= least_rate))
    out = chains(strong, block, chain_gap).groupBy(block, "chain").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("n"), F.sum("area").alias("net"), F.avg("speed").alias("speed"))
    return out.filter((F.col("n") >= least) & (F.abs("net") <= most_net) & (F.col("speed") >= v_min)).select(block, "t_start", "t_end", "n", "net")


def s_evasions(df: DataFrame, block: str, t: str, dt: float, enter: float = 2.0, gap: float = 0.2, chain_gap: float = 0.5, least: int = 3, least_excursion: float = 0.05, most_return: float = 3.0, v_min: float = 3.0, bucket: float = 10.0) -> DataFrame:
    """(block, t_start, t_end, excursion_m, final_m): chains of at least `least` alternating lobes that swing out and come back."""
    c = chains(lobes(df, "yaw_dev", block, t, enter, gap), block, chain_gap).groupBy(block, "chain").agg(F.min("t_start").alias("b_start"), F.max("t_end").alias("b_end"), F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = points_in(df.select(block, F.col(t).alias("t"), "v_mps", "yaw_dev"), c, block, "t", bucket)
    run = Window.partitionBy(block, "chain").orderBy("t")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("side", F.coalesce("v_mps", F.lit(0.0)) * F.sin(F.coalesce(F.sum(F.radians(F.coalesce("yaw_dev", F.lit(0.0))) * dt).over(before), F.lit(0.0))))
    rows = rows.withColumn("lat", F.coalesce(F.sum(F.col("side") * dt).over(before), F.lit(0.0)))
    out = rows.groupBy(block, "chain", F.col("b_start").alias("t_start"), F.col("b_end").alias("t_end")).agg(F.max(F.abs("lat")).alias("excursion_m"), F.max_by("lat", "t").alias("final_m"), F.avg("v_mps").alias("speed"))
    return out.filter((F.col("speed") >= v_min) & (F.col("excursion_m") >= least_excursion) & (F.abs("final_m") <= most_return)).select(block, "t_start", "t_end", "excursion_m", "final_m")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, coverage, min, max) of columns over all rows."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {parts}) as (feature, x)")).groupBy("feature").agg((F.count("x") / F.count("*")).alias("coverage"), F.min("x").alias("min"), F.max("x").alias("max"))
