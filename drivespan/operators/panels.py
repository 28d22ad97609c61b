"""Fits with effects of drives and places: two-way effects by conjugate gradients, folds over delays, offsets by direction.

Rows are reduced to moments of (drive, place) cells first. The effects of two sides are the solution of sparse normal equations; one side is
eliminated, and what is left is solved by conjugate gradients whose matrix products are joins of the cells with the two sides; where the side that
is left has few levels, its equations are summed up in one pass and solved at once. Several systems (a bootstrap's replicates) are solved side by side, each with steps of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.operators.evaluation import poisson
from drivespan.sources.scratch import checkpointed

#: So many levels are solved for at once at most, and so many numbers of all systems' equations come to the driver.
FEW_LEVELS, FEW_NUMBERS = 64, 1 << 17


def cells(df: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """(part 0, a, b, n, s_<c>, s_<c>_<d>): moment sums of the columns by cell, over rows that have all of them."""
    full = df.select(F.col(a).alias("a"), F.col(b).alias("b"), *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns)).na.drop()
    sums = [F.sum(c).alias(f"s_{c}") for c in columns] + [F.sum(F.col(c) * F.col(d)).alias(f"s_{c}_{d}") for c, d in itertools.combinations_with_replacement(columns, 2)]
    return full.groupBy(F.lit(0).alias("part"), "a", "b").agg(F.count("*").cast("double").alias("n"), *sums)


def _by_part(values: dict[int, float]) -> Column:
    """The part's value; parts are as many as systems solved at once."""
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))[F.col("part")]


def _solved(table: DataFrame, columns: list[str], levels: list) -> DataFrame:
    """(part, b, x_<c>): what the effects of the few levels of b are when those of a are eliminated. The equations are sums over a's levels, which add up whatever task holds them."""
    spark, m = table.sparkSession, len(levels)
    kind = dict(table.dtypes)["b"]
    codes = spark.createDataFrame([(v, i) for i, v in enumerate(levels)], f"b {kind}, code int")
    rows = table.join(F.broadcast(codes), "b").groupBy("part", "a").agg(F.collect_list(F.struct("code", "n", *(f"s_{c}" for c in columns))).alias("cells"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, parts = batch.column("cells"), batch.column("part").to_numpy()
            owner, flat = np.repeat(np.arange(len(parts)), pc.list_value_length(cells).to_numpy()), cells.flatten()
            code, n, *sizes = (np.asarray(v) for v in flat.flatten())
            held = np.zeros((len(parts), m))
            held[owner, code] = n
            mean = held / held.sum(axis=1, keepdims=True)
            for k in np.unique(parts).tolist():
                own = parts[owner] == k
                left = [np.bincount(code[own], s[own], m) - mean[parts == k].T @ np.bincount(owner[own], s[own], len(parts))[parts == k] for s in sizes]
                new = np.column_stack([np.diag(held[parts == k].sum(axis=0)) - mean[parts == k].T @ held[parts == k], held[parts == k].sum(axis=0), *left])
                total[k] = total[k] + new if k in total else new
        for k, v in total.items():
            i, j = np.indices(v.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, k, np.int32)), pa.array(i), pa.array(j), pa.array(v.ravel())], ["part", "i", "j", "v"])

    got: dict[int, np.ndarray] = {}
    for r in rows.select("part", "cells").mapInArrow(sums, "part int, i int, j int, v double").groupBy("part", "i", "j").agg(F.sum("v").alias("v")).collect():
        got.setdefault(r.part, np.zeros((m, m + 1 + len(columns))))[r.i, r.j] = r.v
    out = []
    for k, v in got.items():
        left, all_, right = v[:, :m], v[:, m], v[:, m + 1 :]
        some = np.diag(left) > 1e-12 * all_  # a level that shares no a with another has nothing to solve
        scale = np.where(some, 1 / np.sqrt(np.where(some, np.diag(left), 1.0)), 0.0)
        x = scale[:, None] * np.linalg.lstsq(scale[:, None] * left * scale, scale[:, None] * right, rcond=1e-10)[0]
        out += [(k, level, *map(float, x[i])) for i, level in enumerate(levels)]
    return spark.createDataFrame(out, f"part int, b {kind}, " + ", ".join(f"x_{c} double" for c in columns))


def effects(table: DataFrame, columns: list[str], tolerance: float = 1e-10, most_rounds: int = 1000) -> DataFrame:
    """table (part, a, b, n, s_<c>, ...; a checkpointed one) with f_<c>: what the effects of a and b together make of c in the cell, by least squares.

    Conjugate gradients with the diagonal as preconditioner run until each system's residual is `tolerance` of its start; components that are not linked are solved alike. A round is one
    checkpointed table of the b side. Raises if most_rounds do not suffice: they are needed as long as the longest chain of cells that hang together. If b has at most FEW_LEVELS levels there are no rounds.
    """
    levels = [r.b for r in table.select("b").distinct().limit(FEW_LEVELS + 1).collect()]
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    if 0 < len(levels) <= FEW_LEVELS and parts * len(levels) * (len(levels) + 1 + len(columns)) <= FEW_NUMBERS:
        n, own = F.col("n"), Window.partitionBy("part", "a")
        with_b = table.join(F.broadcast(_solved(table, columns, levels)), ["part", "b"])
        return with_b.select(*table.columns, *((F.col(f"x_{c}") + F.sum(F.col(f"s_{c}") - n * F.col(f"x_{c}")).over(own) / F.sum(n).over(own)).alias(f"f_{c}") for c in columns))
    side = table.groupBy("part", "a").agg(F.sum("n").alias("na"), *((F.sum(f"s_{c}") / F.sum("n")).alias(f"m_{c}") for c in columns))
    side = checkpointed(side)
    n = F.col("n")
    start = table.join(side, ["part", "a"]).groupBy("part", "b").agg(F.sum(n).alias("nb"), F.sum(n - n * n / F.col("na")).alias("d"), *(F.sum(F.col(f"s_{c}") - n * F.col(f"m_{c}")).alias(f"r_{c}") for c in columns))
    # a level that shares no a with another has nothing to solve
    scaled = lambda c: F.when(F.col("d") > 1e-12 * F.col("nb"), F.col(f"r_{c}") / F.col("d")).otherwise(0.0)
    state = start.select("part", "b", "nb", "d", *(x for c in columns for x in (F.lit(0.0).alias(f"x_{c}"), F.when(F.col("d") > 1e-12 * F.col("nb"), F.col(f"r_{c}")).otherwise(0.0).alias(f"r_{c}"), scaled(c).alias(f"p_{c}"))))
    state = checkpointed(state)
    ends = state.groupBy("part").agg(*(F.sum(F.col(f"r_{c}") * scaled(c)).alias(c) for c in columns)).collect()
    rz = {c: {r.part: r[c] for r in ends} for c in columns}
    first = {c: dict(v) for c, v in rz.items()}
    for _ in range(most_rounds):
        if all(rz[c][k] <= tolerance**2 * first[c][k] for c in columns for k in rz[c]):
            break
        q = table.join(state.select("part", "b", *(f"p_{c}" for c in columns)), ["part", "b"]).groupBy("part", "a").agg(*((F.sum(n * F.col(f"p_{c}")) / F.sum(n)).alias(f"q_{c}") for c in columns))
        back = table.join(q, ["part", "a"]).groupBy("part", "b").agg(*(F.sum(n * F.col(f"q_{c}")).alias(f"q_{c}") for c in columns))
        step = checkpointed(state.join(back, ["part", "b"]).select("part", "b", "nb", "d", *(x for c in columns for x in (f"x_{c}", f"r_{c}", f"p_{c}", (F.col("nb") * F.col(f"p_{c}") - F.col(f"q_{c}")).alias(f"s_{c}")))))
        got = step.groupBy("part").agg(*(F.sum(F.col(f"p_{c}") * F.col(f"s_{c}")).alias(c) for c in columns)).collect()
        alpha = {c: {r.part: rz[c][r.part] / r[c] if r[c] > 0 and rz[c][r.part] > 0 else 0.0 for r in got} for c in columns}
        moved = step.select("part", "b", "nb", "d", *(x for c in columns for x in ((F.col(f"x_{c}") + _by_part(alpha[c]) * F.col(f"p_{c}")).alias(f"x_{c}"), (F.col(f"r_{c}") - _by_part(alpha[c]) * F.when(F.col("d") > 1e-12 * F.col("nb"), F.col(f"s_{c}")).otherwise(0.0)).alias(f"r_{c}"), f"p_{c}")))
        got = moved.groupBy("part").agg(*(F.sum(F.col(f"r_{c}") * scaled(c)).alias(c) for c in columns)).collect()
        now = {c: {r.part: r[c] for r in got} for c in columns}
        beta = {c: {k: now[c][k] / rz[c][k] if rz[c][k] > 0 else 0.0 for k in now[c]} for c in columns}
        rz = now
        state = moved.select("part", "b", "nb", "d", *(x for c in columns for x in (f"x_{c}", f"r_{c}", (scaled(c) + _by_part(beta[c]) * F.col(f"p_{c}")).alias(f"p_{c}"))))
    else:
        raise RuntimeError(f"effects did not settle in {most_rounds} rounds")
    b_side = state.select("part", "b", *(f"x_{c}" for c in columns))
    with_b = table.join(b_side, ["part", "b"])
    a_side = with_b.groupBy("part", "a").agg(*((F.sum(F.col(f"s_{c}") - n * F.col(f"x_{c}")) / F.sum(n)).alias(f"a_{c}") for c in columns))
    return with_b.join(a_side, ["part", "a"]).select(*table.columns, *((F.col(f"x_{c}") + F.col(f"a_{c}")).alias(f"f_{c}") for c in columns))


def _slopes(table: DataFrame, x: str, y: str) -> DataFrame:
    """(part, slope, n) of cells with effects."""
    fitted = effects(table, [x, y])
    c = F.col
    left = lambda u, v: F.sum(c(f"s_{u}_{v}") - c(f"f_{u}") * c(f"s_{v}") - c(f"f_{v}") * c(f"s_{u}") + c("n") * c(f"f_{u}") * c(f"f_{v}"))
    total = F.sum(c(f"s_{x}_{x}"))
    # what is left of x beside rounding: without it there is no slope
    return fitted.groupBy("part").agg(F.when(left(x, x) > 1e-9 * total, left(x, y) / left(x, x)).alias("slope"), F.sum("n").cast("long").alias("n"))


def _turned(df: DataFrame, a: str, b: str) -> tuple[str, str]:
    """The two sides, the one with fewer levels second: it is the one that is solved for."""
    na, nb = df.agg(F.count_distinct(a), F.count_distinct(b)).first()
    return (a, b) if nb <= na else (b, a)


def two_way_slope(df: DataFrame, a: str, b: str, x: str, y: str) -> DataFrame:
    """(slope, n): of y on x with effects of a and of b, n counting the rows that have all four. A null slope: x does not vary beyond the effects."""
    a, b = _turned(df, a, b)
    return _slopes(checkpointed(cells(df.select(a, b, F.col(x).alias("x"), F.col(y).alias("y")), a, b, ["x", "y"])), "x", "y").select("slope", "n")


def two_way_bootstrap(df: DataFrame, drive: str, place: str, x: str, y: str, replicates: int, seed: int, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(slope, low, high, n, replicates): the two-way slope, with an interval by resampling whole drives: in a replicate a drive counts a Poisson number of times, drawn by hash.

    Cells, not rows, are weighted, and all replicates are solved side by side.
    """
    own = cells(df.select(drive, place, F.col(x).alias("x"), F.col(y).alias("y")), drive, place, ["x", "y"])
    sums = [c for c in own.columns if c not in ("part", "a", "b")]
    times = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("part") == 0, 1).otherwise(poisson(draw(seed, F.col("part"), F.col("a")))))
    table = checkpointed(times.filter("w > 0").select("part", "a", "b", *((F.col(c) * F.col("w")).alias(c) for c in sums)))
    got = checkpointed(_slopes(table, "x", "y"))
    ends = got.filter("part > 0 and slope is not null").agg(F.percentile("slope", levels[0]).alias("low"), F.percentile("slope", levels[1]).alias("high"), F.count("*").alias("replicates"))
    return got.filter("part = 0").select("slope", "n").crossJoin(F.broadcast(ends)).select("slope", "low", "high", "n", "replicates")


def fold_fits(df: DataFrame, drive: str, fold: str, x1: str, x2: str, delayed: dict[float, str], residual) -> DataFrame:
    """(fold, delay, a, b, sigma, n): for each fold, from the rows of all others, the delay with the least deviation of the model's residual.

    delayed: the column of y by delay. y = a x1 + b x2 + an effect of the drive is fitted for each delay from moment sums of (fold, drive), from which the fold's own are
    subtracted. residual(y less the drive's effect, a, b) gives a row's residual, whose deviation over the same rows decides; ties go to the
    least delay. Rows are read twice and shuffled once, by drive.
    """
    full = df.filter(F.col(x1).isNotNull() & F.col(x2).isNotNull())
    pairs = F.array(*(F.struct(F.lit(float(d)).alias("delay"), F.col(c).cast("double").alias("y")) for d, c in delayed.items()))
    x, z, y = F.col("x1"), F.col("x2"), F.col("y")
    sums = {"n": F.count("*").cast("double"), "s1": F.sum(x), "s2": F.sum(z), "sy": F.sum(y), "s11": F.sum(x * x), "s12": F.sum(x * z), "s22": F.sum(z * z), "s1y": F.sum(x * y), "s2y": F.sum(z * y)}
    per = full.select(F.col(fold).alias("fold"), F.col(drive).alias("drive"), F.col(x1).cast("double").alias("x1"), F.col(x2).cast("double").alias("x2"), F.inline(pairs)).filter("y is not null").groupBy("fold", "drive", "delay").agg(*(v.alias(k) for k, v in sums.items()))
    per = checkpointed(per)
    c = F.col
    within = {"w11": c("s11") - c("s1") ** 2 / c("n"), "w12": c("s12") - c("s1") * c("s2") / c("n"), "w22": c("s22") - c("s2") ** 2 / c("n"), "w1y": c("s1y") - c("s1") * c("sy") / c("n"), "w2y": c("s2y") - c("s2") * c("sy") / c("n")}
    own = per.groupBy("fold", "delay").agg(*(F.sum(v).alias(k) for k, v in within.items()))
    total = own.groupBy("delay").agg(*(F.sum(k).alias(f"t_{k}") for k in within))
    rest = own.join(total, "delay").select("fold", "delay", *((c(f"t_{k}") - c(k)).alias(k) for k in within))
    det = F.nullif(c("w11") * c("w22") - c("w12") ** 2, F.lit(0.0))
    fits = rest.select("fold", "delay", ((c("w1y") * c("w22") - c("w2y") * c("w12")) / det).alias("a"), ((c("w2y") * c("w11") - c("w1y") * c("w12")) / det).alias("b")).filter("a is not null")
    table = F.broadcast(fits.groupBy().agg(F.collect_list(F.struct("fold", "delay", "a", "b")).alias("fits")))  # a row for each fold and delay
    means = per.groupBy("drive").agg(F.map_from_entries(F.collect_list(F.struct("delay", F.struct((c("sy") / c("n")).alias("y"), (c("s1") / c("n")).alias("x1"), (c("s2") / c("n")).alias("x2")).alias("m")))).alias("m"))
    rows = full.withColumnRenamed(drive, "drive").join(means, "drive").crossJoin(table)
    ys = F.create_map(*(v for d, col in delayed.items() for v in (F.lit(float(d)), c(col).cast("double"))))
    rows = rows.withColumn("__y", ys).select(F.col(fold).alias("own_fold"), *(k for k in full.columns if k not in (drive, fold)), "m", "__y", F.inline("fits")).filter("fold <> own_fold")
    mean = c("m")[c("delay")]
    effect = mean["y"] - c("a") * mean["x1"] - c("b") * mean["x2"]
    left = residual(c("__y")[c("delay")] - effect, c("a"), c("b"))
    sigma = rows.groupBy("fold", "delay", "a", "b").agg(F.stddev_pop(left).alias("sigma"), F.count(left).alias("n"))
    return sigma.groupBy("fold").agg(F.min_by(F.struct("delay", "a", "b", "sigma", "n"), F.struct("sigma", "delay")).alias("best")).select("fold", "best.*")


def direction_offsets(windows: DataFrame, drive: str, order: list[str], off: str, heading: str, replicates: int, seed: int, least: int = 5, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(drive, n, offset, low, high, amplitude, p) from a drive's calibration windows: the median offset with a bootstrap interval, the amplitude of its first
    harmonic in the heading (degrees), and how often a shift of the offsets along the windows' order reaches that amplitude.

    In a replicate of the bootstrap a window counts a Poisson number of times; in one of the permutation the offsets are moved on by a drawn number of windows, cyclically, which keeps what neighbours share.
    Drives with fewer than `least` windows have no row. Windows stand for minutes, so a drive's are numbered in one window.
    """
    w = Window.partitionBy(drive)
    rows = windows.filter(F.col(off).isNotNull() & F.col(heading).isNotNull()).select(F.col(drive).alias("drive"), *order, F.col(off).cast("double").alias("off"), F.radians(F.col(heading)).alias("h"))
    w = Window.partitionBy("drive")
    rows = rows.select("drive", "off", F.sin("h").alias("s"), F.cos("h").alias("c"), (F.row_number().over(w.orderBy(*order)) - 1).alias("i"), F.count("*").over(w).alias("n")).filter(F.col("n") >= least)
    rows = checkpointed(rows)
    turns = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("r"))

    counted = turns.filter("r > 0").withColumn("k", poisson(draw(seed, F.lit("boot"), F.col("r"), F.col("drive"), F.col("i")))).filter("k > 0")
    medians = counted.groupBy("drive", "r").agg(F.percentile("off", F.lit(0.5), F.col("k")).alias("m"))
    ends = medians.groupBy("drive").agg(F.percentile("m", levels[0]).alias("low"), F.percentile("m", levels[1]).alias("high"))

    shift = F.when(F.col("r") == 0, F.lit(0)).otherwise(1 + F.floor(draw(seed, F.lit("shift"), F.col("r"), F.col("drive")) * (F.col("n") - 1))).cast("int")
    moved = turns.select("drive", "n", "r", "s", "c", F.pmod(F.col("i") + shift, F.col("n")).cast("int").alias("i")).join(rows.select("drive", "i", "off"), ["drive", "i"])
    c = F.col
    sums = moved.groupBy("drive", "r").agg(F.count("*").cast("double").alias("m"), *(F.sum(v).alias(k) for k, v in {"s_": c("s"), "c_": c("c"), "y_": c("off"), "ss": c("s") ** 2, "cc": c("c") ** 2, "sc": c("s") * c("c"), "sy": c("s") * c("off"), "cy": c("c") * c("off")}.items()))
    ss, cc, sc = c("ss") - c("s_") ** 2 / c("m"), c("cc") - c("c_") ** 2 / c("m"), c("sc") - c("s_") * c("c_") / c("m")
    sy, cy = c("sy") - c("s_") * c("y_") / c("m"), c("cy") - c("c_") * c("y_") / c("m")
    det = F.nullif(ss * cc - sc * sc, F.lit(0.0))
    amps = sums.select("drive", "r", F.hypot((sy * cc - cy * sc) / det, (cy * ss - sy * sc) / det).alias("amp"))
    own = amps.filter("r = 0").select("drive", c("amp").alias("amplitude"))
    p = amps.filter("r > 0").join(own, "drive").groupBy("drive").agg(((F.sum((c("amp") >= c("amplitude") - 1e-12).cast("int")) + 1) / (F.count("amp") + 1)).alias("p"))
    base = rows.groupBy("drive").agg(F.count("*").alias("n"), F.percentile("off", 0.5).alias("offset"))
    return base.join(ends, "drive", "left").join(own, "drive", "left").join(p, "drive", "left").select(F.col("drive").alias(drive), "n", "offset", "low", "high", "amplitude", F.when(F.col("amplitude").isNotNull(), F.col("p")).alias("p"))
