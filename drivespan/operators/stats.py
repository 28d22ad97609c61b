"""Regression, fixed effects, permutation, ranks and other statistics from sums that Spark adds up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.sources.scratch import checkpointed


def normal_equations(df: DataFrame, keys: list[str], xs: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """keys with n and the moment sums of a least-squares fit of y on xs (two or three columns; a constant is a column too)."""
    w = weight if weight is not None else F.lit(1.0)
    full = df.filter(F.col(y).isNotNull())
    for x in xs:
        full = full.filter(F.col(x).isNotNull())
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{i}{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    sums += [F.sum(w * F.col(a) * F.col(y)).alias(f"s_{i}y") for i, a in enumerate(xs)]
    return full.groupBy(*keys).agg(F.sum(w).alias("n"), *sums, F.sum(w * F.col(y)).alias("s_y"), F.sum(w * F.col(y) * F.col(y)).alias("s_yy"))


def solve(k: int) -> list[Column]:
    """The coefficients of normal_equations() with two or three columns, by Cramer's rule; null where the system is singular."""
    c = F.col
    if k == 2:
        det = F.nullif(c("s_00") * c("s_11") - c("s_01") ** 2, F.lit(0.0))
        return [(c("s_0y") * c("s_11") - c("s_1y") * c("s_01")) / det, (c("s_1y") * c("s_00") - c("s_0y") * c("s_01")) / det]
    m = [[c("s_00"), c("s_01"), c("s_02")], [c("s_01"), c("s_11"), c("s_12")], [c("s_02"), c("s_12"), c("s_22")]]
    y = [c("s_0y"), c("s_1y"), c("s_2y")]

    def det3(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    det = F.nullif(det3(m), F.lit(0.0))
    return [det3([[y[i] if j == k_ else m[i][j] for j in range(3)] for i in range(3)]) / det for k_ in range(3)]


def fit_with_r2(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """keys with n, the coefficients b_0.. and R^2 about the mean."""
    ne = normal_equations(df, keys, xs, y)
    ne = ne.withColumns({f"b_{i}": b for i, b in enumerate(solve(len(xs)))})
    explained = sum((F.col(f"b_{i}") * F.col(f"s_{i}y") for i in range(len(xs))), F.lit(0.0))
    r2 = 1 - (F.col("s_yy") - explained) / F.nullif(F.col("s_yy") - F.col("s_y") ** 2 / F.col("n"), F.lit(0.0))
    return ne.select(*keys, "n", *(f"b_{i}" for i in range(len(xs))), r2.alias("r2"))


def cross_validated(df: DataFrame, fold: str, xs: list[str], y: str) -> DataFrame:
    """(fold, n, rmse): each fold predicted by the fit of all others. Sums of the others are totals less the fold's own, so the data are read twice, not once a fold."""
    ne = normal_equations(df, [fold], xs, y)
    names = [c for c in ne.columns if c.startswith("s_") or c == "n"]
    total = ne.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    rest = ne.join(F.broadcast(total), F.lit(True)).select(fold, *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in names))
    fits = rest.select(fold, *(b.alias(f"b_{i}") for i, b in enumerate(solve(len(xs)))))
    pred = sum((F.col(f"b_{i}") * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return df.join(F.broadcast(fits), fold).groupBy(fold).agg(F.count(y).alias("n"), F.sqrt(F.avg((F.col(y) - pred) ** 2)).alias("rmse"))


def demeaned(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns less their means over the keys."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def within_slope(df: DataFrame, site: str, x: str, y: str) -> DataFrame:
    """(site, n, slope, t): the within-site regression slope and its t statistic, from moment sums."""
    m = df.groupBy(site).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) ** 2).alias("sxx"), F.sum(F.col(y) ** 2).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    cxx, cyy, cxy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    m = m.withColumns({"cxx": cxx, "cyy": cyy, "cxy": cxy}).filter("n > 2 and cxx > 0").withColumn("slope", F.col("cxy") / F.col("cxx"))
    var = (F.col("cyy") - F.col("slope") * F.col("cxy")) / (F.col("n") - 2) / F.col("cxx")
    return m.select(site, "n", "slope", (F.col("slope") / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))).alias("t"))


#: Drives of a site whose products with those that a replicate maps to them are summed at once.
BLOCK = 1 << 17


def _moved_products(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(r, xy): the part of each replicate's sum of x * y for which y stands in a's block and the x that its shift brings there in b's."""
    if not len(a) or not len(b):
        return pd.DataFrame({"r": np.empty(0, np.int32), "xy": np.empty(0)})
    a, b = a.sort_values("k"), b.sort_values("k")
    m, shifts = int(a["m"].iloc[0]), a["shifts"].dropna().iloc[0]
    y, x, at, to = a["y"].to_numpy(), b["x"].to_numpy(), int(a["k"].iloc[0]), int(b["k"].iloc[0])
    out = np.zeros(len(shifts))
    for r, shift in enumerate(np.asarray(shifts, np.int64).tolist()):
        for turn in (0, m):  # places beyond the last drive begin again
            first = at + shift - turn
            lo, hi = max(first, to), min(first + len(y), to + len(x))
            if lo < hi:
                out[r] += y[lo - first : hi - first] @ x[lo - to : hi - to]
    return pd.DataFrame({"r": np.arange(len(shifts), dtype=np.int32), "xy": out})


def pooled_permutation(df: DataFrame, site: str, drive: str, x: str, y: str, replicates: int, seed: int, block: int | None = None) -> DataFrame:
    """(slope, p): pooled within-site slope, and how often it is reached when each drive's x comes from another drive's, mapped anew in every replicate.

    Drives enter as their means within sites. A replicate maps drive k of a site's n to drive (k + shift) mod n, the shift drawn by hash. Drives in order stand in blocks; a block meets those that some
    shift maps it to, once for all replicates, so no drive becomes a row of each replicate. The sum of x * x is the same in all of them.
    """
    block = block or BLOCK
    per = df.groupBy(site, drive).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    per = demeaned(per, [site], ["x", "y"])
    w = Window.partitionBy(site)
    per = per.select(F.col(site).alias("site"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), (F.row_number().over(w.orderBy(drive)) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(w).alias("m"))
    per = checkpointed(per.withColumn("i", F.floor(F.col("k") / block)))
    own = per.agg(F.nullif(F.sum(F.col("x") ** 2), F.lit(0.0)).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("own"))
    shifts = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.floor(draw(seed, r, F.col("site")) * F.col("m")))
    first = per.filter(F.col("k") == F.col("i") * block).select("site", "i", "k", "m", shifts.alias("shifts"))
    place = lambda k: F.floor(k / block)

    def met(s: Column) -> Column:
        a, b = F.pmod(F.col("k") + s, F.col("m")), F.pmod(F.least(F.col("k") + block, F.col("m")) - 1 + s, F.col("m"))
        last = place(F.col("m") - 1)
        full = F.least(F.lit(block), F.col("m") - F.col("k")) == F.col("m")
        return F.when(full, F.sequence(F.lit(0).cast("long"), last)).when(a <= b, F.sequence(place(a), place(b))).otherwise(F.concat(F.sequence(place(a), last), F.sequence(F.lit(0).cast("long"), place(b))))

    pairs = first.select("site", "i", F.explode(F.array_distinct(F.flatten(F.transform("shifts", met)))).alias("j"))
    left = per.select("site", "i", "k", "m", "y").join(first.select("site", "k", "shifts"), ["site", "k"], "left").join(pairs, ["site", "i"]).select(*(F.col(c).alias(c) for c in ("site", "i", "j", "k", "m", "y", "shifts")))  # columns of their own, as both come of one table
    right = per.select("site", F.col("i").alias("j"), "k", "x").join(pairs, ["site", "j"]).select(*(F.col(c).alias(c) for c in ("site", "i", "j", "k", "x")))
    keys = ["site", "i", "j"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_moved_products, "r int, xy double")
    slopes = sums.groupBy("r").agg(F.sum("xy").alias("s"))
    reached = F.abs(F.col("s") / F.col("xx")) >= F.abs(F.col("own") / F.col("xx"))
    return slopes.join(F.broadcast(own), F.lit(True)).agg(F.first(F.col("own") / F.col("xx")).alias("slope"), ((F.sum(reached.cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def reversal(df: DataFrame, drive: str, sign: str, y: str) -> DataFrame:
    """(drive, n, diff, se, k): mean of y where sign is positive less where it is negative, its standard error, and their ratio."""
    up, down = F.when(F.col(sign) > 0, F.col(y)), F.when(F.col(sign) < 0, F.col(y))
    g = df.groupBy(drive).agg(F.count(y).alias("n"), F.avg(up).alias("a"), F.avg(down).alias("b"), F.count(up).alias("na"), F.count(down).alias("nb"), F.var_samp(up).alias("va"), F.var_samp(down).alias("vb"))
    g = g.withColumn("diff", F.col("a") - F.col("b")).withColumn("se", F.sqrt(F.col("va") / F.nullif(F.col("na"), F.lit(0)) + F.col("vb") / F.nullif(F.col("nb"), F.lit(0))))
    return g.select(drive, "n", "diff", "se", (F.col("diff") / F.nullif("se", F.lit(0.0))).alias("k"))


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt to ranges of the order, with `__range` as each row's range; cut from its lineage, so that ranges stay as they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


def before_range(rows: DataFrame, value: Column) -> DataFrame:
    """(__range, __before): the sum of value over all ranges before each; one row a range goes through one window."""
    per = rows.groupBy("__range").agg(value.alias("__n"))
    return per.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with `out`: each row's place, from 1, in the order. Rows are numbered inside ranges of the order, and the ranges before are added."""
    rows = ranged(df, order)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return rows.join(F.broadcast(before_range(rows, F.count("*"))), "__range").withColumn(out, own + F.col("__before")).drop("__range", "__before")


def surprise(df: DataFrame, null: DataFrame, x: str) -> DataFrame:
    """df with -log10((null values at or above + 1) / (null values + 1)).

    Distinct values are dealt to ranges; the null values at or above one are a running count inside its range and the counts of the
    ranges above. A null x has a null surprise.
    """
    both = df.select(x, F.lit(0).alias("n")).unionByName(null.select(x, F.lit(1).alias("n"))).filter(F.col(x).isNotNull())
    values = ranged(both.groupBy(x).agg(F.sum("n").alias("n")), [F.desc(x)])
    own = F.sum("n").over(Window.partitionBy("__range").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, 0))
    above = values.join(F.broadcast(before_range(values, F.sum("n"))), "__range").select(x, (own + F.col("__before")).alias("__above"))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__all"))
    out = df.join(above, x, "left").crossJoin(F.broadcast(total))
    return out.select(*df.columns, (-F.log10((F.col("__above") + 1) / (F.col("__all") + 1))).alias("surprise"))


def average_rank(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """df with the average rank of x over n within the keys, ties sharing theirs."""
    w = Window.partitionBy(*keys)
    first = F.rank().over(w.orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return df.withColumn(out, (first + (ties - 1) / 2) / F.count(F.lit(1)).over(w))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    r = average_rank(average_rank(df, keys, x, "__rx"), keys, y, "__ry")
    return r.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def leave_own_out_median(cells: DataFrame, cell: str, drive: str, x: str, least: int = 3) -> DataFrame:
    """(cell, drive, baseline): the median of the other drives' medians in the cell, if there are `least` of them.

    A cell's drives are ranked once. The median without a drive stands at one of the places around the middle, which one
    follows from the drive's own rank; so a cell passes on four values, whatever the number of its drives.
    """
    per = cells.groupBy(cell, drive).agg(F.percentile(x, 0.5).alias("m")).filter("m is not null")
    w = Window.partitionBy(cell)
    per = per.withColumn("i", F.row_number().over(w.orderBy("m", drive)) - 1).withColumn("n", F.count("*").over(w) - 1).filter(F.col("n") >= least)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = {"l0": low, "l1": low + 1, "h0": high, "h1": high + 1}
    middle = per.groupBy(cell).agg(*(F.max(F.when(F.col("i") == k, F.col("m"))).alias(n) for n, k in at.items()))
    pick = lambda k, a, b: F.when(k < F.col("i"), F.col(a)).otherwise(F.col(b))
    return per.join(middle, cell).select(cell, drive, ((pick(low, "l0", "l1") + pick(high, "h0", "h1")) / 2).alias("baseline"))
