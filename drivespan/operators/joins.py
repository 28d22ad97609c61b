"""As-of, interval and spatial joins, as unions with ordered windows or as equi-joins on buckets and cells."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.sources.scratch import checkpointed

#: Cells with more pairs than this are taken in blocks of two slots of about SLOT points each.
MANY_PAIRS, SLOT = 1 << 18, 1024
#: Points of a cell that one stream of those around it passes by, and how many distances are held at once.
STREAM_SLOT, TILE = 2048, 1 << 20
#: How often a search for the nearest halves its radius at most.
HALVES = 12


def asof(left: DataFrame, right: DataFrame, key: str, t: str, value: str, direction: str = "backward", tolerance: float | None = None, out: str = "matched") -> DataFrame:
    """left with the value and time of right's row before (or nearest to) each time: columns out and out + "_t".

    backward: the latest at or before. nearest: the smaller distance, ties to the earlier. Beyond the tolerance, or
    without any row, both are null. Of rows of right with equal times the greatest value counts.
    """
    cols = left.columns
    a = left.select(*cols, F.col(t).cast("double").alias("__t"), F.lit(1).alias("__is"), F.lit(None).cast("struct<t:double,v:double>").alias("__s"))
    b = right.filter(F.col(t).isNotNull()).select(key, F.col(t).cast("double").alias("__t"), F.lit(0).alias("__is"), F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("__s"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = F.col("__s.v").asc_nulls_first()
    w = Window.partitionBy(key).orderBy("__t", "__is", order)
    before = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("__a", before)
    pick = F.col("__a")
    if direction == "nearest":
        back = Window.partitionBy(key).orderBy(F.desc("__t"), F.col("__is"), order)
        got = got.withColumn("__b", F.last("__s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
        nearer = F.col("__b").isNotNull() & (F.col("__a").isNull() | (F.abs(F.col("__b.t") - F.col("__t")) < F.abs(F.col("__a.t") - F.col("__t"))))
        pick = F.when(nearer, F.col("__b")).otherwise(F.col("__a"))
    got = got.filter("__is = 1").withColumn("__p", pick)
    if tolerance is not None:
        got = got.withColumn("__p", F.when(F.abs(F.col("__p.t") - F.col("__t")) <= tolerance, F.col("__p")))
    return got.select(*cols, F.col("__p.v").alias(out), F.col("__p.t").alias(f"{out}_t"))


def overlap_join(a: DataFrame, b: DataFrame, key: str, bucket: float, how: str = "inner", pad: float | Column = 0.0) -> DataFrame:
    """a's rows (key, a_start, a_end, ...) with b's (key, b_start, b_end, ...) that overlap them, ends included, a widened by pad (a number, or a column of a) on both sides.

    Both sides are dealt to time buckets that they touch and joined on (key, bucket); a pair counts in the first bucket that it shares,
    so none is given twice. Inner and left joins, and left_semi and left_anti, are known. Rows of a are told by all their columns, nulls included; equal
    rows have equal answers. A row without start or end, or with a null key, overlaps nothing.
    """
    lo, hi = F.col("a_start") - pad, F.col("a_end") + pad
    floor = lambda c: F.floor(c / bucket)
    x = a.withColumn("__bucket", F.explode(F.sequence(floor(lo), floor(hi))))
    y = b.withColumn("__bucket", F.explode(F.sequence(floor(F.col("b_start")), floor(F.col("b_end")))))
    met = (F.col("b_start") <= hi) & (F.col("b_end") >= lo) & (F.col("__bucket") == F.greatest(floor(lo), floor(F.col("b_start"))))
    both = x.join(y, [key, "__bucket"]).filter(met).drop("__bucket")
    if how == "inner":
        return both
    hit = both.select(*(F.col(c).alias(f"__hit{i}") for i, c in enumerate(a.columns))).distinct()
    alike = reduce(Column.__and__, (a[c].eqNullSafe(hit[f"__hit{i}"]) for i, c in enumerate(a.columns)))
    if how == "left_semi":
        return a.join(hit, alike, "left_semi")
    missing = a.join(hit, alike, "left_anti")
    return missing if how == "left_anti" else both.unionByName(missing, allowMissingColumns=True)


def points_in(points: DataFrame, spans: DataFrame, key: str, t: str, bucket: float) -> DataFrame:
    """points with every span (key, b_start, b_end, ...) that holds them, ends included."""
    x = points.withColumn("__bucket", F.floor(F.col(t) / bucket))
    y = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("b_start") / bucket), F.floor(F.col("b_end") / bucket))))
    return x.join(y, [key, "__bucket"]).filter((F.col(t) >= F.col("b_start")) & (F.col(t) <= F.col("b_end"))).drop("__bucket")


def heading_difference(a: Column, b: Column) -> Column:
    """The unsigned angle between two headings in degrees, 0 to 180."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def near_pairs(a: DataFrame, b: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """All of a's columns and b's (prefixed b_) for pairs of points within the radius, with dist.

    Points meet on cells as wide as the radius: b is dealt to its own cell and its eight neighbours. A hot cell
    is an equi-join key like any other, which Spark's skew join splits.
    """
    cell = lambda c: F.floor(c / radius)
    p = a.withColumn("__cx", cell(F.col(x))).withColumn("__cy", cell(F.col(y)))
    around = F.array(*(F.struct((cell(F.col(x)) + i).alias("__cx"), (cell(F.col(y)) + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    q = b.select(F.inline(around), *(F.col(c).alias(f"b_{c}") for c in b.columns))
    dist = F.sqrt((F.col(x) - F.col(f"b_{x}")) ** 2 + (F.col(y) - F.col(f"b_{y}")) ** 2)
    return p.join(q, ["__cx", "__cy"]).withColumn("dist", dist).filter(F.col("dist") <= radius).drop("__cx", "__cy")


def near_reduced(a: DataFrame, b: DataFrame, x: str, y: str, radius: float, native: Callable[[DataFrame], DataFrame], kernel: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, many: int | None = None, slot: int | None = None) -> DataFrame:
    """What `native` makes of near_pairs(a, b), for cells whose points are too many to put in pairs by `kernel`; both give rows of `schema`, parts of one key among them, which the caller adds up.

    In a cell of more than `many` pairs the points of either side are dealt to slots, and every two slots meet in one task, whose kernel(a's rows, b's rows, which are within the radius of which) gives what it finds. So no pair becomes a
    row there, and a task holds two slots, however hot the cell.
    """
    many, slot = many or MANY_PAIRS, slot or SLOT
    cell = lambda c: F.floor(c / radius)
    p = a.withColumn("__cx", cell(F.col(x))).withColumn("__cy", cell(F.col(y)))
    around = F.array(*(F.struct((cell(F.col(x)) + i).alias("__cx"), (cell(F.col(y)) + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    q = b.select(F.inline(around), *b.columns)
    at = ["__cx", "__cy"]
    sizes = p.groupBy(*at).agg(F.count("*").alias("na")).join(q.groupBy(*at).agg(F.count("*").alias("nb")), at).filter(F.col("na") * F.col("nb") > many)
    hot = checkpointed(sizes.select(*at, F.ceil(F.col("na") / slot).cast("int").alias("__ma"), F.ceil(F.col("nb") / slot).cast("int").alias("__mb")))
    if hot.isEmpty():
        return native(near_pairs(a, b, x, y, radius))
    dist = F.sqrt((F.col(x) - F.col(f"b_{x}")) ** 2 + (F.col(y) - F.col(f"b_{y}")) ** 2)
    cold = p.join(hot, at, "left_anti").join(q.select(*at, *(F.col(c).alias(f"b_{c}") for c in b.columns)), at).withColumn("dist", dist).filter(F.col("dist") <= radius).drop(*at)
    own = lambda n, of: F.pmod(F.xxhash64(*(F.col(c) for c in of)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = p.join(hot, at).select(*at, own("__ma", a.columns).alias("__i"), every("__mb").alias("__j"), *a.columns)
    right = q.join(hot, at).select(*at, every("__ma").alias("__i"), own("__mb", b.columns).alias("__j"), *(F.col(c).alias(c) for c in b.columns))  # columns of their own, where a and b are one table

    def block(u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        u, v = u.reset_index(drop=True), v.reset_index(drop=True)
        near = (u[x].to_numpy()[:, None] - v[x].to_numpy()[None, :]) ** 2 + (u[y].to_numpy()[:, None] - v[y].to_numpy()[None, :]) ** 2 <= radius * radius
        return kernel(u, v, near)

    keys = [*at, "__i", "__j"]
    return native(cold).unionByName(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, schema))


def near_streamed(a: DataFrame, b: DataFrame, x: str, y: str, radius: float, order: list[str], begin: Callable[[], object], schema: str, slot: int | None = None) -> DataFrame:
    """Rows of `schema` that workers make of a's points and the points of b within the radius of each; no pair of points is shuffled, sorted or spilled.

    a's points lie in slots of their cell. All of b around a cell passes by each of its slots once, in the order given: a worker (made by begin()) first takes its slot's points by own(), then gives rows by met() of one stretch
    of the stream after the other, and what is left by end(). So a task holds a slot and a batch, however hot the cell. Columns of one name on both sides must be of one type.
    """
    slot = slot or STREAM_SLOT
    at = ["__cx", "__cy"]
    cell = lambda c: F.floor(c / radius)
    p = a.withColumn("__cx", cell(F.col(x))).withColumn("__cy", cell(F.col(y)))
    around = F.array(*(F.struct((cell(F.col(x)) + i).alias("__cx"), (cell(F.col(y)) + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    slots = p.groupBy(*at).agg(F.ceil(F.count("*") / slot).cast("int").alias("__n"))
    own = p.join(slots, at).select(*at, F.pmod(F.xxhash64(*(F.col(c) for c in a.columns)), F.col("__n")).cast("int").alias("__slot"), F.lit(0).alias("__kind"), *a.columns)
    met = b.select(F.inline(around), *b.columns).join(slots, at).select(*at, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__slot"), F.lit(1).alias("__kind"), *b.columns)
    keys = [*at, "__slot", "__kind"]
    # a number of its own, as few bytes meet in many pairs, which one task would have to make
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.unionByName(met, allowMissingColumns=True).repartition(parts, *keys[:3]).sortWithinPartitions(*keys, *order)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, work = None, None
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                if lo == hi:
                    continue
                key = tuple(k[:3, lo].tolist())
                if key != here:
                    if work is not None:
                        yield from work.end()
                    here, work = key, begin()
                piece = batch.slice(lo, hi - lo)
                if k[3, lo] == 0:
                    work.own(piece)
                else:
                    yield from work.met(piece)
        if work is not None:
            yield from work.end()

    return rows.mapInArrow(passing, schema)


def told_apart(a: DataFrame, key: str, once: Callable[[DataFrame], DataFrame], often: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """once() of a's rows whose key no other has, and often() of the rest, where there is any."""
    many = checkpointed(a.groupBy(key).count().filter("count > 1").select(F.col(key).alias("__many")))
    if many.isEmpty():
        return once(a)
    alike = F.col(key).eqNullSafe(F.col("__many"))
    return once(a.join(many, alike, "left_anti")).unionByName(often(a.join(many, alike, "left_semi")))


def farthest(radius: float) -> float:
    """The greatest double whose root is within the radius."""
    z = float(radius) * float(radius)
    while np.sqrt(z) <= radius:
        z = np.nextafter(z, np.inf)
    while np.sqrt(z) > radius:
        z = np.nextafter(z, -np.inf)
    return float(z)


def numbers(piece: pa.RecordBatch, column: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return piece.column(column).to_numpy(zero_copy_only=False).astype(float)


def nearest_pairs(a: DataFrame, b: DataFrame, at: list[str], radius: float, least: int, kinds: list[str] | None = None) -> DataFrame:
    """a's columns and b's (prefixed b_): pairs among which are, for each row of a, all rows of b within the radius, or, where b is dense, within a half, quarter, ... of it that holds `least` rows of the same kinds for sure.

    at: coordinates, the same names on both sides; kinds: columns of both that must be equal for a row of b to count. A cell of half the width lies within the width of each of its points, so a row of a
    takes the narrowest width at which its own such cell holds enough, and meets the cells of that width around it. The pairs grow with the rows of a, not with the density of b, unless a neighbour cell is much denser.
    """
    kinds = kinds or []
    width = F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("__l"))
    cells = [f"__c{i}" for i in range(len(at))]
    every = F.explode(F.sequence(F.lit(0), F.lit(HALVES))).alias("__l")
    fine = lambda d: d.select(*at, *kinds, every).select(*at, *kinds, "__l", *(F.floor(F.col(c) / (width / 2)).alias(n) for c, n in zip(at, cells, strict=True)))
    enough = fine(b).groupBy("__l", *cells, *kinds).count().filter(F.col("count") >= least).drop("count")
    level = fine(a.select(*at, *kinds).distinct()).join(enough, ["__l", *cells, *kinds]).groupBy(*at, *kinds).agg(F.max("__l").alias("__l"))
    p = a.join(level, [*at, *kinds], "left").select(*a.columns, F.coalesce("__l", F.lit(0)).alias("__l"))
    moves = F.inline(F.array(*(F.struct(*(F.lit(i).alias(f"__m{k}") for k, i in enumerate(move))) for move in itertools.product((-1, 0, 1), repeat=len(at)))))
    p = p.select("*", moves).select(*p.columns, *((F.floor(F.col(c) / width) + F.col(f"__m{k}")).alias(n) for k, (c, n) in enumerate(zip(at, cells, strict=True))))
    q = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns), every).select("*", *(F.floor(F.col(f"b_{c}") / width).alias(n) for c, n in zip(at, cells, strict=True)))
    # a number of its own, as few bytes meet in many pairs, which one task would have to make
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return p.repartition(parts, "__l", *cells).join(q.repartition(parts, "__l", *cells).hint("merge"), ["__l", *cells]).drop("__l", *cells)


def turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """heading_difference() of every a and every b."""
    d = np.abs(np.mod(a[:, None] - b[None, :], 360.0))
    return np.minimum(d, 360.0 - d)
