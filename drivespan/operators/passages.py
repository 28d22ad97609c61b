"""Passages of features and quiet stretches for comparison, same-place baselines, spans in a few rows, and short windows of lateral motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw
from drivespan.operators.islands import intervals
from drivespan.operators.joins import TILE, asof, farthest, heading_difference, near_pairs, near_streamed, numbers, overlap_join, points_in, told_apart
from drivespan.operators.stats import before_range, ranged


def passages(df: DataFrame, near: Column, far: Column, block: str, t: str, step: float, least_s: float, null_s: float) -> DataFrame:
    """(block, kind, t_start, t_end): stretches near a feature of at least least_s, and null passages: whole tumbling windows of null_s seconds (counted from 0) that lie far from any throughout."""
    own = intervals(df, near, block, t, step, 0.0, least_s).select(block, F.lit("feature").alias("kind"), "t_start", "t_end")
    full = round(null_s / step)
    win = F.floor(F.round(F.col(t) / null_s, 9))
    null = df.groupBy(block, win.alias("win")).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(far, F.lit(False))).alias("all"), F.min(t).alias("t_start"), F.max(t).alias("t_end")).filter((F.col("n") >= full) & F.col("all"))
    return own.unionByName(null.select(block, F.lit("null").alias("kind"), "t_start", "t_end"))


def passage_metrics(spans: DataFrame, rows: DataFrame, key: str, t: str, x: str, beside: float, bucket: float) -> DataFrame:
    """spans (key, kind, t_start, t_end) with the mean of |x| on the passage and within `beside` seconds before and after it, the greatest |x| on it, and rise, the mean on it less that of both sides."""
    wide = spans.withColumns({"b_start": F.col("t_start") - beside, "b_end": F.col("t_end") + beside})
    met = points_in(rows.select(key, t, x), wide, key, t, bucket)
    mag = F.abs(x)
    on = F.col(t).between(F.col("t_start"), F.col("t_end"))
    mean = lambda c: F.avg(F.when(c, mag))
    g = met.groupBy(key, "kind", "t_start", "t_end").agg(mean(F.col(t) < F.col("t_start")).alias("before"), mean(on).alias("on"), mean(F.col(t) > F.col("t_end")).alias("after"), F.max(F.when(on, mag)).alias("most"), mean(~on).alias("__side"))
    return g.select(key, "kind", "t_start", "t_end", "before", "on", "after", "most", (F.col("on") - F.col("__side")).alias("rise"))


def percentile_in_null(df: DataFrame, null: DataFrame, x: str, out: str) -> DataFrame:
    """df with `out`: the share (0 to 100) of the null's values that are less than x; null for a null x and without null values. Distinct values are dealt to ranges and counted inside and before them, so no task orders them all."""
    both = df.select(F.col(x).alias("x"), F.lit(0).alias("n")).unionByName(null.select(F.col(x).alias("x"), F.lit(1).alias("n"))).filter("x is not null")
    values = ranged(both.groupBy("x").agg(F.sum("n").alias("n")), [F.col("x")])
    less = F.coalesce(F.sum("n").over(Window.partitionBy("__range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = values.join(F.broadcast(before_range(values, F.sum("n"))), "__range").select(F.col("x").alias("__x"), (less + F.col("__before")).alias("__less"))
    total = values.agg(F.sum("n").alias("__all"))
    met = df.join(placed, df[x] == placed["__x"], "left").crossJoin(F.broadcast(total))
    return met.select(*df.columns, (100.0 * F.col("__less") / F.nullif("__all", F.lit(0))).alias(out))


def quiet_sample(windows: DataFrame, events: DataFrame, key: str, quiet: Column, margin: float, n: int, seed: int, bucket: float) -> DataFrame:
    """At most n quiet windows (key, win, a_start, a_end, ...) of each key that lie at least margin from every event (key, b_start, b_end), drawn by hash of key and window."""
    free = overlap_join(windows.filter(F.coalesce(quiet, F.lit(False))), events, key, bucket, "left_anti", pad=margin)
    order = Window.partitionBy(key).orderBy(draw(seed, F.col(key), F.col("win")), "win")
    return free.withColumn("__pick", F.row_number().over(order)).filter(F.col("__pick") <= n).drop("__pick")


class _Medians:
    """The medians of other drives' values about the points of a slot. Rows come by drive, each drive's twice, by value: they are counted first, and the middle ones are taken as they pass by again."""

    def __init__(self, x: str, y: str, heading: str, drive: str, value: str, radius: float, turn: float, tile: int):
        self.names, self.drive, self.value, self.most, self.turn, self.tile = (x, y, heading), drive, value, farthest(radius), turn, tile
        self.parts: list[pa.RecordBatch] = []
        self.id, self.last = None, None

    def own(self, piece: pa.RecordBatch) -> None:
        self.parts.append(piece)

    def _alike(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
        """near, and of about the same heading. Where the angle is all but the greatest it is found as heading_difference() finds it."""
        d = np.abs(np.mod(a, 360.0)[:, None] - np.mod(b, 360.0))
        d = 180.0 - np.abs(180.0 - d)
        out = near & (d <= self.turn)
        i, j = np.nonzero(np.abs(d - self.turn) < 1e-6)
        i, j = i[near[i, j]], j[near[i, j]]
        if len(i):
            exact = np.mod(a[i] - b[j], 360.0)
            out[i, j] = np.minimum(exact, 360.0 - exact) <= self.turn
        return out

    def _turned_alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of b's headings may agree with some of a's, which are in order."""
        a = np.mod(a, 360.0)
        half = (a[-1] - a[0]) / 2
        return np.flatnonzero(~(180.0 - np.abs(180.0 - np.abs(np.mod(b, 360.0) - a[0] - half)) > self.turn + half + 1e-3))

    def met(self, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.id is None and self.parts:
            self.id, self.own_drive = (pa.concat_arrays([p.column(c) for p in self.parts]) for c in ("id", self.drive))
            self.at = [np.concatenate([numbers(p, c) for p in self.parts]) for c in self.names]
            # by heading, so that few of those that pass by turn out alike to none of a tile
            order = np.argsort(np.mod(self.at[2], 360.0))
            self.at = [c[order] for c in self.at]
            self.id, self.own_drive = self.id.take(pa.array(order)), self.own_drive.take(pa.array(order))
            n = len(self.at[0])
            self.total, self.seen, self.low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        if self.id is None:
            return
        coded = piece.column(self.drive).dictionary_encode()
        code, again = coded.indices.to_numpy(), piece.column("__again").to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (again[1:] != again[:-1])) + 1])
        run = np.repeat(np.arange(len(begins)), np.diff([*begins, len(code)]))
        first, phase = coded.dictionary.slice(int(code[0]), 1), again[begins]
        same = self.last is not None and first.equals(self.last[0])
        goes_on = same and int(phase[0]) == self.last[1]
        mine = pc.fill_null(pc.index_in(self.own_drive, coded.dictionary), -1).to_numpy(zero_copy_only=False)
        bx, by, bh = (numbers(piece, c) for c in self.names)
        v = numbers(piece, self.value)
        step = max(1, self.tile // len(run))
        for lo in range(0, len(self.at[0]), step):
            x, y, h = (c[lo : lo + step] for c in self.at)
            may = self._turned_alike(h, bh)
            d = (x[:, None] - bx[may]) ** 2
            d += (y[:, None] - by[may]) ** 2
            i, j = np.nonzero(self._alike(h, bh[may], d <= self.most))
            j = may[j]
            k = len(begins)
            n = np.bincount(i * k + run[j], minlength=len(x) * k)
            before = (np.cumsum(n) - n).reshape(-1, k)
            n = n.reshape(-1, k)
            total, base = n.copy(), np.zeros_like(n)
            if phase[0] == 0:
                total[:, 0] += self.total[lo : lo + step] if goes_on else 0
            else:
                total[:, 0] = self.total[lo : lo + step]
                base[:, 0] = self.seen[lo : lo + step] if goes_on else 0
            total[:, 1:] = np.where(phase[1:] == 1, total[:, :-1], total[:, 1:])
            low = np.zeros(n.shape)
            if phase[0] == 1 and goes_on:
                low[:, 0] = self.low[lo : lo + step]
            half = (total - 1) // 2
            here = (phase == 1) & (half >= base) & (half < base + n)
            low[here] = v[j[(before + half - base)[here]]]
            half = total // 2
            here = (phase == 1) & (half >= base) & (half < base + n)
            high = v[j[(before + half - base)[here]]]
            at, r = np.nonzero(here)
            other = mine[lo + at] != code[begins[r]]
            if other.any():
                yield pa.RecordBatch.from_arrays([self.id.take(pa.array(lo + at[other])), pa.array((0.5 * low[here] + 0.5 * high)[other])], names=["id", "m"])
            self.total[lo : lo + step], self.low[lo : lo + step] = total[:, -1], low[:, -1]
            self.seen[lo : lo + step] = base[:, -1] + n[:, -1] if phase[-1] == 1 else 0
        self.last = (coded.dictionary.slice(int(code[-1]), 1), int(phase[-1]))

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def same_place_baseline(points: DataFrame, x: str, y: str, heading: str, drive: str, value: str, radius: float, turn: float, least: int = 3, tile: int = TILE) -> DataFrame:
    """(id, drives, baseline): the median of the other drives' medians of value within the radius and about the same heading, if at least `least` of them are there.

    Values pass by the points of a cell in order, so a row is shuffled for each point and drive and none for a pair of points. Ids of several points go by pairs.
    """
    others = points.filter(F.col(value).isNotNull() & F.col(drive).isNotNull()).select(x, y, heading, drive, value)
    kinds = dict(points.dtypes)

    def streamed(own: DataFrame) -> DataFrame:
        twice = others.withColumn(value, F.col(value).cast("double")).withColumn("__again", F.explode(F.array(F.lit(0), F.lit(1))))
        mine = own.filter(F.col(drive).isNotNull()).select("id", x, y, heading, drive)
        return near_streamed(mine, twice, x, y, radius, [drive, "__again", value], lambda: _Medians(x, y, heading, drive, value, radius, turn, tile), f"id {kinds['id']}, m double")

    def paired(own: DataFrame) -> DataFrame:
        near = near_pairs(own.select("id", x, y, heading, drive), others, x, y, radius)
        near = near.filter((F.col(drive) != F.col(f"b_{drive}")) & (heading_difference(F.col(heading), F.col(f"b_{heading}")) <= turn))
        return near.groupBy("id", f"b_{drive}").agg(F.percentile(f"b_{value}", 0.5).alias("m")).select("id", "m")

    per = told_apart(points, "id", streamed, paired)
    return per.groupBy("id").agg(F.count("*").alias("drives"), F.percentile("m", 0.5).alias("baseline")).filter(F.col("drives") >= least)


def span_table(spans: DataFrame, rows: DataFrame, key: str, t: str, column: str, n: int) -> DataFrame:
    """(key, id, k, t_at, value): the latest value at or before n evenly spaced times of each span (key, id, t_start, t_end), both ends among them."""
    share = F.col("k") / (n - 1) if n > 1 else F.lit(0.0)
    at = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(t, F.col("t_start") + share * (F.col("t_end") - F.col("t_start")))
    return asof(at, rows, key, t, column, out="value").select(key, "id", "k", F.col(t).alias("t_at"), "value")


def lateral_windows(df: DataFrame, block: str, tick: str, x: str, width: int, hop: int, dt: float, flat: float, wild: float) -> DataFrame:
    """(block, win, flips, residual, kind) of windows of `width` rows that begin every `hop` ticks: sign changes of x, and the root mean square of x about its least-squares parabola; kind is flat below `flat`, wild from `wild` on, else curved.

    Windows with missing rows or nulls are left out. A row belongs to width / hop windows at most; a window's parabola comes from its moment sums, in time from its middle.
    """
    last = F.floor(F.col(tick) / hop)
    # the row before is looked up ahead of the rows' multiplication
    one = df.select(block, F.col(tick).alias("tick"), F.col(x).cast("double").alias("x"), F.lag(x).over(Window.partitionBy(block).orderBy(tick)).cast("double").alias("p"), last.alias("last"))
    rows = one.select(block, "tick", "x", "p", F.explode(F.sequence(F.floor((F.col("tick") - width) / hop) + 1, F.col("last"))).alias("win"))
    u = (F.col("tick") - F.col("win") * hop - (width - 1) / 2) * dt
    flips = F.sum(F.when((F.col("tick") > F.col("win") * hop) & (F.signum("x") * F.signum("p") < 0), 1).otherwise(0))
    g = rows.filter("win >= 0").withColumn("u", u).groupBy(block, "win").agg(flips.alias("flips"), F.count("x").alias("n"), F.sum("x").alias("s0"), F.sum(F.col("x") * F.col("u")).alias("s1"), F.sum(F.col("x") * F.col("u") ** 2).alias("s2"), F.sum(F.col("x") ** 2).alias("q"))
    m2 = sum((k * dt) ** 2 for k in (i - (width - 1) / 2 for i in range(width))) / width
    m4 = sum((k * dt) ** 4 for k in (i - (width - 1) / 2 for i in range(width))) / width
    a, b, c = F.col("s0") / width, F.col("s1") / width, F.col("s2") / width - m2 * F.col("s0") / width
    left = F.col("q") / width - a**2 - b**2 / m2 - c**2 / (m4 - m2 * m2)
    out = g.filter(F.col("n") == width).withColumn("residual", F.sqrt(F.greatest(left, F.lit(0.0))))
    kind = F.when(F.col("residual") < flat, "flat").when(F.col("residual") >= wild, "wild").otherwise("curved")
    return out.select(block, "win", "flips", "residual", kind.alias("kind"))
