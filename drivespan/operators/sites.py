"""Places: baselines by speed, events at sites, passes over them, and stretches of linked sites."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.operators.joins import TILE, farthest, heading_difference, near_pairs, near_reduced, near_streamed, nearest_pairs, numbers, told_apart, turned
from drivespan.sources.scratch import checkpointed


def speed_baseline(df: DataFrame, v: str, x: str, width: float) -> DataFrame:
    """(bin, base, n): median of x by speed bin."""
    return df.filter(F.col(x).isNotNull()).groupBy(F.floor(F.col(v) / width).alias("bin")).agg(F.percentile(x, 0.5).alias("base"), F.count("*").alias("n"))


def baseline_ratio(df: DataFrame, base: DataFrame, v: str, x: str, width: float, bins: int) -> DataFrame:
    """df with ratio = x / baseline; bins without one are interpolated between their neighbours and clamped to the end ones."""
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(base.select("bin", "base"), "bin", "left")
    w = Window.orderBy("bin")
    s = F.when(F.col("base").isNotNull(), F.struct("bin", "base"))
    a = F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(s, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    f = every.withColumns({"a": a, "b": b})
    span = F.nullif((F.col("b.bin") - F.col("a.bin")).cast("double"), F.lit(0.0))
    mid = F.col("a.base") + (F.col("b.base") - F.col("a.base")) * F.coalesce((F.col("bin") - F.col("a.bin")) / span, F.lit(0.0))
    full = f.select("bin", F.coalesce(mid, F.col("a.base"), F.col("b.base")).alias("__base"))
    own = df.withColumn("bin", F.least(F.greatest(F.floor(F.col(v) / width), F.lit(0)), F.lit(bins - 1)))
    return own.join(F.broadcast(full), "bin").withColumn("ratio", F.col(x) / F.nullif("__base", F.lit(0.0))).drop("bin", "__base")


def _drive_rows(u: pd.DataFrame, v: pd.DataFrame, near: np.ndarray, drive: str, value: str | None = None) -> pd.DataFrame:
    """(id, other) for each of u and each other drive of v that has a near row, and the greatest value of those rows."""
    codes, names = pd.factorize(v[drive])
    i, j = np.nonzero(near & (u[drive].to_numpy()[:, None] != v[drive].to_numpy()[None, :]))
    key, place = np.unique(i * len(names) + codes[j], return_inverse=True)
    out = pd.DataFrame({"id": u["id"].to_numpy()[key // max(len(names), 1)], "other": np.asarray(names)[key % max(len(names), 1)]})
    if value:
        best = np.full(len(key), -np.inf)
        np.maximum.at(best, place, v[value].to_numpy(float)[j])
        out["m"] = best
    return out


def repeats(events: DataFrame, x: str, y: str, heading: str, drive: str, radius: float, turn: float) -> DataFrame:
    """(id, drives): how many other drives have an event within the radius and about the same heading."""
    own = events.select("id", x, y, heading, drive)
    kinds = dict(own.dtypes)
    native = lambda pairs: pairs.filter(F.col(drive) != F.col(f"b_{drive}")).filter(heading_difference(F.col(heading), F.col(f"b_{heading}")) <= turn).select("id", F.col(f"b_{drive}").alias("other")).distinct()
    kernel = lambda u, v, near: _drive_rows(u, v, near & (turned(u[heading].to_numpy(), v[heading].to_numpy()) <= turn), drive)
    met = near_reduced(own, own, x, y, radius, native, kernel, f"id {kinds['id']}, other {kinds[drive]}")
    n = met.groupBy("id").agg(F.count_distinct("other").alias("drives"))
    return events.select("id").join(n, "id", "left").select("id", F.coalesce("drives", F.lit(0)).alias("drives"))


def assign_sites(points: DataFrame, x: str, y: str, heading: str, strength: str, radius: float, turn: float, most_rounds: int = 200) -> DataFrame:
    """(id, site): greedy strongest-first seeding. The strongest free point becomes a site and takes every free point within radius and heading; ties go to the smaller id.

    The loop over points is replaced by rounds: every free point without a stronger free neighbour is a seed, and what lies near a seed is free no longer. At the end each point joins its strongest
    covering seed. Rounds are checkpointed. Seeds lie apart, so few meet a point; free neighbours are only asked whether there is one.
    """
    kinds = dict(points.dtypes)
    rows = points.select("id", x, y, heading, strength)
    alike = heading_difference(F.col(heading), F.col(f"b_{heading}")) <= turn
    stronger = (F.col(f"b_{strength}") > F.col(strength)) | ((F.col(f"b_{strength}") == F.col(strength)) & (F.col("b_id") < F.col("id")))

    def kernel(u: pd.DataFrame, v: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        s, t = u[strength].to_numpy()[:, None], v[strength].to_numpy()[None, :]
        before = (t > s) | ((t == s) & (v["id"].to_numpy()[None, :] < u["id"].to_numpy()[:, None]))
        hit = (near & before & (turned(u[heading].to_numpy(), v[heading].to_numpy()) <= turn)).any(axis=1)
        return pd.DataFrame({"id": u["id"].to_numpy()[hit]})

    free, seeds = checkpointed(rows), None
    for _ in range(most_rounds):
        waits = near_reduced(free, free, x, y, radius, lambda pairs: pairs.filter(alike & stronger).select("id").distinct(), kernel, f"id {kinds['id']}").distinct()
        new = checkpointed(free.join(waits, "id", "left_anti"))
        seeds = new if seeds is None else seeds.unionByName(new)
        covered = near_pairs(free, new, x, y, radius).filter(alike).select("id").distinct()
        free = checkpointed(free.join(covered, "id", "left_anti"))
        if free.isEmpty():
            break
    else:
        raise RuntimeError("sites did not settle")
    cover = near_pairs(rows, seeds, x, y, radius).filter(alike & (stronger | (F.col("id") == F.col("b_id")))).groupBy("id").agg(F.max_by("b_id", F.struct(F.col(f"b_{strength}"), -F.col("b_id"))).alias("site"))
    own = seeds.select("id", F.col("id").alias("seed"))
    return points.select("id").join(cover, "id", "left").join(own, "id", "left").select("id", F.coalesce("seed", "site").alias("site"))


class _Passes:
    """The passes over the sites of a slot, from ticks that come by drive and time; of each site only the pass under way is kept."""

    fields = ("pass", "t_start", "t_end", "t_near", "dist")

    def __init__(self, x: str, y: str, radius: float, drive: str, t: str, gap: float, tile: int):
        self.x, self.y, self.most, self.drive, self.t, self.gap, self.tile = x, y, farthest(radius), drive, t, gap, tile
        self.parts: list[pa.RecordBatch] = []
        self.site, self.last_drive = None, None

    def own(self, piece: pa.RecordBatch) -> None:
        self.parts.append(piece)

    def _rows(self, i: np.ndarray, drives: pa.Array, code: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        cols = [self.site.take(pa.array(i)), drives.take(pa.array(code)), pa.array(values[0])]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(v, from_pandas=True) for v in values[1:])], names=["site", self.drive, *self.fields])

    def _open_rows(self, i: np.ndarray) -> list[np.ndarray]:
        return [self.number[i], *(s[i] for s in (self.start, self.stop, self.near, self.best))]

    def met(self, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.site is None and self.parts:
            self.site = pa.concat_arrays([p.column("site") for p in self.parts])
            self.sx, self.sy = (np.concatenate([numbers(p, c) for p in self.parts]) for c in (self.x, self.y))
            n = len(self.sx)
            self.open, self.number = np.zeros(n, bool), np.zeros(n, np.int64)
            self.start, self.stop, self.near, self.best, self.before = np.zeros((5, n))
        if self.site is None:
            return
        coded = piece.column(self.drive).dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy()
        run = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
        first = coded.dictionary.slice(int(code[0]), 1)
        same = self.last_drive is not None and first.equals(self.last_drive)
        drives = pa.concat_arrays([coded.dictionary, first if self.last_drive is None else self.last_drive])
        tick = (*(numbers(piece, c) for c in (self.x, self.y, self.t)), run, code)
        step = max(1, self.tile // len(run))
        for lo in range(0, len(self.sx), step):
            i, c, values = self._tile(lo, lo + step, *tick, same, len(drives) - 1)
            if len(i):
                yield self._rows(i, drives, c, values)
        self.last_drive = coded.dictionary.slice(int(code[-1]), 1)

    def _tile(self, lo: int, hi: int, tx: np.ndarray, ty: np.ndarray, tt: np.ndarray, runs: np.ndarray, codes: np.ndarray, same: bool, old: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(sites, drives' codes, values) of the passes that end; `old` is the code of the drive whose passes were under way, `same` whether these ticks go on with it."""
        d = (self.sx[lo:hi, None] - tx) ** 2
        d += (self.sy[lo:hi, None] - ty) ** 2
        i, j = np.nonzero(d <= self.most)
        d, i, t, run = np.sqrt(d[i, j]), i + lo, tt[j], runs[j]
        head = np.ones(len(i), bool)
        head[1:] = (i[1:] != i[:-1]) | (run[1:] != run[:-1])
        held = head & (run == 0) & self.open[i] & same
        prev = np.concatenate([t[:0], [np.nan] * min(1, len(t)), t[:-1]])
        prev[head] = np.nan
        prev[held] = self.before[i[held]]
        new = t - prev > self.gap
        begins = head | new
        p, group = np.flatnonzero(begins), np.cumsum(begins) - 1
        out: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        g, stays = i[p], np.zeros(len(p), bool)
        if len(p):
            heads, counted = np.flatnonzero(head), np.cumsum(new)
            base = np.where(held[heads], self.number[i[heads]], 0) - counted[heads] + new[heads]
            number = base[(np.cumsum(head) - 1)[p]] + counted[p]
            final = np.concatenate([p[1:], [len(i)]]) - 1
            start, stop, best = np.fmin.reduceat(t, p), np.fmax.reduceat(t, p), np.minimum.reduceat(d, p)
            hit = np.flatnonzero(d == best[group])
            near = t[hit[np.concatenate([[True], group[hit[1:]] != group[hit[:-1]]])]]
            on, closed = held[p] & ~new[p], g[held[p] & new[p]]
            out.append((closed, np.full(len(closed), old), self._open_rows(closed)))
            k = g[on]
            near[on] = np.where(self.best[k] <= best[on], self.near[k], near[on])
            start[on], stop[on], best[on] = np.fmin(self.start[k], start[on]), np.fmax(self.stop[k], stop[on]), np.minimum(self.best[k], best[on])
            self.open[g[held[p]]] = False
            stays = (run[p] == runs[-1]) & np.concatenate([g[1:] != g[:-1], [True]])
            out.append((g[~stays], codes[j[p[~stays]]], [v[~stays] for v in (number, start, stop, near, best)]))
        if not same or runs[-1] > 0:
            left = np.flatnonzero(self.open[lo:hi]) + lo
            out.append((left, np.full(len(left), old), self._open_rows(left)))
            self.open[lo:hi] = False
        if len(p):
            k = g[stays]
            self.open[k] = True
            for state, v in zip((self.number, self.start, self.stop, self.near, self.best, self.before), (number, start, stop, near, best, t[final]), strict=True):
                state[k] = v[stays]
        if not out:
            return i, i, []
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), [np.concatenate(v) for v in zip(*(o[2] for o in out), strict=True)]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.last_drive is not None and self.open.any():
            left = np.flatnonzero(self.open)
            yield self._rows(left, self.last_drive, np.zeros(len(left), int), self._open_rows(left))


def site_passes(sites: DataFrame, ticks: DataFrame, x: str, y: str, radius: float, drive: str, t: str, gap: float, tile: int = TILE) -> DataFrame:
    """(site, drive, pass, t_start, t_end, t_near, dist): every stretch of a drive within the radius of a site, whether or not anything happened; a pause longer than gap begins another pass.

    Ticks pass by the sites in the order of drive and time and passes are told where they meet, so what is shuffled grows with the points and not with their pairs; what is given grows with the pairs all the same. Sites of several places go by pairs.
    """
    times, kinds = dict(ticks.dtypes)[t], dict(ticks.dtypes) | dict(sites.dtypes)

    def streamed(own: DataFrame) -> DataFrame:
        schema = f"site {kinds['site']}, `{drive}` {kinds[drive]}, pass long, t_start double, t_end double, t_near double, dist double"
        rows = near_streamed(own.select("site", x, y), ticks.select(drive, t, x, y), x, y, radius, [drive, t], lambda: _Passes(x, y, radius, drive, t, gap, tile), schema)
        return rows.withColumns({c: F.col(c).cast(times) for c in ("t_start", "t_end", "t_near")})

    def paired(own: DataFrame) -> DataFrame:
        near = near_pairs(ticks, own, x, y, radius).select(F.col("b_site").alias("site"), drive, F.col(t).alias("t"), "dist")
        w = Window.partitionBy("site", drive).orderBy("t")
        near = near.withColumn("__new", F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)).withColumn("pass", F.sum("__new").over(w))
        return near.groupBy("site", drive, "pass").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min_by("t", F.struct("dist", "t")).alias("t_near"), F.min("dist").alias("dist"))

    return told_apart(sites, "site", streamed, paired)


def _forest(u: pd.DataFrame, v: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
    """(site, other): links that connect whatever of u and v hangs together by near, one fewer than the sites of each part."""
    ids = np.concatenate([u["site"].to_numpy(), v["site"].to_numpy()])
    n, left = len(u), np.ones(len(ids), bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(n):
        if not left[start]:
            continue
        left[start], stack = False, [start]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(left[n:] & near[i]) + n if i < n else np.flatnonzero(left[:n] & near[:, i - n])
            left[found] = False
            stack.extend(found.tolist())
            out.append((np.full(len(found), ids[i]), ids[found]))
    a, b = (np.concatenate([o[k] for o in out]) if out else ids[:0] for k in (0, 1))
    return pd.DataFrame({"site": a, "other": b})[a != b]


def stretches(sites: DataFrame, x: str, y: str, heading: str, link: float, turn: float, most_rounds: int = 200) -> DataFrame:
    """(site, stretch): sites linked within `link` metres and about the same heading, as connected components; stretch is the least site.

    Labels fall to the least neighbour's in rounds, each checkpointed, with a jump to the label's own label to halve the way. Of a hot cell only links that connect it are kept.
    """
    own = sites.select("site", x, y, heading)
    native = lambda pairs: pairs.filter(F.col("site") != F.col("b_site")).filter(heading_difference(F.col(heading), F.col(f"b_{heading}")) <= turn).select("site", F.col("b_site").alias("other"))
    kernel = lambda u, v, near: _forest(u, v, near & (turned(u[heading].to_numpy(), v[heading].to_numpy()) <= turn))
    kind = dict(own.dtypes)["site"]
    found = near_reduced(own, own, x, y, link, native, kernel, f"site {kind}, other {kind}")
    edges = checkpointed(found.unionByName(found.select(F.col("other").alias("site"), F.col("site").alias("other"))).distinct())
    label = checkpointed(sites.select("site", F.col("site").alias("stretch")))
    for _ in range(most_rounds):
        got = edges.join(label.select(F.col("site").alias("other"), F.col("stretch").alias("s")), "other").groupBy("site").agg(F.min("s").alias("s"))
        new = label.join(got, "site", "left").select("site", "stretch", F.least("stretch", F.coalesce("s", "stretch")).alias("n"))
        jump = label.select(F.col("site").alias("n"), F.col("stretch").alias("j"))
        new = checkpointed(new.join(jump, "n").select("site", "stretch", F.least("n", "j").alias("n")))
        done = new.filter("n < stretch").isEmpty()
        label = new.select("site", F.col("n").alias("stretch"))
        if done:
            return label
    raise RuntimeError("stretches did not settle")


def opposite_links(sites: DataFrame, x: str, y: str, heading: str, radius: float, turn: float = 30.0) -> DataFrame:
    """(site, other): the nearest site of about the opposite heading within the radius."""
    near = near_pairs(sites, sites, x, y, radius).filter(heading_difference(F.col(heading) + 180.0, F.col(f"b_{heading}")) <= turn)
    return near.groupBy("site").agg(F.min_by("b_site", F.struct("dist", "b_site")).alias("other"))


def capped(df: DataFrame, group: str, cap: int, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in order, at most cap of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= cap).drop("__r").orderBy(*order).limit(n)


def best_per_site(events: DataFrame, site: str, score: str) -> DataFrame:
    """(site, best, score, n, median): the strongest event of each site, the smaller id of equals, with count and median."""
    return events.groupBy(site).agg(F.max_by("id", F.struct(F.col(score), -F.col("id"))).alias("best"), F.max(score).alias("score"), F.count("*").alias("n"), F.percentile(score, 0.5).alias("median"))


def priority_class(hits: list[Column]) -> Column:
    """The number (from 1) of the first test that holds, one more than their count if none does."""
    out = F.lit(len(hits) + 1)
    for i in reversed(range(len(hits))):
        out = F.when(F.coalesce(hits[i], F.lit(False)), i + 1).otherwise(out)
    return out


def road_match(points: DataFrame, ways: DataFrame, x: str, y: str, heading: str, radius: float, turn: float) -> DataFrame:
    """(id, way, dist): the nearest way point (way, x, y, bearing, oneway) that agrees in bearing, either way round on two-way roads.

    Where ways are dense a narrower radius that holds one of the point's sector of headings suffices. Of way points alike in all the least is enough.
    """
    sectors = math.ceil(360.0 / turn) if turn > 0 else 0
    sector = lambda c: F.floor(F.pmod(F.col(c), F.lit(360.0)) * (sectors / 360.0))
    kind = sector if 0 < turn else lambda c: F.col(c)
    w = ways.groupBy(x, y, "bearing", "oneway").agg(F.min("way").alias("way")).withColumn("__kind", kind("bearing"))
    near = nearest_pairs(points.select("id", x, y, heading, kind(heading).alias("__kind")), w, [x, y], radius, 1, ["__kind"])
    near = near.withColumn("dist", F.sqrt((F.col(x) - F.col(f"b_{x}")) ** 2 + (F.col(y) - F.col(f"b_{y}")) ** 2)).filter(F.col("dist") <= radius)
    d = heading_difference(F.col(heading), F.col("b_bearing"))
    agree = (d <= turn) | (~F.col("b_oneway") & (180.0 - d <= turn))
    return near.filter(agree).groupBy("id").agg(F.min_by("b_way", F.struct("dist", "b_way")).alias("way"), F.min("dist").alias("dist"))


def uniqueness(events: DataFrame, passes: DataFrame, x: str, y: str, drive: str, value: str, radius: float) -> DataFrame:
    """(id, others, share): of the other drives that pass within the radius, the share that reaches the event's value there."""
    own, other = events.select("id", x, y, drive, value), passes.select(x, y, drive, value)
    kinds = dict(own.dtypes)
    native = lambda pairs: pairs.filter(F.col(drive) != F.col(f"b_{drive}")).groupBy("id", F.col(f"b_{drive}").alias("other")).agg(F.max(f"b_{value}").cast("double").alias("m"))
    met = near_reduced(own, other, x, y, radius, native, lambda u, v, near: _drive_rows(u, v, near, drive, value), f"id {kinds['id']}, other {kinds[drive]}, m double")
    per = met.groupBy("id", "other").agg(F.max("m").alias("m")).join(own.select("id", F.col(value).alias("own")), "id")
    return per.groupBy("id").agg(F.count("*").alias("others"), F.avg((F.col("m") >= F.col("own")).cast("double")).alias("share"))


def weather_near(points: DataFrame, stations: DataFrame, radius_m: float, k: int) -> DataFrame:
    """(id, station, dist_m, rank): up to k stations within the radius, nearest first.

    Places on the sphere meet on cubes as wide as the radius, or as a half, quarter, ... of it where stations are so dense that k lie within it; poles and
    the date line need no care. Of stations at one place the k least are enough.
    """
    from drivespan.functions.vehicle import EARTH_M, haversine_m

    lat, lon = F.radians("lat"), F.radians("lon")
    unit = {"__ux": F.cos(lat) * F.cos(lon), "__uy": F.cos(lat) * F.sin(lon), "__uz": F.sin(lat)}
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("station"))
    s = stations.select("station", "lat", "lon", first.alias("__r")).filter(F.col("__r") <= k).select("station", "lat", "lon", *(c.alias(n) for n, c in unit.items()))
    met = nearest_pairs(points.select("id", "lat", "lon", *(c.alias(n) for n, c in unit.items())), s, list(unit), radius_m / EARTH_M, k)
    met = met.withColumn("dist_m", haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))).filter(F.col("dist_m") <= radius_m)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist_m", "b_station"))).filter(F.col("rank") <= k).select("id", F.col("b_station").alias("station"), "dist_m", "rank")


def idw(obs: DataFrame, key: str, value: str, dist: str) -> DataFrame:
    """(key, estimate, spread, loo_rmse, n): inverse-square-distance mean, range of the values, and the error when each is predicted from the others."""
    w = 1.0 / F.greatest(F.col(dist) * F.col(dist), F.lit(1.0))
    o = obs.withColumn("w", w).withColumn("wv", F.col("w") * F.col(value))
    t = o.groupBy(key).agg(F.sum("w").alias("tw"), F.sum("wv").alias("twv"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.count("*").alias("n"))
    loo = o.join(t, key).withColumn("e", F.when(F.col("n") > 1, (F.col("twv") - F.col("wv")) / F.nullif(F.col("tw") - F.col("w"), F.lit(0.0)) - F.col(value)))
    return loo.groupBy(key).agg((F.first("twv") / F.first("tw")).alias("estimate"), (F.first("hi") - F.first("lo")).alias("spread"), F.sqrt(F.avg(F.col("e") ** 2)).alias("loo_rmse"), F.first("n").alias("n"))


def completeness(obs: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys with step (the usual spacing), n and the share of expected observations that are there."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = obs.withColumn("__d", F.col(t) - F.lag(t).over(w))
    g = d.groupBy(*keys).agg(F.percentile("__d", 0.5).alias("step"), F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span"))
    return g.select(*keys, "step", "n", (F.col("n") / (F.floor(F.col("span") / F.nullif("step", F.lit(0.0))) + 1)).alias("share"))


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """How interval a lies to window b (before, after, inside, covers, overlaps), and the seconds they share."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    return F.when(a1 < b0, "before").when(a0 > b1, "after").when((a0 >= b0) & (a1 <= b1), "inside").when((a0 <= b0) & (a1 >= b1), "covers").otherwise("overlaps"), shared


def unique_candidates(c: DataFrame, drive: str, t: str, score: str, setting: str, within: float) -> DataFrame:
    """(drive, t, score, settings): candidates of several settings that start within `within` of the last one are one; the best stays, with all settings."""
    w = Window.partitionBy(drive).orderBy(t, setting)
    g = c.withColumn("__g", F.sum(F.when(F.col(t) - F.lag(t).over(w) <= within, 0).otherwise(1)).over(w))
    return g.groupBy(drive, "__g").agg(F.max_by(t, F.struct(F.col(score), -F.col(t))).alias(t), F.max(score).alias(score), F.array_sort(F.collect_set(setting)).alias("settings")).drop("__g")


def straight_windows(df: DataFrame, keys: list[str], t: str, width: float, rows: int, v: str, yaw: str, most_range: float, most_yaw: float) -> DataFrame:
    """keys, win, n, v_mean, v_range of complete windows in which speed and yaw hardly change."""
    g = df.groupBy(*keys, F.floor(F.col(t) / width).alias("win")).agg(F.count(v).alias("n"), F.avg(v).alias("v_mean"), (F.max(v) - F.min(v)).alias("v_range"), F.max(F.abs(yaw)).alias("yaw_max"))
    return g.filter((F.col("n") >= rows) & (F.col("v_range") <= most_range) & (F.col("yaw_max") <= most_yaw)).drop("yaw_max")


def hit_time(rows: DataFrame, block: str, t: str, x: str, share: float = 0.5) -> DataFrame:
    """(block, t_hit, t_peak): the first time that |x| reaches the share of its peak."""
    top = rows.groupBy(block).agg(F.max(F.abs(x)).alias("__m"), F.max_by(t, F.struct(F.abs(x), -F.col(t))).alias("t_peak"))
    return rows.join(top, block).groupBy(block, "t_peak").agg(F.min(F.when(F.abs(x) >= share * F.col("__m"), F.col(t))).alias("t_hit"))


def exceedance_rate(df: DataFrame, keys: list[str], t: str, x: str, width: float, limit: float) -> DataFrame:
    """keys with windows, hits and hits per hour of |x| above the limit in windows of `width` seconds."""
    g = df.groupBy(*keys, F.floor(F.col(t) / width).alias("w")).agg(F.max(F.abs(x)).alias("m"))
    return g.groupBy(*keys).agg(F.count("*").alias("windows"), F.sum((F.col("m") > limit).cast("int")).alias("hits")).withColumn("per_hour", F.col("hits") * 3600.0 / (F.col("windows") * width))


def ride_dose(df: DataFrame, keys: list[str], x: str, rate_hz: float) -> DataFrame:
    """keys with rms, vdv (fourth-power dose), crest and a comfort class."""
    g = df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(x) ** 2)).alias("rms"), F.pow(F.sum(F.pow(F.col(x), 4)) / rate_hz, 0.25).alias("vdv"), F.max(F.abs(x)).alias("peak"))
    comfort = F.when(F.col("rms") < 0.315, "not uncomfortable").when(F.col("rms") < 0.63, "a little").when(F.col("rms") < 1.0, "fairly").when(F.col("rms") < 1.6, "uncomfortable").when(F.col("rms") < 2.5, "very").otherwise("extremely")
    return g.select(*keys, "rms", "vdv", (F.col("peak") / F.nullif("rms", F.lit(0.0))).alias("crest"), comfort.alias("comfort"))
