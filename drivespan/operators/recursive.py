"""Recursive filters and spectra over uniform grids, in pieces that any number of tasks share.

A linear filter with memory is an affine map of its state, so a block is cut into stretches of CHUNK ticks that are filtered apart from rest.
Each stretch's last state and the map of its whole length follow each other in order, which gives every stretch the state it starts from; what that
state adds is then put on. Results are those of one pass from the block's first row. Spectra are sums over windows and add up likewise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Ticks that one task filters at once.
CHUNK = 4096
#: Ticks of several stretches that are laid out at once, about.
HELD = 1 << 18
#: The weightings of ISO 2631-1, annex A, table A.2 (Hz; Q without unit). f2 is the band limit above.
WEIGHTINGS = {
    "Wk": {"f1": 0.4, "f2": 100.0, "f3": 12.5, "f4": 12.5, "Q4": 0.63, "f5": 2.37, "Q5": 0.91, "f6": 3.35, "Q6": 0.91},
    "Wd": {"f1": 0.4, "f2": 100.0, "f3": 2.0, "f4": 2.0, "Q4": 0.63},
    "We": {"f1": 0.4, "f2": 100.0, "f3": 1.0, "f4": 1.0, "Q4": 0.63},
}


class Filter:
    """A linear filter: state after a row is a @ state + b * x, its output c @ state + d * x (with the state before the row)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        self.a, self.b, self.c, self.d = (np.asarray(x, float) for x in (a, b, c, d))

    def then(self, other: Filter) -> Filter:
        """This filter followed by another."""
        n, m = len(self.b), len(other.b)
        a = np.block([[self.a, np.zeros((n, m))], [np.outer(other.b, self.c), other.a]])
        return Filter(a, np.concatenate([self.b, other.b * self.d]), np.concatenate([other.d * self.c, other.c]), float(other.d * self.d))

    def states(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The state before each row and after the last one. Steps double, so a stretch takes as many as its length has binary digits."""
        out = np.zeros((len(x) + 1, len(self.b)))
        out[1:] = x[:, None] * self.b
        if start is not None:
            out[0] = start
        step, reach = self.a.T.copy(), 1
        while reach < len(out):
            out[reach:] += out[:-reach] @ step
            step, reach = step @ step, 2 * reach
        return out

    def run(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(output, last state)."""
        s = self.states(x, start)
        return s[:-1] @ self.c + self.d * x, s[-1]


def first_order(tau_s: float, rate_hz: float) -> Filter:
    """y += (x - y) * dt / (tau + dt); tau 0 passes everything on."""
    share = 1.0 if tau_s <= 0 else (1 / rate_hz) / (tau_s + 1 / rate_hz)
    return Filter([[1 - share]], [share], [1 - share], share)


def section(num: tuple[float, float, float], den: tuple[float, float, float], rate_hz: float) -> Filter:
    """The bilinear transform of (num[0] s^2 + num[1] s + num[2]) / (den ...), a filter of two states."""
    k = 2 * rate_hz
    p = [num[0] * k * k + num[1] * k + num[2], 2 * (num[2] - num[0] * k * k), num[0] * k * k - num[1] * k + num[2]]
    q = [den[0] * k * k + den[1] * k + den[2], 2 * (den[2] - den[0] * k * k), den[0] * k * k - den[1] * k + den[2]]
    b0, b1, b2, a1, a2 = p[0] / q[0], p[1] / q[0], p[2] / q[0], q[1] / q[0], q[2] / q[0]
    return Filter([[-a1, 1.0], [-a2, 0.0]], [b1 - a1 * b0, b2 - a2 * b0], [1.0, 0.0], b0)


def weighting(name: str, rate_hz: float) -> Filter:
    """A frequency weighting of ISO 2631-1 at a sampling rate: band limits, transition and, for Wk, the upward step."""
    w = WEIGHTINGS[name]
    r = {k: 2 * math.pi * v for k, v in w.items() if k[0] == "f"}
    out = section((1, 0, 0), (1, math.sqrt(2) * r["f1"], r["f1"] ** 2), rate_hz)
    if w["f2"] < 0.45 * rate_hz:  # above that the sampling limits the band
        out = out.then(section((0, 0, r["f2"] ** 2), (1, math.sqrt(2) * r["f2"], r["f2"] ** 2), rate_hz))
    out = out.then(section((0, r["f4"] ** 2 / r["f3"], r["f4"] ** 2), (1, r["f4"] / w["Q4"], r["f4"] ** 2), rate_hz))
    if "f5" in w:
        out = out.then(section((1, r["f5"] / w["Q5"], r["f5"] ** 2), (1, r["f6"] / w["Q6"], r["f6"] ** 2), rate_hz))
    return out


def gain(f: Filter, hz: float, rate_hz: float) -> float:
    """The filter's gain at a frequency."""
    z = np.exp(2j * np.pi * hz / rate_hz)
    return float(abs(f.c @ np.linalg.solve(z * np.eye(len(f.b)) - f.a, f.b) + f.d))


def _heads(block: pa.Array, chunk: np.ndarray, last: tuple | None) -> tuple[np.ndarray, bool, tuple]:
    """(the rows at which a stretch begins, whether the first goes on from the last batch, the last stretch's block and number)."""
    coded = block.dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy()
    heads = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])) + 1])
    on = last is not None and int(chunk[0]) == last[1] and block.slice(0, 1).equals(last[0])
    return heads, on, (block.slice(len(block) - 1, 1), int(chunk[-1]))


def _side_by_side(f: Filter, at: np.ndarray, x: np.ndarray, heads: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the state before each row, the state after each stretch's last row) of stretches that begin at the rows `heads` with the ticks `first` and the states `start`; missing ticks count as zeros.

    The steps of Filter.states() for all of them at once; what would reach over a stretch's begin is left out. So many ticks as HELD are laid out at a time.
    """
    stop = np.concatenate([heads[1:], [len(at)]])
    length = at[stop - 1] - first + 1
    before, after = np.empty((len(at), len(f.b))), np.empty((len(heads), len(f.b)))
    group = np.cumsum(length + 1) // HELD
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        lo, hi = heads[own[0]], stop[own[-1]]
        n = length[own] + 1
        off = np.cumsum(n) - n
        of = np.repeat(np.arange(len(own)), stop[own] - heads[own])
        place = off[of] + at[lo:hi] - first[own][of]
        out, step, reach = np.zeros((int(n.sum()), len(f.b))), f.a.T.copy(), 1
        out[place + 1] = x[lo:hi, None] * f.b
        out[off] = start[own]
        pos = np.arange(len(out)) - np.repeat(off, n)
        while reach < n.max():
            more = out[:-reach] @ step
            more[pos[reach:] < reach] = 0.0
            out[reach:] += more
            step, reach = step @ step, 2 * reach
        before[lo:hi], after[own] = out[place], out[off + n - 1]
    return before, after


def filtered_by(df: DataFrame, filters: dict[str, Filter], block: str, tick: str, x: str, settled: bool = False, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(block, tick, *keep, *filters): x through each filter, over each block's ticks (whole numbers, a row each at most) in order.

    A null x counts as zero and has a null output, missing ticks count as zeros. The filter starts at rest, or, if `settled`, in the state that the block's first row, had it always been
    there, leaves (for a lag: its output begins with the first x). Repeated ticks keep the greatest x, and what stands beside it. Short blocks are filtered side by side, a batch of rows at a time.
    """
    value = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias("__x")
    rows = df.filter(F.col(block).isNotNull()).select(block, F.floor(F.col(tick) / chunk).alias("__chunk"), F.col(tick).cast("long").alias(tick), value, *keep)
    kinds = dict(df.dtypes)
    states = [len(f.b) for f in filters.values()]
    parts = list(zip(filters.values(), (slice(sum(states[:k]), sum(states[: k + 1])) for k in range(len(states))), strict=True))
    n = sum(states)
    whole_a = np.zeros((n, n))
    for f, at in parts:
        whole_a[at, at] = f.a
    rest = np.concatenate([np.linalg.solve(np.eye(len(f.b)) - f.a, f.b) if settled else np.zeros(len(f.b)) for f in filters.values()])
    head = f"`{block}` {kinds[block]}, __chunk long"

    def fresh(batch: pa.RecordBatch, heads: np.ndarray, on: bool, before: int | None) -> np.ndarray:
        """Which rows are not the last row's tick again."""
        at = batch.column(tick).to_numpy(zero_copy_only=False)
        out = np.concatenate([[not on or int(at[0]) != before], at[1:] != at[:-1]])
        out[heads[int(on) :]] = True
        return out

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = batch.column("__x").to_numpy(zero_copy_only=False).astype(float)
        return batch.column(tick).to_numpy(zero_copy_only=False), raw, np.nan_to_num(raw)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None

        def closed(b: pa.Array, c: np.ndarray, first: np.ndarray, m: np.ndarray, x0: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b, *(pa.array(v) for v in (c, first, m, x0)), pa.array(state.tolist(), pa.list_(pa.float64()))], names=[block, "__chunk", "first", "n", "x", "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads, on, here = _heads(batch.column(block), batch.column("__chunk").to_numpy(zero_copy_only=False), last)
            new = fresh(batch, heads, on, None if last is None else int(held[1][0] + held[2][0]) - 1)
            if not new.all():
                batch = batch.filter(pa.array(new))
                if not batch.num_rows:
                    continue
                heads, on, here = _heads(batch.column(block), batch.column("__chunk").to_numpy(zero_copy_only=False), last)
            at, _, own = read(batch)
            c, b = batch.column("__chunk").to_numpy(zero_copy_only=False), batch.column(block)
            if last is not None and not on:
                yield closed(last[0], *held)
            first, x0, start = at[heads].copy(), own[heads].copy(), np.zeros((len(heads), n))
            begun = first.copy()
            if on:
                begun[0], x0[0], start[0] = held[1][0], held[3][0], held[4][0]
                first[0] = held[1][0] + held[2][0]
            state = np.hstack([_side_by_side(f, at, own, heads, first, start[:, part])[1] for f, part in parts])
            m = at[np.concatenate([heads[1:], [len(at)]]) - 1] - begun + 1
            if len(heads) > 1:
                yield closed(b.take(pa.array(heads[:-1])), c[heads[:-1]], begun[:-1], m[:-1], x0[:-1], state[:-1])
            last, held = here, (c[heads[-1:]], begun[-1:], m[-1:], x0[-1:], state[-1:])
        if last is not None:
            yield closed(last[0], *held)

    order = [tick, F.desc_nulls_last("__x"), *(F.desc_nulls_last(c) for c in keep)]
    stretches = rows.repartition(block, "__chunk").sortWithinPartitions(block, "__chunk", *order).mapInArrow(ends, f"{head}, first long, n long, x double, state array<double>")

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by block in order; one state is carried from each to the next, and over what lies between them."""
        here, begun, any_row = None, None, False
        for pdf in frames:
            starts = []
            for b, first, m, x0, s in zip(pdf[block], pdf["first"], pdf["n"], pdf["x"], pdf["state"], strict=True):
                if not any_row or b != here:
                    here, state, any_row = b, rest * x0, True
                else:
                    since, length, before, left = begun
                    state = np.linalg.matrix_power(whole_a, int(length)) @ before + left
                    state = np.linalg.matrix_power(whole_a, int(first - since - length)) @ state
                starts.append(state.tolist())
                begun = (first, m, state, np.asarray(s))
            yield pd.DataFrame({block: pdf[block], "__chunk": pdf["__chunk"], "start": starts})

    # a row a stretch: a few hundred for a block of a million ticks
    starts = stretches.repartition(block).sortWithinPartitions(block, "__chunk").mapInPandas(follow, f"{head}, start array<double>")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stretch's start comes before its rows; after a batch its last stretch goes on from `left`, at the tick `end` if any of its rows were there."""
        last, end, left = None, None, np.zeros(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, on, last = _heads(batch.column(block), batch.column("__chunk").to_numpy(zero_copy_only=False), last)
            given = np.array(batch.column("start").take(pa.array(heads[int(on) :])).to_pylist(), float).reshape(-1, n)
            start = np.concatenate([left[None], given]) if on else given
            since = end if on else None
            is_row = batch.column("__kind").to_numpy(zero_copy_only=False) == 1
            new = is_row & (fresh(batch, heads, on, None if since is None else since - 1) | np.concatenate([[False], ~is_row[:-1]]))
            of = (np.cumsum(np.isin(np.arange(batch.num_rows), heads)) - 1)[new]
            end, left = (since if on and len(heads) == 1 else None), start[-1]
            if not len(of):
                continue
            rows_here = batch.filter(pa.array(new))
            at, raw, own = read(rows_here)
            begun = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
            start, first = start[of[begun]], at[begun].copy()
            if of[0] == 0 and since is not None:
                first[0] = since
            outs, after = [], np.empty((len(begun), n))
            for f, part in parts:
                before, after[:, part] = _side_by_side(f, at, own, begun, first, start[:, part])
                outs.append(pa.array(np.where(np.isnan(raw), np.nan, before @ f.c + f.d * own), from_pandas=True))
            if of[-1] == len(heads) - 1:
                end, left = int(at[-1]) + 1, after[-1]
            yield pa.RecordBatch.from_arrays([*(rows_here.column(c) for c in (block, tick, *keep)), *outs], names=[block, tick, *keep, *filters])

    schema = ", ".join([f"`{block}` {kinds[block]}", f"`{tick}` long", *(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` double" for c in filters)])
    met = starts.select(block, "__chunk", F.lit(0).alias("__kind"), F.lit(0).cast("long").alias(tick), "start").unionByName(rows.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    return met.repartition(block, "__chunk").sortWithinPartitions(block, "__chunk", "__kind", *order).mapInArrow(whole, schema)


def filtered(df: DataFrame, f: Filter, block: str, tick: str, x: str, out: str, settled: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(block, tick, out): x through one filter, as filtered_by() has it."""
    return filtered_by(df, {out: f}, block, tick, x, settled, chunk)


def spectra(df: DataFrame, block: str, tick: str, x: str, y: str, length: int, rate_hz: float, windows: int = 64) -> DataFrame:
    """(block, bin, hz, n, pxx, pyy, pxy_re, pxy_im): sums of the windows' one-sided power and cross densities, and how many they are.

    Windows of `length` ticks (an even number) begin at every half of it; each loses its means and is tapered by a Hann window. A window with a missing tick or a null is left out.
    Sums of blocks add up.
    """
    half = length // 2
    number = F.floor(F.col(tick) / half)
    groups = F.array_distinct(F.array(F.floor(number / windows), F.floor((number - 1) / windows)))
    rows = df.select(block, F.col(tick).cast("long").alias("tick"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(groups).alias("group"))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    scale = 1 / (rate_hz * (taper**2).sum())
    kind = dict(df.dtypes)[block]

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * windows * half
        own = np.full((2, (windows + 1) * half), np.nan)
        at = pdf["tick"].to_numpy(np.int64) - first
        own[:, at] = pdf[["x", "y"]].to_numpy(float).T
        cut = np.lib.stride_tricks.sliding_window_view(own, length, axis=1)[:, ::half]
        cut = cut[:, ~np.isnan(cut).any(axis=(0, 2))]
        fx, fy = np.fft.rfft((cut - cut.mean(axis=2, keepdims=True)) * taper, axis=2)
        double = np.full(half + 1, 2.0)
        double[[0, -1]] = 1.0
        cross = (fx.conj() * fy).sum(axis=0)
        each = [np.abs(fx) ** 2, np.abs(fy) ** 2]
        return pd.DataFrame({block: key[0], "bin": np.arange(half + 1), "n": cut.shape[1], **{c: v * scale * double for c, v in zip(("pxx", "pyy", "pxy_re", "pxy_im"), (each[0].sum(axis=0), each[1].sum(axis=0), cross.real, cross.imag), strict=True)}})

    got = rows.groupBy(block, "group").applyInPandas(sums, f"`{block}` {kind}, bin int, n long, pxx double, pyy double, pxy_re double, pxy_im double")
    return got.groupBy(block, "bin").agg(*(F.sum(c).alias(c) for c in ("n", "pxx", "pyy", "pxy_re", "pxy_im"))).withColumn("hz", F.col("bin") * (rate_hz / length)).filter("n > 0")


def band_summaries(spectrum: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], rate_hz: float, length: int) -> DataFrame:
    """keys with, for each band from low to below high Hz: the power of x and y, the root of their ratio, and the mean coherence of the band's bins."""
    table = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in bands.items()))
    coherence = F.try_divide(F.col("pxy_re") ** 2 + F.col("pxy_im") ** 2, F.col("pxx") * F.col("pyy"))
    rows = spectrum.select("*", coherence.alias("coherence"), F.inline(table)).filter("hz >= lo and hz < hi")
    power = lambda c: F.sum(F.col(c) / F.col("n")) * (rate_hz / length)
    return rows.groupBy(*keys, "band").agg(power("pxx").alias("power_x"), power("pyy").alias("power_y"), F.sqrt(F.try_divide(F.sum("pyy"), F.sum("pxx"))).alias("ratio"), F.avg("coherence").alias("coherence"), F.max("n").alias("windows"))
