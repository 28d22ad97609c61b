"""Streaming forms: window extremes with late data, candidate sessions, debounced alarms, and drives flushed when complete."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from drivespan.sources.scratch import scratch_dir


def event_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of the tables called `name` in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_extremes(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, late: str) -> DataFrame:
    """keys and tumbling window with min, max and count; rows later than `late` behind the newest are ignored."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(*keys, w.alias("win")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).select(*keys, F.col("win.start").alias("win_start"), "lo", "hi", "n")


def candidate_sessions(stream: DataFrame, key: str, ts: str, duration_s: Column, pad_s: float, gap_s: float, late: str) -> DataFrame:
    """Padded events merged into sessions: each stays open for its duration, twice the padding and the merge gap. Like the batch merge, but for gaps of exactly gap_s."""
    open_for = (duration_s + F.lit(2 * pad_s + gap_s)).cast("string")
    s = F.session_window(ts, F.concat(open_for, F.lit(" seconds")))
    return stream.withWatermark(ts, late).groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def debounced(stream: DataFrame, key: str, order: str, alarm: str, k: int) -> DataFrame:
    """(key, first, confirmed) whenever a key reaches k consecutive alarm states; the count is kept from batch to batch."""

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first = state.get if state.exists else (0, 0.0)
        out = []
        for pdf in [pd.concat(list(batches)).sort_values(order)]:
            for t, a in zip(pdf[order].tolist(), pdf[alarm].tolist(), strict=True):
                n, first = (n + 1, first if n else t) if a else (0, 0.0)
                if n == k:
                    out.append((who[0], first, t))
        state.update((n, first))
        yield pd.DataFrame(out, columns=[key, "first", "confirmed"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, first double, confirmed double", "n int, first double", "append", GroupStateTimeout.NoTimeout)


def completed_drives(stream: DataFrame, key: str, ts: str, pause: str, late: str) -> DataFrame:
    """(key, start, end, segments): a drive's segments once it has paused for `pause`, when the watermark has passed it."""
    s = F.session_window(ts, pause)
    return stream.withWatermark(ts, late).groupBy(key, s.alias("s")).agg(F.count("*").alias("segments")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "segments")


#: What is kept of a device's drives that are not complete.
PENDING = "drives array<long>, firsts array<double>, lasts array<double>, segments array<long>"
DRIVES = "device long, drive long, t_start double, t_end double, segments long"


def _complete(held: dict[int, list], now: float) -> tuple[list[int], float | None]:
    """The drives (first, last, segments by drive) whose next one has begun by `now`, and when the earliest next one of the others begins."""
    starts = sorted(a for a, _, _ in held.values())
    at = {d: bisect.bisect_right(starts, b) for d, (_, b, _) in held.items()}
    follows = {d: starts[k] for d, k in at.items() if k < len(starts)}
    return sorted(d for d, s in follows.items() if s <= now), min((s for s in follows.values() if s > now), default=None)


def drives_by_next(stream: DataFrame, device: str, drive: str, ts: str, late: str) -> DataFrame:
    """(device, drive, t_start, t_end, segments) of each drive once its device's next one has begun and rows from before that can no longer come.

    A device's drives must not interleave. Rows may come in any order within `late` of the newest; their drives are kept as four numbers each until an event-time timer, set to
    the next drive's begin, lets them go. A device's last drive has no next one: last_drives() gives what is left. A device costs few frames, as there may be very many with few rows.
    """

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {d: [a, b, n] for d, a, b, n in zip(*state.get, strict=True)} if state.exists else {}
        for pdf in batches:
            if not len(pdf):
                continue
            drives, t = pdf["drive"].to_numpy(), pdf["t"].to_numpy()
            order = np.argsort(drives, kind="stable")
            drives, t = drives[order], t[order]
            at = np.flatnonzero(np.r_[True, drives[1:] != drives[:-1]])
            for d, lo, hi, k in zip(drives[at].tolist(), np.minimum.reduceat(t, at).tolist(), np.maximum.reduceat(t, at).tolist(), np.diff(np.r_[at, len(t)]).tolist(), strict=True):
                a, b, n = held.get(d, (lo, hi, 0))
                held[d] = [min(a, lo), max(b, hi), n + k]
        done, wait = _complete(held, state.getCurrentWatermarkMs() / 1000)
        gone = [(d, *held.pop(d)) for d in done]
        state.update(tuple(list(x) for x in zip(*((d, *v) for d, v in sorted(held.items())), strict=True)) or ([], [], [], []))
        if wait is not None:
            state.setTimeoutTimestamp(int(wait * 1000) + 1)
        if gone:
            d, a, b, n = (np.array(x) for x in zip(*gone, strict=True))
            yield pd.DataFrame({"device": np.full(len(d), who[0], np.int64), "drive": d.astype(np.int64), "t_start": a, "t_end": b, "segments": n.astype(np.int64)})

    rows = stream.withWatermark(ts, late).select(F.col(device).cast("long").alias("device"), F.col(drive).cast("long").alias("drive"), F.col(ts), (F.unix_micros(ts) / 1e6).alias("t"))
    return rows.groupBy("device").applyInPandasWithState(step, DRIVES, PENDING, "append", GroupStateTimeout.EventTimeTimeout)


def last_drives(spark: SparkSession, state: str) -> DataFrame:
    """The drives that a stopped drives_by_next() still holds, from its state under the checkpoint folder."""
    held = spark.read.format("statestore").load(state).select(F.col("key.device").alias("device"), "value.groupState.*")
    each = F.arrays_zip(F.col("drives").alias("drive"), F.col("firsts").alias("t_start"), F.col("lasts").alias("t_end"), "segments")
    return held.select("device", F.inline(each)).toDF("device", "drive", "t_start", "t_end", "segments")


def run_all_drives(stream: DataFrame, device: str, drive: str, ts: str, late: str) -> DataFrame:
    """drives_by_next() over what is there now, and a last flush of what it still holds."""
    out, state = run_with_state(drives_by_next(stream, device, drive, ts, late), "append")
    return out.unionByName(last_drives(stream.sparkSession, state))


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives its result table; complete results replace each other, appended ones add up."""
    return run_with_state(stream, mode)[0]


def run_with_state(stream: DataFrame, mode: str) -> tuple[DataFrame, str]:
    """As run_to_table(), with the folder of the stream's state."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = "overwrite" if mode == "complete" else "append"

    def put(df: DataFrame, _: int) -> None:
        df.write.mode(write).parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), f"{base}/state"
