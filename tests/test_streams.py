"""Streams over files that come out of order against the same rows at once."""

import datetime as dt

from pyspark.sql import functions as F

from drivespan.streaming import jobs

START = dt.datetime(2024, 5, 1)


def files(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame([(d, v, START + dt.timedelta(seconds=s)) for d, v, s in rows], "device long, drive long, ts timestamp").coalesce(1).write.parquet(f"{folder}/{k:03d}")
    schema = spark.read.parquet(f"{folder}/000").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_drives_complete_when_the_next_one_starts(spark, tmp_path):
    rows = [(d, d * 100 + v, v * 1000 + s * 60 + d) for d in range(4) for v in range(5) for s in range(6 + (d + v) % 3)]
    order = sorted(rows, key=lambda r: r[2] + r[2] * 7919 % 301)  # up to five minutes out of order
    parts = [order[k : k + 20] for k in range(0, len(order), 20)]
    stream = files(spark, tmp_path / "in", parts)
    out, state = jobs.run_with_state(jobs.drives_by_next(stream, "device", "drive", "ts", "10 minutes"), "append")
    early, left = out.collect(), jobs.last_drives(spark, state).collect()
    want = {}
    for d, v, s in rows:
        a, b, n = want.get((d, v), (s, s, 0))
        want[d, v] = (min(a, s), max(b, s), n + 1)
    zero = START.replace(tzinfo=dt.UTC).timestamp()
    found = {(r.device, r.drive): (round(r.t_start - zero), round(r.t_end - zero), r.segments) for r in early + left}
    assert found == want and len(early) + len(left) == len(want)
    assert len(early) >= 8 and {(d, d * 100 + 4) for d in range(4)} <= {(r.device, r.drive) for r in left}


def test_last_drives_of_nothing(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [[(1, 1, 0)], [(1, 1, 60)]])
    got = jobs.run_all_drives(stream, "device", "drive", "ts", "1 minute").select("device", "drive", "segments", F.round(F.col("t_end") - F.col("t_start")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 60.0)]


def test_a_device_with_very_many_drives_waiting():
    """What is complete takes one search for each drive, not one look at each pair."""
    import time

    from drivespan.streaming.jobs import _complete

    n, began = 100_000, time.time()
    done, wait = _complete({k: [10.0 * k, 10.0 * k + 5, 1] for k in range(n)}, 10.0 * (n - 5))
    assert done == list(range(n - 5)) and wait == 10.0 * (n - 4) and time.time() - began < 10
    assert _complete({7: [0.0, 5.0, 2]}, 100.0) == ([], None) and _complete({}, 0.0) == ([], None)
