"""Points that pass by places in order: the same answers as plain loops, and no pair of points is shuffled."""

import math

import numpy as np
import pytest

from drivespan.operators import joins, passages as ps, sites as st


def shuffled(spark, job):
    """(what the job gives, the records its stages shuffled)."""
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    out = job()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, written() - before


def passes(sites, ticks, radius, gap):
    out = []
    for site, x, y in sites:
        for drive in {k[0] for k in ticks}:
            near = sorted((k[1], math.sqrt((k[2] - x) ** 2 + (k[3] - y) ** 2)) for k in ticks if k[0] == drive and math.sqrt((k[2] - x) ** 2 + (k[3] - y) ** 2) <= radius)
            parts = []
            for k, (t, d) in enumerate(near):
                if not k or t - near[k - 1][0] > gap:
                    parts.append([])
                parts[-1].append((t, d))
            out += [(site, drive, k, p[0][0], p[-1][0], min((d, t) for t, d in p)[1], min(d for _, d in p)) for k, p in enumerate(parts)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("slot", "tile", "batch"), [(2048, 1 << 20, 10000), (7, 60, 13), (3, 1, 1)])
def test_passes(spark, monkeypatch, slot, tile, batch):
    monkeypatch.setattr(joins, "STREAM_SLOT", slot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = np.random.default_rng(3)
        sites = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 60, (40, 2)))]
        ticks = [(None if d == 4 else int(d), float(t), float(x), float(y)) for d, t, x, y in zip(rng.integers(0, 5, 400), rng.integers(0, 300, 400), rng.integers(0, 60, 400), rng.integers(0, 60, 400), strict=True)]
        got = st.site_passes(spark.createDataFrame(sites, "site long, x double, y double"), spark.createDataFrame(ticks, "drive int, t double, x double, y double"), "x", "y", 10.0, "drive", "t", 12.0, tile)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == passes(sites, ticks, 10.0, 12.0)
        twice = [*sites, (3, 50.0, 50.0)]  # a site of two places has the passes over either
        got = st.site_passes(spark.createDataFrame(twice, "site long, x double, y double"), spark.createDataFrame(ticks, "drive int, t double, x double, y double"), "x", "y", 10.0, "drive", "t", 1e9, tile)
        both = [r for r in got.collect() if r.site == 3]
        assert len(both) == len({r.drive for r in both}) and {r["pass"] for r in both} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passes_shuffle_points_and_no_pairs(spark):
    rng = np.random.default_rng(6)
    n = 1500
    rows = [(k, k % 3, 60.0 * k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 40, (n, 2)))]
    p = spark.createDataFrame(rows, "site long, drive int, t double, x double, y double")
    count, records = shuffled(spark, lambda: st.site_passes(p.select("site", "x", "y"), p.select("drive", "t", "x", "y"), "x", "y", 30.0, "drive", "t", 0.0).count())
    assert count > 500 * n and records < 60 * n


@pytest.mark.parametrize(("slot", "tile", "batch"), [(2048, 1 << 20, 10000), (7, 60, 13), (3, 1, 1)])
def test_medians_of_other_drives(spark, monkeypatch, slot, tile, batch):
    monkeypatch.setattr(joins, "STREAM_SLOT", slot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = np.random.default_rng(5)
    rows = [(k, None if d == 6 else f"d{d}", float(x), float(y), None if h < 5 else float(h), None if v == 3 else float(v)) for k, (d, x, y, h, v) in enumerate(zip(rng.integers(0, 7, 160), rng.integers(0, 40, 160), rng.integers(0, 40, 160), 10 * rng.integers(0, 36, 160), rng.integers(0, 60, 160), strict=True))]
    rows += [(200, "d1", 5.0, 5.0, 40.0, 8.0), (200, "d1", 30.0, 30.0, 40.0, 9.0)]  # an id of two places has what lies about either
    try:
        df = spark.createDataFrame(rows, "id long, drive string, x double, y double, hdg double, v double")
        got = {r.id: (r.drives, r.baseline) for r in ps.same_place_baseline(df, "x", "y", "hdg", "drive", "v", 10.0, 50.0, 2, tile).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for p in {r[0] for r in rows}:
        by = {}
        for a in (r for r in rows if r[0] == p):
            for b in rows:
                if None not in (a[1], b[1], a[4], b[4], b[5]) and a[1] != b[1] and math.dist(a[2:4], b[2:4]) <= 10 and min((a[4] - b[4]) % 360, (b[4] - a[4]) % 360) <= 50:
                    by.setdefault(b[1], []).append(b[5])
        if len(by) >= 2:
            want[p] = (len(by), float(np.median([np.median(v) for v in by.values()])))
    assert got == want and len(want) > 80


def test_medians_shuffle_points_and_no_pairs(spark):
    rng = np.random.default_rng(7)
    n = 1500
    rows = [(k, k % 400, float(x), float(y), 10.0, float(v)) for k, (x, y, v) in enumerate(zip(rng.uniform(0, 20, n), rng.uniform(0, 20, n), rng.integers(0, 9, n), strict=True))]
    df = spark.createDataFrame(rows, "id long, drive long, x double, y double, hdg double, v double")
    count, records = shuffled(spark, lambda: ps.same_place_baseline(df, "x", "y", "hdg", "drive", "v", 30.0, 50.0).count())
    assert count == n and records < 60 * n
