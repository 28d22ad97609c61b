"""Effects, filters, spectra and offsets against numpy and plain loops; joins with nulls."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivespan import registry
from drivespan.operators import panels as pn, recursive as rc, review as rv
from drivespan.operators.joins import overlap_join


def drawn(seed, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 2**32


def poisson(u):
    import math

    return sum(u >= sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


def dummies(a, b, x, y, w=None):
    m = np.column_stack([x, *[(a == i) * 1.0 for i in sorted(set(a))], *[(b == i) * 1.0 for i in sorted(set(b))]])
    r = np.sqrt(np.ones(len(x)) if w is None else w)
    return np.linalg.lstsq(m * r[:, None], y * r, rcond=None)[0][0]


def test_two_way_slope_on_chains(spark):
    """Cells that hang together in a chain, and two parts that don't hang together at all."""
    rng = np.random.default_rng(3)
    a, b = np.repeat(np.arange(30), 2), np.concatenate([[k, k + 1] for k in range(30)])
    a, b = np.concatenate([a, a, a[:20] + 100]), np.concatenate([b, b, b[:20] % 4 + 100])
    x = rng.normal(size=len(a)) + a * 0.3
    y = 2.0 * x + np.sin(a) * 5 - b * 1.5 + rng.normal(size=len(a))
    df = spark.createDataFrame([(int(p), int(q), float(u), float(v)) for p, q, u, v in zip(a, b, x, y, strict=True)] + [(None, 1, 1.0, 1.0), (1, 1, None, 2.0), (1, 1, float("nan"), 2.0)], "a long, b long, x double, y double")
    got = pn.two_way_slope(df, "a", "b", "x", "y").first()
    assert got.n == len(a) and abs(got.slope - dummies(a, b, x, y)) < 1e-6
    assert pn.two_way_slope(df.withColumn("x", F.col("a") * 2.0), "a", "b", "x", "y").first().slope is None


def test_two_way_bootstrap(spark):
    rng = np.random.default_rng(4)
    a, b, x = rng.integers(0, 12, 150), rng.integers(0, 6, 150), rng.normal(size=150)
    y = 1.2 * x + a - b + rng.normal(size=150)
    df = spark.createDataFrame([(int(p), int(q), float(u), float(v)) for p, q, u, v in zip(a, b, x, y, strict=True)], "a long, b long, x double, y double")
    got = pn.two_way_bootstrap(df, "a", "b", "x", "y", 6, 5).first()
    slopes = [dummies(a, b, x, y, np.array([poisson(drawn(5, r, k)) for k in a], float)) for r in range(1, 7)]
    assert abs(got.slope - dummies(a, b, x, y)) < 1e-6 and got.replicates == 6
    assert np.allclose([got.low, got.high], np.percentile(slopes, [2.5, 97.5]), atol=1e-6)


@pytest.mark.parametrize("few", [0, 64])
def test_few_levels_need_no_rounds(spark, monkeypatch, few):
    """Levels that hang together in two groups, and one level by itself, solved at once and in rounds: the same fitted values."""
    rng = np.random.default_rng(9)
    rows = [(int(a), f"p{a % 2 * 4 + rng.integers(0, 4)}", float(rng.normal()), float(rng.normal())) for a in rng.integers(0, 30, 300)] + [(99, "alone", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a long, b string, x double, y double")
    table = pn.checkpointed(pn.cells(df, "a", "b", ["x", "y"]).unionByName(pn.cells(df.filter("a % 3 > 0"), "a", "b", ["x", "y"]).withColumn("part", F.lit(1))))
    monkeypatch.setattr(pn, "FEW_LEVELS", few)
    got = pn.effects(table, ["x", "y"], most_rounds=0 if few else 1000).collect()
    for part, mine in ((0, rows), (1, [r for r in rows if r[0] % 3])):
        levels = [sorted({r[k] for r in mine}) for k in (0, 1)]
        d = np.array([[r[0] == v for v in levels[0]] + [r[1] == v for v in levels[1]] for r in mine], float)
        fit = d @ np.linalg.lstsq(d, np.array([r[2:] for r in mine]), rcond=None)[0]
        want = {r[:2]: f for r, f in zip(mine, fit, strict=True)}
        assert all(np.allclose([r.f_x, r.f_y], want[r.a, r.b], atol=1e-7) for r in got if r.part == part) and sum(r.part == part for r in got) == len(want)


def test_queries_over_whole_tables(spark, sf_dir):
    """The interval's every replicate by dummies, and the offsets of every drive by the operator on its rows one drive at a time."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.col("l_partkey") % 40, "l_quantity", "l_extendedprice").toPandas().to_numpy(float)
    a, b, x, y = rows.T
    a, b = a.astype(int), b.astype(int)
    got = registry.QUERIES["two_way_interval"](spark, sf_dir).first()
    slopes = [dummies(a, b, x, y, np.array([poisson(drawn(7, r, k)) for k in a], float)) for r in range(1, 13)]
    assert np.allclose([got.slope, got.low, got.high], [dummies(a, b, x, y), *np.percentile(slopes, [2.5, 97.5])], rtol=1e-6) and got.n == len(a)
    from drivespan.plans.base import ticks

    w = ticks(spark, sf_dir).groupBy("drive", F.floor(F.col("tick") / 10).alias("win")).agg(F.avg("yaw_dps").alias("off"), (F.sum("yaw_dps") * 3.0).alias("heading"))
    out = {r.drive: r for r in registry.QUERIES["direction_offsets"](spark, sf_dir).collect()}
    for d, r in list(out.items())[:2]:
        one = pn.direction_offsets(w.filter(F.col("drive") == d), "drive", ["win"], "off", "heading", 40, 11).first()
        assert np.allclose([one[c] for c in ("offset", "low", "high", "amplitude", "p")], [r[c] for c in ("offset", "low", "high", "amplitude", "p")])


def sequential(f, x):
    s, out = np.zeros(len(f.b)), []
    for v in x:
        out.append(f.c @ s + f.d * v)
        s = f.a @ s + f.b * v
    return np.array(out)


def test_recursive_filters_over_stretches(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=3000)
    f = rc.weighting("Wk", 100.0)
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(x)] + [(1, 7, 2.0), (1, 900, None), (1, 905, 1.0)], "block long, tick long, x double")
    got = {(r.block, r.tick): r.y for r in rc.filtered(df, f, "block", "tick", "x", "y", chunk=128).collect()}
    assert np.allclose([got[0, k] for k in range(3000)], sequential(f, x), atol=1e-9)
    other = np.zeros(899)
    other[[0, 898]] = 2.0, 1.0
    assert got[1, 900] is None and abs(got[1, 905] - sequential(f, other)[-1]) < 1e-9
    lag = rc.first_order(0.5, 100.0)
    got = {r.tick: r.y for r in rc.filtered(df.filter("block = 0"), lag, "block", "tick", "x", "y", settled=True, chunk=64).collect()}
    want = [x[0]]
    for v in x[1:]:
        want.append(want[-1] + (v - want[-1]) * 0.01 / 0.51)
    assert np.allclose([got[k] for k in range(3000)], want, atol=1e-9)
    assert rc.filtered(df.limit(0), lag, "block", "tick", "x", "y").count() == 0


def test_a_drive_of_a_million_rows(spark):
    df = spark.range(1_000_000, numPartitions=8).selectExpr("'d' as block", "id as tick", "sin(id / 37.0) + pmod(id * 7919, 101) / 50.0 as x")
    out = rc.filtered(df, rc.first_order(2.0, 100.0), "block", "tick", "x", "y", settled=True).filter("tick % 100000 = 99999").orderBy("tick").collect()
    k = np.arange(1_000_000)
    x = np.sin(k / 37.0) + (k * 7919 % 101) / 50.0
    share, y, want = 0.01 / 2.01, x[0], []
    for i, v in enumerate(x.tolist()):
        y += (v - y) * share
        if i % 100000 == 99999:
            want.append(y)
    assert np.allclose([r.y for r in out], want, atol=1e-9)


@pytest.mark.parametrize(("name", "table"), [("Wk", {0.5: 418, 1.0: 482, 2.0: 531, 4.0: 967, 8.0: 1036, 16.0: 768}), ("Wd", {0.5: 853, 1.0: 1011, 2.0: 890, 4.0: 512, 8.0: 253, 16.0: 125})])
def test_weightings_have_the_standards_gains(name, table):
    f = rc.weighting(name, 2000.0)
    assert np.allclose([rc.gain(f, hz, 2000.0) * 1000 for hz in table], list(table.values()), rtol=0.01)


def test_weighted_query(spark, sf_dir):
    from drivespan.plans.base import ticks

    rows = ticks(spark, sf_dir).orderBy("drive", "tick").select("drive", "tick", "ax_mps2").collect()
    got = {(r.drive, r.tick): r.weighted for r in registry.QUERIES["whole_body_weighting"](spark, sf_dir).collect()}
    drive = rows[0].drive
    own = [r for r in rows if r.drive == drive]
    want = sequential(rc.weighting("Wk", 20.0), [r.ax_mps2 or 0.0 for r in own])
    assert len(got) == len(rows)
    assert all(got[drive, r.tick] is None if r.ax_mps2 is None else abs(got[drive, r.tick] - w) < 1e-9 for r, w in zip(own, want, strict=True))


def test_spectra_against_a_plain_welch(spark):
    rng = np.random.default_rng(9)
    n, length = 1500, 32
    x = rng.normal(size=n)
    y = np.convolve(x, [0.5, 0.3, 0.2], mode="same") + rng.normal(size=n) * 0.3
    y[400] = np.nan
    gone = set(range(900, 905))
    df = spark.createDataFrame([(1, k, float(x[k]), float(y[k])) for k in range(n) if k not in gone], "b long, t long, x double, y double")
    got = sorted(rc.spectra(df, "b", "t", "x", "y", length, 50.0, windows=7).collect(), key=lambda r: r.bin)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    pxx, pyy, pxy, m = 0, 0, 0, 0
    for a in range(0, n - length + 1, length // 2):
        u, v = x[a : a + length], y[a : a + length]
        if np.isnan(v).any() or gone & set(range(a, a + length)):
            continue
        fu, fv = np.fft.rfft((u - u.mean()) * taper), np.fft.rfft((v - v.mean()) * taper)
        pxx, pyy, pxy, m = pxx + abs(fu) ** 2, pyy + abs(fv) ** 2, pxy + fu.conj() * fv, m + 1
    double = np.full(length // 2 + 1, 2.0)
    double[[0, -1]] = 1
    scale = double / (50.0 * (taper**2).sum())
    assert got[0].n == m and [r.hz for r in got] == [k * 50.0 / length for k in range(length // 2 + 1)]
    for name, want in (("pxx", pxx * scale), ("pyy", pyy * scale), ("pxy_re", pxy.real * scale), ("pxy_im", pxy.imag * scale)):
        assert np.allclose([r[name] for r in got], want)


def test_direction_offsets_against_a_loop(spark):
    rng = np.random.default_rng(10)
    rows = [(d, k, float(np.cos(np.radians(h)) * d + rng.normal() * 0.5), float(h)) for d in range(3) for k, h in enumerate(rng.uniform(0, 360, 4 + 9 * d))]
    df = spark.createDataFrame(rows, "drive long, win long, off double, heading double")
    got = {r.drive: r for r in pn.direction_offsets(df, "drive", ["win"], "off", "heading", 30, 3).collect()}
    assert set(got) == {1, 2}
    for d in (1, 2):
        own = [r for r in rows if r[0] == d]
        off, h = np.array([r[2] for r in own]), np.radians([r[3] for r in own])
        m = np.column_stack([np.ones(len(h)), np.sin(h), np.cos(h)])
        amp = lambda y: float(np.hypot(*np.linalg.lstsq(m, y, rcond=None)[0][1:]))  # noqa: B023, E731
        base = amp(off)
        hits = sum(amp(np.roll(off, -(1 + int(drawn(3, "shift", r, d) * (len(off) - 1))))) >= base - 1e-12 for r in range(1, 31))
        medians = []
        for r in range(1, 31):
            w = np.repeat(off, [poisson(drawn(3, "boot", r, d, i)) for i in range(len(off))])
            medians.append(np.median(w))
        want = (np.median(off), *np.percentile(medians, [2.5, 97.5]), base, (hits + 1) / 31)
        assert np.allclose([got[d][c] for c in ("offset", "low", "high", "amplitude", "p")], want)


def test_overlaps_of_rows_with_nulls(spark):
    a = spark.createDataFrame([(1, "x", 0.0, 5.0, None), (1, "x", 0.0, 5.0, None), (1, "y", 20.0, 21.0, None), (1, "z", 0.0, 9.0, "n"), (1, "w", None, 9.0, None), (None, "v", 0.0, 1.0, None)], "drive long, id string, a_start double, a_end double, note string")
    b = spark.createDataFrame([(1, 4.0, 6.0), (1, 100.0, 101.0)], "drive long, b_start double, b_end double")
    ids = lambda how: sorted(r.id for r in overlap_join(a, b, "drive", 2.0, how).collect())
    assert ids("inner") == ids("left_semi") == ["x", "x", "z"]
    assert ids("left_anti") == ["v", "w", "y"] and ids("left") == ["v", "w", "x", "x", "y", "z"]
    sheet = a.filter("id in ('x', 'y', 'z')").withColumn("verdict", F.lit("Yes "))
    taken, rejected = rv.import_sheet(sheet, b, "drive", 2.0)
    assert [r.id for r in taken.collect()] == ["y"] and rejected.count() == 0
