"""Operators that SQL can't express, against plain loops; and the metamorphic cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivespan.functions import vehicle as vf
from drivespan.operators import decode as dc, evaluation as ev, features as ft, islands, quality as ql, rules as ru, sites as st, stats as ss, timegrid as tg, panels as pn
from drivespan.operators.joins import near_pairs

DT = 0.05


def series(spark, values, block=1, name="x"):
    return spark.createDataFrame([(block, i, i * DT, None if v is None else float(v)) for i, v in enumerate(values)], f"drive long, tick long, t double, {name} double")


def loop_lobes(t, x, enter, gap):
    sig = [0 if v is None or abs(v) <= enter else math.copysign(1, v) for v in x]
    out, i = [], 0
    while i < len(sig):
        if sig[i] == 0:
            i += 1
            continue
        j = i
        while j + 1 < len(sig):
            if sig[j + 1] == sig[i]:
                j += 1
            elif sig[j + 1] == 0:
                k = j + 1
                while k < len(sig) and sig[k] == 0 and t[k] - t[j] <= gap:
                    k += 1
                if k < len(sig) and sig[k] == sig[i]:
                    j = k
                else:
                    break
            else:
                break
        y = [v or 0.0 for v in x[i : j + 1]]
        out.append((round(t[i], 6), round(t[j], 6), round(sum((a + b) / 2 * DT for a, b in zip(y, y[1:])), 6)))
        i = j + 1
    return out


def test_lobes(spark):
    rng = np.random.default_rng(0)
    for seed in range(3):
        x = [None if rng.random() < 0.05 else float(v) for v in np.cumsum(rng.normal(size=200)) / 2]
        want = loop_lobes([i * DT for i in range(200)], x, 1.0, 0.12)
        got = islands.lobes(series(spark, x), "x", "drive", "t", 1.0, 0.12).orderBy("t_start").collect()
        assert [(round(r.t_start, 6), round(r.t_end, 6), round(r.area, 6)) for r in got] == want


def test_spaced_peaks(spark):
    rng = np.random.default_rng(1)
    pts = [(int(k), float(t), float(s)) for k, t, s in zip(rng.integers(0, 3, 200), rng.random(200) * 300, rng.integers(0, 50, 200))]
    want = set()
    for k in range(3):
        kept = []
        for _, t, s in sorted((p for p in pts if p[0] == k), key=lambda p: (-p[2], p[1])):
            if all(abs(t - u) > 5 for u in kept):
                kept.append(t)
        want |= {(k, t) for t in kept}
    got = islands.spaced_peaks(spark.createDataFrame(pts, "drive long, t double, s double"), "drive", "t", "s", 5.0)
    assert {(r.drive, r.t) for r in got.collect()} == want


def test_sequence_is_greedy_and_uses_each_second_once(spark):
    rng = np.random.default_rng(2)
    ev_ = [(int(d), k, float(t), float(t) + float(w)) for d, k, t, w in zip(rng.integers(0, 3, 150), rng.choice(["a", "b", "c"], 150), rng.random(150) * 200, rng.random(150) * 3)]
    rule = {"op": "sequence", "first": "a", "then": ["b", "c"], "min_gap_s": 0.0, "max_gap_s": 4.0}
    want = []
    for d in range(3):
        firsts = sorted((e for e in ev_ if e[0] == d and e[1] == "a"), key=lambda e: e[2])
        thens = sorted((e for e in ev_ if e[0] == d and e[1] in "bc"), key=lambda e: e[2])
        used = set()
        for a in firsts:
            for k, b in enumerate(thens):
                if k not in used and 0 <= b[2] - a[3] <= 4:
                    used.add(k)
                    want.append((d, round(a[2], 6), round(b[3], 6)))
                    break
    df = spark.createDataFrame(ev_, "drive long, event_type string, t_start double, t_end double")
    got = ru.sequence(df, {"s": rule}, "drive").collect()
    assert sorted((r.drive, round(r.t_start, 6), round(r.t_end, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("samples, n", [([-5] * 2, 0), ([-5] * 20, 1), ([-5] * 8 + [0] * 4 + [-5] * 8, 1), ([-5] * 8 + [0] * 40 + [-5] * 8, 2), ([None] * 20, 0)])
def test_threshold_rule_cases(spark, samples, n):
    rule = {"hit": {"feature": "x", "op": "lt", "threshold": -3.0, "min_duration_s": 0.3, "merge_gap_s": 1.0}}
    assert ru.detect(series(spark, [0] * 5 + samples + [0] * 5), rule).count() == n


def test_rising_needs_an_edge_and_a_missing_gate_blocks(spark):
    df = series(spark, [1, 1, 0, 0, 1, 1, 1, 0])
    got = ru.detect(df, {"r": {"feature": "x", "op": "rising", "threshold": 0.5}}).collect()
    assert [(round(r.t_start, 3), round(r.t_end, 3)) for r in got] == [(0.2, 0.3)]
    assert ru.detect(df, {"r": {"feature": "x", "op": "gt", "threshold": 0.5, "gate": [{"feature": "no", "op": "gt", "threshold": 0}]}}).count() == 0
    assert ru.skipped(df.columns, {"m": {"feature": "no", "op": "gt", "threshold": 1}, "c": {"op": "cooccurrence", "base": "m", "require_any": ["zz"]}, "s": {"feature": "x", "op": "gt", "threshold": 1, "stage": 3}}) == [("m", "missing_feature:no"), ("c", "unknown_event:zz"), ("s", "stage")]


def test_signed_peak_takes_the_first_of_equals(spark):
    got = ru.detect(series(spark, [0, 4, -6, 6, 0]), {"r": {"feature": "x", "op": "abs_gt", "threshold": 3.0}}).collect()
    assert len(got) == 1 and got[0].peak_value == -6 and got[0].exceedance == 3


def test_lane_change_and_steady_curve(spark):
    t = np.arange(400) * DT
    swing = np.where((t > 8) & (t < 10), 4 * np.sin(np.pi * (t - 8)), 0.0)
    curve = np.where(t > 8, 6.0, 0.0)
    for yaw, n in ((swing, 1), (curve, 0)):
        df = series(spark, yaw, name="yaw_dps").withColumn("v_mps", F.lit(20.0))
        dev = ft.yaw_deviation(df, "drive", "tick", 201)
        assert ft.lane_changes(dev, "drive", "t", DT, enter=1.0, durations=(0.5, 8.0), offsets=(0.2, 6.0)).count() == n


def test_greedy_sites_and_stretches(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y), float(h), float(s)) for i, (x, y, h, s) in enumerate(zip(rng.random(150) * 200, rng.random(150) * 200, rng.integers(0, 2, 150) * 180, rng.integers(0, 40, 150)))]
    df = spark.createDataFrame(pts, "id long, x double, y double, hdg double, s double")
    site = {}
    for p in sorted(pts, key=lambda p: (-p[4], p[0])):
        if p[0] in site:
            continue
        for q in pts:
            if q[0] not in site and math.hypot(p[1] - q[1], p[2] - q[2]) <= 25 and abs(p[3] - q[3]) <= 30:
                site[q[0]] = p[0]
    assert {r.id: r.site for r in st.assign_sites(df, "x", "y", "hdg", "s", 25.0, 30.0).collect()} == site
    up = list(range(150))
    find = lambda i: i if up[i] == i else find(up[i])
    for p in pts:
        for q in pts:
            if math.hypot(p[1] - q[1], p[2] - q[2]) <= 12 and abs(p[3] - q[3]) <= 30:
                a, b = find(p[0]), find(q[0])
                up[max(a, b)] = min(a, b)
    got = {r.site: r.stretch for r in st.stretches(df.withColumnRenamed("id", "site"), "x", "y", "hdg", 12.0, 30.0).collect()}
    assert got == {i: find(i) for i in range(150)}


def test_filters_against_convolution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=120)
    taps = tg.bandpass_taps(1.0, 3.0, 20.0, 10)
    got = [r.y for r in series(spark, x).select("tick", tg.fir(F.col("x"), "drive", "tick", taps).alias("y")).orderBy("tick").collect()]
    want = np.convolve(x, taps, mode="valid")
    assert all(v is None for v in got[:10] + got[-10:]) and np.allclose(got[10:-10], want)
    lag = [r.y for r in series(spark, np.ones(60)).select("tick", tg.first_order_lag(F.col("x"), "drive", "tick", 4.0, 20).alias("y")).orderBy("tick").collect()]
    assert lag[:19] == [None] * 19 and np.allclose(lag[19:], 1.0)


def test_two_way_effects_against_dummies(spark):
    rng = np.random.default_rng(6)
    a, b, x = rng.integers(0, 6, 300), rng.integers(0, 5, 300), rng.normal(size=300)
    y = 1.7 * x + a * 2.0 - b + rng.normal(size=300) * 0.1
    m = np.column_stack([x, *[(a == i) * 1.0 for i in range(6)], *[(b == i) * 1.0 for i in range(1, 5)]])
    want = np.linalg.lstsq(m, y, rcond=None)[0][0]
    df = spark.createDataFrame([(int(p), int(q), float(u), float(v)) for p, q, u, v in zip(a, b, x, y)], "a long, b long, x double, y double")
    assert abs(pn.two_way_slope(df, "a", "b", "x", "y").first().slope - want) < 1e-6
    three = ss.fit_with_r2(df.withColumn("one", F.lit(1.0)).withColumn("k", F.lit(0)), ["k"], ["one", "x", "a"], "y").first()
    assert np.allclose([three.b_0, three.b_1, three.b_2], np.linalg.lstsq(np.column_stack([np.ones(300), x, a]), y, rcond=None)[0])


def test_permutation_and_bootstrap(spark):
    rng = np.random.default_rng(7)
    rows = [(s, d, float(x), float(2 * x + rng.normal() * 0.1), float(rng.normal())) for s in range(20) for d, x in enumerate(rng.normal(size=8))]
    df = spark.createDataFrame(rows, "site long, drive long, x double, y double, z double")
    hit, miss = ss.pooled_permutation(df, "site", "drive", "x", "y", 99, 1).first(), ss.pooled_permutation(df, "site", "drive", "x", "z", 99, 1).first()
    assert abs(hit.slope - 2) < 0.1 and hit.p <= 0.02 < miss.p
    a, b = ev.bootstrap(df, "drive", "x", 200, 3).first(), ev.bootstrap(df, "drive", "x", 200, 3).first()
    assert a == b and a.low <= a.mean <= a.high


def test_fisher_and_binomial(spark):
    from math import comb

    for a, b, c, d in ((3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0)):
        p = lambda x: comb(a + b, x) * comb(c + d, a + c - x) / comb(a + b + c + d, a + c)
        want = sum(p(x) for x in range(max(0, a - d), min(a + b, a + c) + 1) if p(x) <= p(a) * (1 + 1e-7))
        got = spark.range(1).select(vf.fisher_exact(*(F.lit(v) for v in (a, b, c, d))).alias("p")).first().p
        assert abs(got - want) < 1e-6
    got = spark.range(1).select(vf.log_binomial_tail(F.lit(7), F.lit(10), F.lit(0.3)).alias("p")).first().p
    assert abs(got + math.log10(sum(comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(7, 11)))) < 1e-6


def test_bit_fields_against_integers(spark):
    rng = np.random.default_rng(8)
    words = [int(w) for w in rng.integers(0, 1 << 62, 40)] + [(1 << 64) - 1, 0]
    for order in ("big", "little"):
        df = spark.createDataFrame([(i, bytearray(w.to_bytes(8, order))) for i, w in enumerate(words)], "i long, payload binary")
        h, l = dc.payload_halves(F.col("payload"), order)
        for start, length, signed in ((0, 8, False), (20, 24, True), (28, 9, True), (32, 32, True), (48, 16, False), (63, 1, False)):
            got = [r.v for r in df.select("i", dc.bit_field(h, l, start, length, signed).alias("v")).orderBy("i").collect()]
            raw = [w >> (64 - start - length) & ((1 << length) - 1) for w in words]
            assert got == [v - (1 << length) if signed and v >> (length - 1) else v for v in raw]


def test_order_and_partitions_change_nothing(spark):
    rng = np.random.default_rng(9)
    df = series(spark, rng.normal(size=300) * 4)
    rule = {"r": {"feature": "x", "op": "abs_gt", "threshold": 3.0, "merge_gap_s": 0.2}}
    a = ql.fingerprint(ru.detect(df, rule)).first()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = ql.fingerprint(ru.detect(df.orderBy(F.rand(3)), rule)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_future_leaves_context_unchanged(spark):
    from drivespan.operators.review import causal_context

    rng = np.random.default_rng(10)
    rows = [(1, float(t), float(v)) for t, v in zip(np.arange(100) * 1.0, rng.normal(size=100))]
    e = spark.createDataFrame([(1, 50.0)], "drive long, t_eval double")
    one = causal_context(e, spark.createDataFrame(rows, "drive long, t double, a double"), "drive", "t", {"a": 2.0}, 1.0).first()
    bent = [(d, t, v if t <= 47 else 1e9) for d, t, v in rows]
    two = causal_context(e, spark.createDataFrame(bent, "drive long, t double, a double"), "drive", "t", {"a": 2.0}, 1.0).first()
    assert one == two and one.source_t == 47.0


def test_near_pairs_finds_all(spark):
    rng = np.random.default_rng(11)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate((rng.random((120, 2)) - 0.5) * 100)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    want = {(p[0], q[0]) for p in pts for q in pts if math.hypot(p[1] - q[1], p[2] - q[2]) <= 9}
    got = [(r.id, r.b_id) for r in near_pairs(df, df, "x", "y", 9.0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_rebounds_and_ride_weighting(spark):
    from drivespan.operators import drive_checks as ck

    rng = np.random.default_rng(12)
    rows = [(int(d), float(i), float(a)) for d in range(20) for i, a in enumerate(np.round(rng.normal(size=7), 3))]
    want = {}
    for d in range(20):
        a = [r[2] for r in rows if r[0] == d]
        k = max(range(7), key=lambda i: (abs(a[i]), -i))
        n, last = 0, a[k]
        for x in a[k + 1 :]:
            if math.copysign(1, x) == math.copysign(1, last) or abs(x) >= abs(last):
                break
            n, last = n + 1, x
        want[d] = (a[k], n)
    got = ck.rebounds(spark.createDataFrame(rows, "drive long, t_start double, area double"), ["drive"]).collect()
    assert {r.drive: (r.largest, r.rebounds) for r in got} == want
    rate, taps = 100.0, ck.iso_weight_taps(100.0, 400)
    gain = lambda f: abs(sum(t * complex(math.cos(2 * math.pi * f * i / rate), math.sin(2 * math.pi * f * i / rate)) for i, t in enumerate(taps)))
    for f, g in ((1.0, 0.482), (2.0, 0.531), (5.0, 1.039), (8.0, 1.036), (16.0, 0.768), (31.5, 0.405)):
        assert abs(gain(f) - g) < 0.03


def test_conditions_never_hold_for_infinities(spark):
    rows = [(0, float("inf")), (1, float("-inf")), (2, float("nan")), (3, None), (4, 5.0), (5, -5.0)]
    df = spark.createDataFrame(rows, "id long, x double")
    for op, want in {"gt": {4}, "ge": {4}, "lt": {5}, "le": {5}, "abs_gt": {4, 5}, "abs_ge": {4, 5}}.items():
        limit = -1.0 if op in ("lt", "le") else 1.0
        assert {r.id for r in df.filter(ru.condition(F.col("x"), op, limit)).collect()} == want


def test_funnel_keeps_stages_that_no_row_passes(spark):
    from drivespan.operators import candidates as cd

    df = spark.createDataFrame([(0.0, 3600.0, 1), (0.0, 7200.0, 2)], "t_start double, t_end double, k int")
    stages = {"all": F.lit(True), "one": F.col("k") == 1, "none": F.col("k") == 9}
    got = {r.stage: (r.n, r.hours, r.positives) for r in cd.funnel(df, stages, F.col("k") > 0).collect()}
    assert got == {"all": (2, 3.0, 2), "one": (1, 1.0, 1), "none": (0, None, None)}
    assert {r.stage: r.n for r in cd.funnel(df.limit(0), stages, F.col("k") > 0).collect()} == {"all": 0, "one": 0, "none": 0}


def test_ranges_number_like_one_window(spark):
    from drivespan.operators import stats as ss

    rng = np.random.default_rng(3)
    rows = [(i, float(x)) for i, x in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "id long, x double")
    got = {r.id: r.place for r in ss.numbered(df, [F.desc("x"), F.asc("id")], "place").collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    null = spark.createDataFrame([(float(x),) for x in rng.integers(0, 60, 300)], "x double")
    values = [r.x for r in null.collect()]
    for r in ss.surprise(df.unionByName(spark.createDataFrame([(900, None)], "id long, x double")), null, "x").collect():
        assert r.surprise is None if r.x is None else math.isclose(r.surprise, -math.log10((sum(v >= r.x for v in values) + 1) / 301))


def test_leave_one_out_medians_against_a_loop(spark):
    from drivespan.operators import stats as ss

    rng = np.random.default_rng(4)
    rows = [(c, d, float(rng.integers(0, 9))) for c, n in enumerate([1, 3, 4, 5, 8, 9]) for d in range(n) for _ in range(3)]
    got = {(r.cell, r.drive): r.baseline for r in ss.leave_own_out_median(spark.createDataFrame(rows, "cell int, drive int, x double"), "cell", "drive", "x").collect()}
    want = {}
    for c in range(6):
        own = {d: float(np.median([x for a, b, x in rows if (a, b) == (c, d)])) for d in {b for a, b, _ in rows if a == c}}
        for d in own:
            rest = [m for k, m in own.items() if k != d]
            if len(rest) >= 3:
                want[c, d] = float(np.median(rest))
    assert got == want


def test_stations_over_poles_and_the_date_line(spark):
    from drivespan.operators import sites as st

    points = spark.createDataFrame([(1, 89.99, 10.0), (2, 0.0, 179.99), (3, 50.0, 8.0)], "id long, lat double, lon double")
    stations = spark.createDataFrame([(1, 89.99, -170.0), (2, 0.0, -179.99), (3, 50.01, 8.0), (4, 50.0, 8.0)], "station long, lat double, lon double")
    got = [(r.id, r.station, r.rank) for r in st.weather_near(points, stations, 5000.0, 5).collect()]
    assert sorted(got) == [(1, 1, 1), (2, 2, 1), (3, 3, 2), (3, 4, 1)]


def test_draws_are_uniform_and_repeat(spark):
    from drivespan.functions.draws import draw

    u = [r.u for r in spark.range(4000).select(draw(5, F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and abs(np.std(u) - 12**-0.5) < 0.02 and len(set(u)) == 4000
