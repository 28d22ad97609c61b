"""Places with very many points: the same answers as all pairs, without a row for each."""

import numpy as np
import pytest

from drivespan.operators import joins, sites as st


def cloud(spark, n, wide, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, int(d), float(x), float(y), float(h), float(s)) for k, (d, x, y, h, s) in enumerate(zip(rng.integers(0, 9, n), rng.uniform(0, wide, n), rng.uniform(0, wide, n), rng.uniform(0, 360, n), rng.integers(0, 50, n), strict=True))]
    return spark.createDataFrame(rows, "id long, drive long, x double, y double, hdg double, strength double"), rows


@pytest.mark.parametrize("many", [1, 2000, 1 << 30])
def test_blocks_give_what_pairs_give(spark, monkeypatch, many):
    monkeypatch.setattr(joins, "MANY_PAIRS", many)
    monkeypatch.setattr(joins, "SLOT", 16)
    df, rows = cloud(spark, 220, 60.0)
    turn = lambda a, b: min((a - b) % 360, (b - a) % 360)
    near = lambda p, q, r: (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= r * r
    want = {p[0]: len({q[1] for q in rows if q[1] != p[1] and near(p, q, 10) and turn(p[4], q[4]) <= 40}) for p in rows}
    assert {r.id: r.drives for r in st.repeats(df, "x", "y", "hdg", "drive", 10.0, 40.0).collect()} == want
    for r in st.uniqueness(df, df, "x", "y", "drive", "strength", 10.0).collect():
        best = {}
        for q in rows:
            if q[1] != rows[r.id][1] and near(rows[r.id], q, 10):
                best[q[1]] = max(best.get(q[1], -1), q[5])
        assert r.others == len(best) and abs(r.share - sum(v >= rows[r.id][5] for v in best.values()) / len(best)) < 1e-9
    free, site = sorted(rows, key=lambda p: (-p[5], p[0])), {}
    for p in free:
        if p[0] not in site:
            for q in free:
                if q[0] not in site and near(p, q, 12) and turn(p[4], q[4]) <= 60:
                    site[q[0]] = p[0]
    assert {r.id: r.site for r in st.assign_sites(df, "x", "y", "hdg", "strength", 12.0, 60.0).collect()} == site
    up = list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for p in rows:
        for q in rows:
            if near(p, q, 4) and turn(p[4], q[4]) <= 30:
                a, b = find(p[0]), find(q[0])
                up[max(a, b)] = min(a, b)
    assert {r.site: r.stretch for r in st.stretches(df.withColumnRenamed("id", "site"), "x", "y", "hdg", 4.0, 30.0).collect()} == {k: find(k) for k in range(len(up))}


def test_queries_over_whole_tables(spark, sf_dir):
    from drivespan import registry
    from drivespan.plans.places import _points

    rows = sorted(((r.id, r.x, r.y, r.hdg, r.strength) for r in _points(spark, sf_dir).collect()), key=lambda p: (-p[4], p[0]))
    turn = lambda a, b: min((a - b) % 360, (b - a) % 360)
    near = lambda p, q, r: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= r * r
    site = {}
    for p in rows:
        for q in rows if p[0] not in site else ():
            if q[0] not in site and near(p, q, 20.0) and turn(p[3], q[3]) <= 60.0:
                site[q[0]] = p[0]
    assert {r.id: r.site for r in registry.QUERIES["greedy_sites"](spark, sf_dir).collect()} == site
    up = {p[0]: p[0] for p in rows}
    find = lambda i: i if up[i] == i else find(up[i])
    link, bend = 10.0, 60.0
    for p in rows:
        for q in rows:
            if near(p, q, link) and turn(p[3], q[3]) <= bend:
                a, b = find(p[0]), find(q[0])
                up[max(a, b)] = min(a, b)
    assert {r.site: r.stretch for r in registry.QUERIES["site_stretches"](spark, sf_dir).collect()} == {k: find(k) for k in up}


def test_twenty_thousand_points_in_a_cell(spark):
    df, rows = cloud(spark, 20000, 5.0, seed=2)
    got = {r.id: r.drives for r in st.repeats(df, "x", "y", "hdg", "drive", 8.0, 20.0).collect()}
    assert len(got) == 20000 and min(got.values()) == 8
    assert st.uniqueness(df, df, "x", "y", "drive", "strength", 8.0).filter("others = 8").count() == 20000
    parts = {r.stretch for r in st.stretches(df.withColumnRenamed("id", "site"), "x", "y", "hdg", 8.0, 20.0).select("stretch").distinct().collect()}
    assert parts == {0}
