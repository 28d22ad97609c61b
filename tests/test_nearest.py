"""Searches for the nearest: the same answers as all pairs, with pairs that grow with the points and not with their density."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivespan.operators import joins, sites as st


def counted(monkeypatch):
    """The sizes of what nearest_pairs() gives."""
    found, own = [], joins.nearest_pairs
    monkeypatch.setattr(st, "nearest_pairs", lambda *a: found.append(own(*a)) or found[-1], raising=False)
    return found


@pytest.mark.parametrize("spread", [3.0, 0.1])
def test_stations_of_dense_places(spark, monkeypatch, spread):
    found = counted(monkeypatch)
    rng = np.random.default_rng(4)
    n = 1500
    rows = [(k, 50 + float(a), 10 + float(b)) for k, (a, b) in enumerate(rng.normal(0, spread, (n, 2)))] + [(n + k, 50.25, 10.25) for k in range(300)]  # with copies of one place
    p = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = {}
    for r in st.weather_near(p, p.withColumnRenamed("id", "station"), 60000.0, 3).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.station
    lat, lon = np.radians(np.array([r[1:] for r in rows])).T
    for k in range(0, len(rows), 7):
        d = 2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((lat - lat[k]) / 2) ** 2 + math.cos(lat[k]) * np.cos(lat) * np.sin((lon - lon[k]) / 2) ** 2))
        assert [got[k][i] for i in sorted(got[k])] == [int(i) for i in np.lexsort((np.arange(len(d)), d)) if d[i] <= 60000.0][:3]
    assert found[0].count() <= 400 * len(rows)


def test_ways_of_dense_places(spark, monkeypatch):
    found = counted(monkeypatch)
    rng = np.random.default_rng(5)
    rows = [(k, float(x), float(y), float(h), bool(o)) for k, (x, y, h, o) in enumerate(zip(rng.uniform(0, 30, 1200), rng.uniform(0, 30, 1200), rng.uniform(-180, 180, 1200), rng.integers(0, 2, 1200), strict=True))] + [(2000 + k, 5.0, 5.0, 9.0, False) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, hdg double, oneway boolean")
    ways = df.filter(F.col("id") % 3 > 0).withColumnsRenamed({"id": "way", "hdg": "bearing"})
    got = {r.id: r.way for r in st.road_match(df, ways, "x", "y", "hdg", 40.0, 25.0).collect()}
    turn = lambda a, b: min((a - b) % 360, (b - a) % 360)
    for p in rows[::9]:
        agree = [(math.dist(p[1:3], q[1:3]), q[0]) for q in rows if q[0] % 3 and math.dist(p[1:3], q[1:3]) <= 40 and (turn(p[3], q[3]) <= 25 or (not q[4] and 180 - turn(p[3], q[3]) <= 25))]
        assert got.get(p[0]) == (min(agree)[1] if agree else None)
    assert found[0].count() <= 400 * len(rows)
