"""Loops and replicates whose cost must not grow faster than their rows."""

import math

import duckdb
import numpy as np
import pytest

from drivespan import registry
from drivespan.operators import comparisons as cm, sites as st, stats as ss
from drivespan.plans.base import signals
from drivespan.sources.scratch import checkpointed
from pyspark.sql import functions as F


def test_rounds_do_not_swell_the_plan(spark):
    """Spark's guess of a table's size after rounds of joins stays that of the table."""
    df = spark.range(50).select(F.col("id").alias("site"), F.col("id").alias("s"))
    for _ in range(6):
        df = checkpointed(df.join(df.select(F.col("s").alias("site"), F.col("s").alias("o")), "site").select("site", F.col("o").alias("s")))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_a_long_chain_of_sites(spark):
    """One stretch of 40 sites takes many rounds."""
    df = spark.range(40).select(F.col("id").alias("site"), (F.col("id") * 8.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("hdg"))
    got = st.stretches(df, "x", "y", "hdg", 10.0, 60.0).collect()
    assert sorted((r.site, r.stretch) for r in got) == [(k, 0) for k in range(40)]


@pytest.mark.parametrize("block", [4, 64])
def test_permutation_in_blocks_is_the_sqls(spark, sf_dir, block):
    df = signals(spark, sf_dir).select((F.col("event_id") % 40).alias("site"), "drive", F.col("v").alias("x"), (F.col("v") * 0.5 + F.col("drive")).alias("y"))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{sf_dir}/events.parquet')")
    (slope, p), = duck.execute(registry.ORACLES["pooled_permutation"]).fetchall()
    got = ss.pooled_permutation(df, "site", "drive", "x", "y", 99, 3, block).first()
    assert (round(got.slope, 8), round(got.p, 8)) == (slope, p)


def test_bands_need_no_row_for_a_pair(spark, monkeypatch):
    """Moments by band against all pairs, in slots of few observations."""
    monkeypatch.setattr(cm, "SLOT", 8)
    rng = np.random.default_rng(3)
    places = [(k, *map(float, rng.uniform(0, 100, 2))) for k in range(60)]
    obs = [(k, kind, day, float(rng.normal())) for k in range(60) for kind in "ab" for day in range(3) if rng.random() < 0.7]
    _, bands = cm.station_agreement(spark.createDataFrame(obs, "station long, kind string, day long, v double"), spark.createDataFrame(places, "station long, x double, y double"), [20.0, 50.0], "kind", "day", "v")
    want = {}
    for a, kind, day, u in obs:
        for b, other, when, v in obs:
            d = math.dist(places[a][1:], places[b][1:])
            if a < b and kind == other and day == when and d <= 50:
                want.setdefault((kind, int(d > 20)), []).append((u, v))
    got = {(r.kind, r.band): r for r in bands.collect()}
    assert got.keys() == want.keys()
    for k, uv in want.items():
        u, v = np.array(uv).T
        assert got[k].n == len(uv) and abs(got[k].r - np.corrcoef(u, v)[0, 1]) < 1e-9 and abs(got[k].mean_abs_diff - np.abs(u - v).mean()) < 1e-9


@pytest.mark.parametrize(("slot", "readings"), [(3, 1000), (64, 20), (64, 1000)])
def test_station_pairs_are_met_in_blocks(spark, monkeypatch, slot, readings):
    """Pairs against a loop: values that vary little about a large one, stations with two places, in slots and strips of few; no pair is shuffled."""
    monkeypatch.setattr(cm, "SLOT", slot)
    monkeypatch.setattr(cm, "READINGS", readings, raising=False)
    monkeypatch.setattr(cm, "PAIRS", 40, raising=False)
    rng = np.random.default_rng(5)
    places = [(k, *map(float, rng.uniform(-60, 60, 2))) for k in range(30)]
    obs = [(k, kind, day, 1e6 * (kind == "a") + float(rng.normal()) * (0.02 if k % 3 else 0.0005)) for k in range(30) for kind in "ab" for day in range(6) if rng.random() < 0.7]
    obs += [(99, "a", 0, 1.0)]
    twice = [*places, (4, places[4][1] + 1, places[4][2])]
    for at in (places, twice):
        args = (spark.createDataFrame(obs, "station long, kind string, day long, v double"), spark.createDataFrame(at, "station long, x double, y double"))
        pairs, _ = cm.station_agreement(*args, [20.0, 50.0], "kind", "day", "v")
        if at is places:
            assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsIn")[0]
        value, want = {(s, kind, day): v for s, kind, day, v in obs}, {}
        for a, ax, ay in at:
            for b, bx, by in at:
                d = math.dist((ax, ay), (bx, by))
                for kind in "ab" if a < b and d <= 50 else ():
                    uv = [(value[a, kind, day], value[b, kind, day]) for day in range(6) if (a, kind, day) in value and (b, kind, day) in value]
                    if uv:
                        want.setdefault((kind, a, b, int(d > 20)), []).extend(uv)
        rows = pairs.collect()
        got = {(r.kind, r.a, r.b, r.band): r for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        for k, uv in want.items():
            u, v = np.array(uv).T
            varies = min(u.var(), v.var()) > 1e-6
            assert got[k].n == len(uv) and (got[k].r is not None) == varies and abs(got[k].mean_abs_diff - np.abs(u - v).mean()) < 1e-9
            assert not varies or abs(got[k].r - np.corrcoef(u, v)[0, 1]) < 1e-6
        assert {r.r is None for r in rows if r.n > 1} == {True, False}


def test_bands_of_values_that_vary_little(spark):
    """Pooled moments where sums of squares would lose the variance."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2, 200)) * 0.01 + 1e6
    obs = [(s, "a", day, float(v[s, day])) for s in (0, 1) for day in range(200)]
    _, bands = cm.station_agreement(spark.createDataFrame(obs, "station long, kind string, day long, v double"), spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0)], "station long, x double, y double"), [20.0, 50.0], "kind", "day", "v")
    (row,) = bands.collect()
    assert (row.band, row.n) == (0, 200) and abs(row.r - np.corrcoef(*v)[0, 1]) < 1e-6


def test_station_pairs_are_the_sqls(spark, sf_dir, tmp_path):
    """Pairs whose values vary little about a large one have a coefficient wherever the SQL gives one, and means just beside a half are rounded as the SQL rounds them."""
    us, vs = [43.94, 215.65, 48.07, 211.38, 203.45, 163.41, 66.18, 292.68], [79.7825, 22.32, 39.4925, 65.9825, 5.8825, 12.57, 87.5525, 7.07]
    seen = [(s, "click", day, x) for s, xs in ((0, us), (1, vs)) for day, x in enumerate(xs)]
    seen += [(s, "view", day, 400.0 + c * day) for s, c in ((0, 0.004), (1, -0.002)) for day in range(2)]
    duck = duckdb.connect()
    duck.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    duck.executemany("insert into events values (?, timestamp '2024-01-01' + to_days(cast(? as integer)), ?, ?, ?, null)", [(k, day, s, kind, x) for k, (s, kind, day, x) in enumerate(seen)])
    duck.execute("create table embeddings as select * from (values (0 :: bigint, [0, 0, 0.1, 0.1] :: float[], 0), (1, [0.02, 0, 0.1, 0.1] :: float[], 0)) as t(vec_id, embedding, label)")
    for t in ("events", "embeddings"):
        duck.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    duck.execute("set threads = 1")
    for name in ("station_pairs", "station_bands"):
        want = duck.execute(registry.ORACLES[name]).df()
        got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns).toPandas()
        assert sorted(got.itertuples(index=False, name=None), key=str) == sorted(want.itertuples(index=False, name=None), key=str) and want["r"].notna().all()
