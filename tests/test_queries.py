"""Every query of the library against its SQL twin on the smallest tables, and queries without one against plain loops."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from drivespan import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([cell(y) for y in x])
    if isinstance(x, (float, np.floating)):
        return f"{x + 0.0:.6g}"
    if isinstance(x, (int, np.integer)) and not isinstance(x, bool) and abs(x) < 1e15:
        return f"{x:.6g}"
    return "null" if str(x) in ("nan", "NaT", "<NA>") else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without SQL, and the tests that compare them with loops over the same rows.
LOOPS = {
    "test_whole_tables": {"lane_changes", "weaving", "s_evasions", "cut_ins", "sideslip_candidates", "byte_orders", "event_descriptors", "moved_first", "lobe_rebounds", "all_events", "sequence_events", "shipped_rules"},
    "test_fits": {"two_way_interval", "whole_body_weighting", "direction_offsets"},
    "test_hot_cells": {"greedy_sites", "site_stretches"},
}


def test_what_has_no_twin_has_a_loop():
    assert set().union(*LOOPS.values()) == set(registry.QUERIES) - set(registry.ORACLES)
    for name, queries in LOOPS.items():
        text = (Path(__file__).parent / f"{name}.py").read_text()
        assert all(f'"{q}"' in text for q in queries), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
