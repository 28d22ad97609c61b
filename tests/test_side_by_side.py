"""Recursive filters of many short blocks: stretches side by side give what one pass gives, and no block is a Python group of its own."""

import numpy as np
import pytest

from drivespan.operators import recursive as rc


@pytest.mark.parametrize(("batch", "chunk", "held"), [(10000, 4096, 1 << 18), (7, 16, 20), (1, 5, 1)])
def test_many_blocks_as_one_pass(spark, monkeypatch, batch, chunk, held):
    rng = np.random.default_rng(8)
    rows = []
    for b in range(25):
        for t in sorted(rng.choice(60, int(rng.integers(1, 40)), replace=False).tolist()):
            rows.append((f"b{b}", t, None if rng.random() < 0.1 else float(rng.normal()), float(t)))
    again = [(b, t, x - 1.0 if x is not None else None, -1.0) for b, t, x, _ in rows for _ in range(3) if t % 4 == 0]  # a tick's lesser rows are left out
    df = spark.createDataFrame(rows + again, "block string, tick long, x double, z double")
    filters = {"lag": rc.first_order(0.3, 20.0), "same": rc.first_order(0.0, 20.0), "weighted": rc.weighting("Wk", 20.0)}
    monkeypatch.setattr(rc, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.block, r.tick): r for r in rc.filtered_by(df, filters, "block", "tick", "x", settled=True, chunk=chunk, keep=("z",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for b in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == b}
        for name, f in filters.items():
            state = np.linalg.solve(np.eye(len(f.b)) - f.a, f.b) * (own[min(own)][2] or 0.0)
            for t in range(min(own), max(own) + 1):
                x = own[t][2] or 0.0 if t in own else 0.0
                y, state = float(f.c @ state + f.d * x), f.a @ state + f.b * x
                if t in own:
                    r = got[b, t]
                    assert r.z == t and (r[name] is None if own[t][2] is None else abs(r[name] - y) < 1e-9)


def test_stretches_of_ticks_held(spark):
    rng = np.random.default_rng(9)
    f, heads = rc.weighting("Wk", 20.0), np.array([0, 3, 4, 9])
    at, x = np.array([2, 5, 6, 0, 1, 2, 3, 8, 9, 4, 7]), rng.normal(size=11)
    start = rng.normal(size=(4, len(f.b)))
    for first in ([2, 0, 1, 4], [0, 0, 0, 1]):
        before, after = rc._side_by_side(f, at, x, heads, np.array(first), start)
        for k, (lo, hi) in enumerate(zip(heads, [*heads[1:], 11], strict=True)):
            own = np.zeros(at[hi - 1] - first[k] + 1)
            own[at[lo:hi] - first[k]] = x[lo:hi]
            s = f.states(own, start[k])
            assert np.allclose(before[lo:hi], s[at[lo:hi] - first[k]]) and np.allclose(after[k], s[-1])


def test_no_group_for_a_block(spark, sf_dir):
    from drivespan import registry

    for q in ("lag_constants", "recursive_lag", "whole_body_weighting"):
        plan = registry.QUERIES[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan
