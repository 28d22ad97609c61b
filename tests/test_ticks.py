"""The ticks to their last bit: what SQL and Spark make of them is equal only if they are."""

import duckdb
import pytest

from drivespan.operators.candidates import context
from drivespan.plans.base import TICKS, rounded, ticks


@pytest.mark.parametrize("shift", [0, 7_000_000])
def test_ticks_are_the_sqls_doubles(spark, sf_dir, tmp_path, shift):
    duck = duckdb.connect()
    duck.execute(f"create table events as select event_id + {shift} as event_id, ts, user_id + {shift // 100} as user_id, event_type, value, props from read_parquet('{sf_dir}/events.parquet')")
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = duck.execute(f"with {TICKS} select * from ticks").df()
    got = ticks(spark, str(tmp_path)).select(*want.columns).toPandas()
    order = ["drive", "tick"]
    want, got = (d.sort_values(order).reset_index(drop=True) for d in (want, got))
    for c in want.columns:
        assert ((want[c] == got[c]) | (want[c].isna() & got[c].isna())).all(), c


def test_rounding_is_the_sqls(spark):
    xs = [5.47 / 3.2, -5.47 / 3.2, 15.8790625, 1.0000005, 2.5, -0.4999995, 1234.0000045]
    want = [duckdb.execute("select round(?, 5)", [x]).fetchall()[0][0] for x in xs]
    assert [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(rounded("x", 5).alias("y")).collect()] == want


def test_means_of_candidates_sum_in_time(spark):
    """Values whose sum depends on their order, dealt in no order."""
    t = [(1, float(i), (1e16, 1.0, -1e16, 0.25)[i % 4]) for i in range(40)]
    rows = spark.createDataFrame([t[i * 7 % 40] for i in range(40)], "drive long, t double, x double").repartition(4)
    c = spark.createDataFrame([(1, 0, 0.0, 39.0)], "drive long, group long, t_start double, t_end double")
    want = 0.0
    for _, _, x in t:
        want += x
    assert context(c, rows, "drive", "t", [("x", "mean")], 5.0).first().x_mean == want / 40
