"""What a run leaves on disk: shuffle files go with the query that made them, a round's tables with the next round."""

import os
import time

import pytest
from pyspark.sql import functions as F

components = pytest.importorskip("drivespan.llm.components")
shared = pytest.importorskip("drivespan.llm.shared")
simhash = pytest.importorskip("drivespan.llm.simhash")


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir")
    return {f for d in top.split(",") for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def left(spark, before):
    """Shuffle files made since; executors remove them a little later."""
    for _ in range(20):
        now = shuffle_files(spark) - before
        if not now:
            break
        time.sleep(0.5)
    return now


def path(spark, n):
    return spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))


@pytest.mark.parametrize("what", ["written", "components"])
def test_no_shuffle_outlives_its_query(spark, what):
    before = shuffle_files(spark)
    kept = shared.written(path(spark, 500).groupBy(F.col("u") % 7).count(), "sums") if what == "written" else components.connected_components(path(spark, 500))
    assert not left(spark, before)
    rows = kept.collect()
    assert len(rows) == 7 if what == "written" else {(r.node, r.component) for r in rows} == {(k, 0) for k in range(501)}


def test_the_setting_is_the_users_again(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for own in (None, "false", "true"):
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
        before = spark.conf.get(key, None)
        components.connected_components(path(spark, 5))
        assert spark.conf.get(key, None) == before
    spark.conf.unset(key)


def test_one_round_of_components_stays(spark):
    base = shared.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(base))
    with shared.removed_after(spark):
        got = components.connected_components(path(spark, 200))
        (new,) = set(os.listdir(base)) - before
        assert len(os.listdir(f"{base}/{new}")) == 1
        assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(201)}
    assert set(os.listdir(base)) == before


def test_fingerprints_in_one_chain_are_one_group(spark):
    # each differs from the next by one bit, the ends by 40
    prints = spark.createDataFrame([(k, (1 << k) - 1) for k in range(41)], "id long, fp long")
    assert {r.component_id for r in simhash.groups(prints).collect()} == {0}
