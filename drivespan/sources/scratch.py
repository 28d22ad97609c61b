"""The folder in which lineage is cut: what spark.checkpoint.dir names, or one in the warehouse where it is unset; on a cluster that must not be a machine's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and kept.isDefined():
        at = kept.get()
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/drivespan-scratch"
        if not spark.sparkContext.master.startswith("local") and at.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    if not kept.isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the scratch folder, read again: the lineage ends there, and with it Spark's guess of the size. A checkpoint keeps that guess, whose digits a loop of joins multiplies in each round until they fill the driver."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
