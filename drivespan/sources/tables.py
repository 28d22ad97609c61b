"""Readers and writers: typed CSV and JSON lines in, partitioned tables and requests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = "drive_id string, segment int, event_type string, t_start double, t_end double, peak_value double, severity double"
LABEL_SCHEMA = "round int, rank_at_labeling int, drive_id string, segment int, t_start double, t_end double, t_in_segment_s double, event_types_at_labeling string, verdict string, risky boolean, note string"


def read_rows(spark: SparkSession, path: str, schema: str, needed: list[str] = ("segment",)) -> DataFrame:
    """CSV rows with a header and a given schema; rows without the needed columns are left out."""
    return spark.read.csv(path, header=True, schema=schema).na.drop(subset=list(needed))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema and the number of errors each reports."""
    return spark.read.json(path, schema=schema).withColumn("n_errors", F.coalesce(F.array_size("errors"), F.lit(0)))


def write_tables(tables: dict[str, DataFrame], path: str, partition: str = "dataset") -> None:
    """Each table as Parquet under path/name, by dataset where it has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition) if partition in df.columns else w).parquet(f"{path}/{name}")


def write_requests(df: DataFrame, path: str) -> None:
    """Request rows as JSON lines."""
    df.write.mode("overwrite").json(path)


class SegmentSource:
    """A dataset behind one long schema (dataset, drive, segment, channel, t, v): a name, a loader, a frame rate and the stage that its channels support."""

    def __init__(self, name: str, load, fps: float = 20.0, max_stage: int = 2):
        self.name, self.load, self.fps, self.max_stage = name, load, fps, max_stage

    def signals(self, spark: SparkSession) -> DataFrame:
        return self.load(spark).withColumn("dataset", F.lit(self.name))


def union(spark: SparkSession, sources: list[SegmentSource]) -> DataFrame:
    out = sources[0].signals(spark)
    for s in sources[1:]:
        out = out.unionByName(s.signals(spark), allowMissingColumns=True)
    return out
