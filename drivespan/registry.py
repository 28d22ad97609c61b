"""Every query of the library by name, and the SQL that DuckDB can run for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drivespan.plans import align, assess, chains, compare, detect, extras, fits, passing, places, reviews, scoring, surveys, tracks, vehicle, views  # noqa: F401  (they register their queries)
from drivespan.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["window_hours"](spark, sf_dir)
