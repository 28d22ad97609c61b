"""Registration of queries, and the driver tables read as drives.

The tables hold no vehicle data, so two views of `events` stand in for it: `signals`, the events as irregular
channels of a drive (user), and `ticks`, a drive's events in order as rows of a 20 Hz grid with channels that are
computed from their ids. Each view has its DuckDB text beside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> F.Column:
    """A time stamp as seconds since 1970."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def rounded(c: str | Column, digits: int) -> Column:
    """A double rounded as the SQL rounds it: scaled, then to a whole number. F.round goes by the shortest decimal text instead, which differs where a double lies just beside a half."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**digits) / 10.0**digits


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("drive"), F.col("event_type").alias("channel"), seconds("ts").alias("t"), F.col("value").alias("v"), F.col("event_id"))


SIG = "sig AS (SELECT user_id AS drive, event_type AS channel, epoch_us(ts) / 1e6 AS t, value AS v, event_id FROM events)"



def fir_sql(x: str, taps: list[float], lag_only: bool = False) -> str:
    """The sum of taps times the rows around (or up to) each row of a window named w."""
    half = 0 if lag_only else len(taps) // 2
    at = lambda k: f"lag({x}, {k}) OVER w" if k > 0 else f"lead({x}, {-k}) OVER w" if k < 0 else x
    return " + ".join(f"{a!r} * {at(k if lag_only else half - k)}" for k, a in enumerate(taps))


#: A draw in [0, 1) as in functions.draws, of a text.
DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"

DT = 0.05
RATE = 20.0

_WAVE = {
    "v_mps": "abs((tick * 2 + drive * 5) % 120 - 60) / 2.0 + (k * 31 % 100) / 100.0",
    "ax_mps2": "CASE WHEN k % 53 = 0 THEN NULL ELSE abs((tick * 3 + drive * 7) % 40 - 20) * 0.6 - 6.0 + (k * 7919 % 100) / 100.0 END",
    "ay_mps2": "CASE WHEN k % 97 = 0 THEN NULL ELSE abs((tick * 2 + drive * 3) % 60 - 30) * 0.4 - 6.0 + (k * 1049 % 100) / 100.0 END",
    "yaw_dps": "abs((tick * 3 + drive * 11) % 50 - 25) * 1.6 - 20.0 + (k * 1297 % 200) / 100.0",
    "steer_deg": "abs((tick * 3 + drive * 11) % 54 - 27) * 8.0 - 108.0 + (k * 1543 % 400) / 100.0",
    "abs_flag": "CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END",
    "vsc_flag": "CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN 1.0 ELSE 0.0 END",
    "slip_warn": "CASE WHEN k % 41 = 0 THEN 4.0 WHEN k % 43 = 0 THEN 3.0 ELSE 0.0 END",
    "gas_pct": "abs((tick * 4 + drive) % 80 - 40) * 1.0",
    "brake_level": "CASE WHEN (tick * 4 + drive) % 80 BETWEEN 40 AND 60 THEN 0.5 ELSE 0.0 END",
    "lead_m": "CASE WHEN k % 29 = 0 THEN NULL ELSE abs((tick * 2 + drive * 13) % 100 - 50) * 0.8 + 5.0 END",
    "lead_id": "CAST((tick + drive) // 17 AS BIGINT)",
    "ws_fl": "abs((tick * 2 + drive * 5) % 120 - 60) / 2.0 + (k * 37 % 100) / 100.0",
    "ws_fr": "abs((tick * 2 + drive * 5) % 120 - 60) / 2.0 + (k * 41 % 100) / 100.0",
    "ws_rl": "abs((tick * 2 + drive * 5) % 120 - 60) / 2.0 + (k * 43 % 100) / 50.0",
    "ws_rr": "abs((tick * 2 + drive * 5) % 120 - 60) / 2.0 + (k * 47 % 100) / 40.0",
}
TICKS = (
    "base AS (SELECT user_id AS drive, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, event_id AS k, event_type FROM events), ticks AS (SELECT drive, tick, tick * 0.05 :: DOUBLE AS t, k, "
    + ", ".join(f"CAST({e} AS {'BIGINT' if c == 'lead_id' else 'DOUBLE'}) AS {c}" for c, e in _WAVE.items())
    + " FROM base)"
)


def _spark_text(e: str) -> str:
    """A wave's text for Spark: what the SQL divides are doubles there, so they are here; as decimals the last bit would be another, which moves maxima and thresholds."""
    return re.sub(r"/ (\d+\.\d+)", r"/ \1D", e.replace(" // 17", " div 17"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = table(spark, sf_dir, "events").select(F.col("user_id").alias("drive"), (F.row_number().over(w) - 1).cast("long").alias("tick"), F.col("event_id").alias("k"), "event_type")
    waves = (F.expr(_spark_text(e)).cast("long" if c == "lead_id" else "double").alias(c) for c, e in _WAVE.items())
    return base.select("drive", "tick", (F.col("tick") * F.lit(DT)).alias("t"), "k", *waves)
