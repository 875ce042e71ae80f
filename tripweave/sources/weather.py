"""Hourly weather readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names in the hourly export and the names used here.
NAMES = {
    "time": "ts",
    "precipitation": "precip_mm",
    "temperature_2m": "temp_c",
    "wind_speed_10m": "wind_ms",
    "cloud_cover": "cloud_pct",
}


def normalise(readings: DataFrame, order: str | None = None) -> DataFrame:
    """Rename, require every column, and keep the first reading of each time.

    "First" is by the `order` column; without one, the smallest reading, which is stable too.
    """
    renamed = readings.withColumnsRenamed({k: v for k, v in NAMES.items() if k in readings.columns})
    values = [v for v in NAMES.values() if v != "ts"]
    lacking = [c for c in ("ts", *values) if c not in renamed.columns]
    if lacking:
        raise ValueError(f"weather table lacks {lacking}")
    typed = renamed.withColumns({"ts": F.col("ts").cast("timestamp"), **{v: F.col(v).cast("double") for v in values}})
    reading = F.struct(*values)
    first = F.min_by(reading, F.col(order)) if order else F.min(reading)
    return typed.groupBy("ts").agg(first.alias("_r")).select("ts", *[F.col(f"_r.{v}").alias(v) for v in values])


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.option("header", True).csv(path))
