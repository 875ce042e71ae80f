"""Panels, predictions and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripweave.operators.panel import validate_panel


def read_panel(spark: SparkSession, path: str, n_slots: int, unit_column: str = "block_id", geometry: bool = True) -> DataFrame:
    """Read a panel (Parquet or CSV) and refuse it unless it keeps its contract."""
    csv = path.rstrip("/").endswith((".csv", ".csv.gz"))
    panel = spark.read.option("header", True).option("inferSchema", True).csv(path) if csv else spark.read.parquet(path)
    return validate_panel(panel, n_slots, unit_column, geometry)


def write_run(df: DataFrame, root: str, run: str, table: str, partition: str | None = None) -> str:
    """Write one table of a run to its own folder."""
    path = f"{root}/{run}/{table}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def write_result(df: DataFrame, path: str, form: str = "parquet") -> str:
    """Write an aggregate as Parquet, or as CSV with a header for people."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def ordered(panel: DataFrame) -> DataFrame:
    """The export order of a panel; nothing else depends on row order."""
    return panel.orderBy("date", "slot", "block_id")
