"""Trip tables: all-text CSV, column-pruned CSV or Parquet, and the cleaned and flagged sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tripweave.operators.qc import REQUIRED, Policy

# No text in a trip file is this character, so nothing is read as NULL.
NEVER = "\u0000"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw(spark: SparkSession, path: str, columns: list[str] = REQUIRED) -> DataFrame:
    """CSV (plain or gzip) as text: no type inference, and "NA" stays text. Blanks become ''."""
    raw = spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False).option(
        "nullValue", NEVER
    ).csv(path)
    return raw.fillna("", columns)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a Parquet or CSV table; the rest is never decoded."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).csv(path).select(*columns)
    return spark.read.parquet(path).select(*columns)


def sink_path(root: str, policy: Policy, kind: str = "clean") -> str:
    """A policy that differs from the default writes beside it, never over it."""
    return f"{root}/{kind}/policy={policy.tag() or 'default'}"


def write_trips(trips: DataFrame, root: str, policy: Policy = Policy(), kind: str = "clean") -> str:
    """Write trips partitioned by date; kind="flagged" is the audit copy with every row.

    Rows are rebalanced by date: quiet dates share a task, a heavy one is split by size over many.
    """
    path = sink_path(root, policy, kind)
    trips.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)
    return path


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
