"""Nested network files and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GP = "array<struct<gp_id: string, cells: array<string>>>"
ARC = "array<struct<arc_id: bigint, from_gp: string, to_gp: string, length_m: double, service_cells: array<string>>>"
ROW = "array<struct<row_id: string, kind: string, gp_id: string, arc_id: bigint, geohash: string>>"
NETWORK_SCHEMA = f"version string, gps {GP}, arcs {ARC}, rows {ROW}"

# The names under which a grouping file lists its groups and a group its cells.
LIST_KEYS = ("groups", "gps", "gathering_points", "cells", "units")
CELL_KEYS = ("cells", "cell_ids", "geohashes", "members", "units")


def read_network(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gp_cells, arcs, arc_cells) of a nested network document, or of a file whose lines are documents of a part each."""
    blob = spark.read.schema(NETWORK_SCHEMA).json(path, multiLine=not lines)
    missing = "gps is null and arcs is null and rows is null" if lines else "gps is null or arcs is null or rows is null"
    if blob.where(missing).take(1):
        raise ValueError(f"{path} lacks gps, arcs or rows")
    return explode_network(blob)


def explode_network(blob: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership tables of nested groups and arcs."""
    gps = blob.select(F.explode("gps").alias("g"))
    gp_cells = gps.select(F.col("g.gp_id").alias("gp_id"), F.explode("g.cells").alias("cell"))
    arcs = blob.select(F.explode("arcs").alias("a"))
    arc_cells = arcs.select(F.col("a.arc_id").alias("arc_id"), F.explode("a.service_cells").alias("cell"))
    return gp_cells, arcs.select("a.arc_id", "a.from_gp", "a.to_gp", "a.length_m"), arc_cells


def ids_from_json(text: DataFrame, column: str = "value") -> DataFrame:
    """Distinct ids out of JSON documents: a list of ids, a list of groups, or a named list of either.

    A document is parsed once, as a variant. Its first list counts whose groups all have cells; nulls are no ids.
    """
    doc = F.col("_doc")

    def cells_of(entry):
        named = F.coalesce(*[F.try_variant_get(entry, f"$.{k}", "array<string>") for k in CELL_KEYS])
        own = F.array(F.try_variant_get(entry, "$", "string"))
        return F.when(F.startswith(F.schema_of_variant(entry), F.lit("OBJECT")), named).otherwise(own)

    lists = [F.try_variant_get(doc, at, "array<variant>") for at in ("$", *[f"$.{k}" for k in LIST_KEYS])]
    ids = F.coalesce(*[F.flatten(F.transform(entries, cells_of)) for entries in lists])
    parsed = text.select(F.try_parse_json(F.col(column)).alias("_doc"))
    return parsed.select(F.explode(ids).alias("id")).where("id IS NOT NULL").distinct()


def read_ids(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Distinct ids of a JSON document (.json), of JSON lines (.jsonl) or of one CSV column (the first unless named)."""
    if path.endswith((".json", ".jsonl")):
        text = spark.read.text(path, wholetext=path.endswith(".json"))
        if key:
            text = text.select(F.get_json_object("value", "$." + key).alias("value"))
        return ids_from_json(text)
    table = spark.read.option("header", True).csv(path)
    column = key or table.columns[0]
    if column not in table.columns:
        raise ValueError(f"{path} has no column {column}; it has {table.columns}")
    return table.select(F.col(column).alias("id")).distinct()


def resolve_members(ids: DataFrame, panel: DataFrame) -> DataFrame:
    """Ids that occur as units of the panel; none at all is refused."""
    found = panel.select(F.col("block_id").alias("id")).distinct().join(ids, "id", "left_semi")
    if not found.take(1):
        raise ValueError("no listed id occurs in the panel: another grid level or another area")
    return found
