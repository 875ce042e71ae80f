"""Queries that write the files a job is given, and read them back with the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.catalog.base import ORACLES, query, rounded, trips_sql
from tripweave.catalog.flows import OWN_SQL, ownership
from tripweave.catalog.forecast import WEATHER_SQL, readings
from tripweave.catalog.geometry import scanlines
from tripweave.catalog.network import NET_SQL, PRED_SQL, members, nested_network, predictions
from tripweave.operators import network, region
from tripweave.session import shared_path
from tripweave.sources import boundary, ownership as ownership_source, tables
from tripweave.sources import network as network_source
from tripweave.sources import weather as weather_source


@query("source_network_file", trips_sql(f"{NET_SQL} SELECT kind, id, cell FROM mem"))
def source_network_file(spark, sf):
    """The nested network written as JSON, one line for each group and arc, and its membership read back."""
    path = shared_path(spark, "networks")
    nested_network(spark, sf).withColumn("version", F.lit("1")).write.json(path)
    gp_cells, _, arc_cells = network_source.read_network(spark, path, lines=True)
    return network.membership(gp_cells, arc_cells)


@query(
    "source_id_files",
    trips_sql(f"{OWN_SQL}, ids AS (SELECT DISTINCT geohash AS id, gp FROM own) SELECT 'csv' AS form, id FROM ids UNION ALL SELECT 'json', id FROM ids WHERE gp <> 'UNASSIGNED'"),
)
def source_id_files(spark, sf):
    """Ids from a CSV column, and from JSON documents, one line for each group, that list it under one name."""
    own = ownership(spark, sf)
    csv, json = shared_path(spark, "ids"), shared_path(spark, "ids") + ".jsonl"
    own.select("gp", "geohash").write.option("header", True).csv(csv)
    groups = own.where("gp <> 'UNASSIGNED'").groupBy("gp").agg(F.collect_list("geohash").alias("cells"))
    listed = groups.select(F.array(F.struct("gp", "cells")).alias("groups"))
    listed.select(F.to_json(F.struct("groups")).alias("value")).write.text(json)
    found = network_source.read_ids(spark, csv, "geohash").select(F.lit("csv").alias("form"), "id")
    return found.unionByName(network_source.read_ids(spark, json).select(F.lit("json").alias("form"), "id"))


@query("source_boundary_sheets", ORACLES["ring_area_from_scanlines"])
def source_boundary_sheets(spark, sf):
    """Both boundary sheets written as CSV; the ring read back from the first has the same area."""
    paths = []
    names = ({"lon": "Longitude", "min_lat": "Min_latitude", "max_lat": "Max_latitude"}, {"lat": "Latitude", "min_lon": "Min_longitude", "max_lon": "Max_longitude"})
    for table, renamed in zip(scanlines(spark, sf), names):
        paths.append(shared_path(spark, "sheets"))
        table.withColumnsRenamed(renamed).write.option("header", True).csv(paths[-1])
    by_lon, _ = boundary.read_scanlines(spark, *paths)
    return rounded(region.ring_area_km2(region.scanline_ring(by_lon)), "area_km2")


@query(
    "source_weather_file",
    trips_sql(
        f"""{WEATHER_SQL.replace('ORDER BY event_id)', 'ORDER BY event_id % 10, event_id % 100)')}
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, precip_mm, temp_c, wind_ms, cloud_pct FROM weather"""
    ),
)
def source_weather_file(spark, sf):
    """Readings as a CSV export with repeated hours; without an order column the smallest reading of an hour counts."""
    path = shared_path(spark, "weather")
    export = readings(spark, sf).drop("event_id").withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    export.write.option("header", True).csv(path)
    table = weather_source.read_weather(spark, path)
    return table.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "precip_mm", "temp_c", "wind_ms", "cloud_pct")


@query("source_ownership_files", ORACLES["group_master"])
def source_ownership_files(spark, sf):
    """Cell ownership as CSV and the group master as Parquet, keys checked, centres filled in."""
    own_path, master_path = shared_path(spark, "ownership"), shared_path(spark, "ownership") + ".parquet"
    own = ownership(spark, sf)
    own.write.option("header", True).csv(own_path)
    empty = own.select("gp").distinct().where("gp <> 'UNASSIGNED'").withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")})
    empty.write.parquet(master_path)
    own, master = ownership_source.read_tables(spark, own_path, master_path)
    out = ownership_source.with_centroids(master, own).join(ownership_source.group_bounds(own), "gp")
    return rounded(out, "lat", "lon", "south", "north", "west", "east", digits=9)


@query("sink_predictions", trips_sql(f"{PRED_SQL} SELECT block_id, date, slot, round(pred, 6) AS pred, actual FROM pp"))
def sink_predictions(spark, sf):
    """Predictions of a run, written by date and read back."""
    path = tables.write_run(predictions(spark, sf), shared_path(spark, "runs"), "morning", "predictions", "date")
    return rounded(spark.read.parquet(path).select("block_id", "date", "slot", "pred", "actual"), "pred")


@query("sink_entities", trips_sql(f"{PRED_SQL} SELECT kind, id, date, slot, round(pred_total, 6) AS pred_total, n_cells, missing_cells FROM roll"))
def sink_entities(spark, sf):
    """Entity rollups of a run, written by kind and read back."""
    rolled = network.rollup(predictions(spark, sf), members(spark, sf), ["pred"])
    path = tables.write_run(rolled, shared_path(spark, "runs"), "morning", "entities", "kind")
    return rounded(spark.read.parquet(path).select("kind", "id", "date", "slot", "pred_total", "n_cells", "missing_cells"), "pred_total")
