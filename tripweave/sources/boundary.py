"""Boundary scanline tables and the ring they trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.polygon import Ring
from tripweave.operators.region import scanline_ring



def read_scanlines(spark: SparkSession, by_lon_path: str, by_lat_path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables (CSV with a header): per longitude its latitudes, per latitude its longitudes."""
    sheets = (
        (by_lon_path, {"Longitude": "lon", "Min_latitude": "min_lat", "Max_latitude": "max_lat"}),
        (by_lat_path, {"Latitude": "lat", "Min_longitude": "min_lon", "Max_longitude": "max_lon"}),
    )
    tables = []
    for path, names in sheets:
        table = spark.read.option("header", True).csv(path)
        lacking = [c for c in names if c not in table.columns]
        if lacking:
            raise ValueError(f"{path} lacks {lacking}")
        tables.append(table.select(*[F.col(a).cast("double").alias(b) for a, b in names.items()]))
    return tables[0], tables[1]


def ring_from_scanlines(by_lon: DataFrame, max_vertices: int | None = None) -> Ring:
    """The ring as a parameter of a job: all its vertices, on the driver.

    A drawn outline has few of them. `max_vertices` lets a caller refuse a table that is none.
    """
    ordered = scanline_ring(by_lon).orderBy("position").select("lat", "lon")
    vertices = ordered.collect() if max_vertices is None else ordered.take(max_vertices + 1)
    if max_vertices is not None and len(vertices) > max_vertices:
        raise ValueError(f"more than {max_vertices} vertices: not a boundary")
    return [(v["lat"], v["lon"]) for v in vertices]
