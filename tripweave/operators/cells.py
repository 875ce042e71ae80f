"""Per-cell summaries, completeness against a ring, and grids of grouped cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import geohash as gh
from tripweave.functions import polygon
from tripweave.operators.annotate import endpoints


def with_centre(cells: DataFrame, level: int, cell: str = "cell") -> DataFrame:
    """Add the centre coordinates of a cell column; one row per cell, so decoding happens late."""
    indexed = gh.with_index(cells, {"_c": cell}, level)
    return indexed.withColumns(
        {"lat": gh.centre_lat(F.col("_c_i"), level), "lon": gh.centre_lon(F.col("_c_j"), level)}
    ).drop("_c_i", "_c_j")


def cell_counts(trips: DataFrame, level: int = 6) -> DataFrame:
    """Departures, arrivals, touching and net outflow per touched cell, in one pass over the trips."""
    ends = endpoints(trips, level=level)
    counts = ends.groupBy("cell").agg(
        F.count_if(F.col("side") == "departure").alias("n_departures"),
        F.count_if(F.col("side") == "arrival").alias("n_arrivals"),
    )
    return counts.withColumns(
        {
            "n_touching": F.col("n_departures") + F.col("n_arrivals"),
            "net_out": F.col("n_departures") - F.col("n_arrivals"),
        }
    )


def inside_fraction(i: Column, j: Column, level: int, ring: polygon.Ring, n: int = 16) -> Column:
    """Share of an n x n sample of the cell that lies inside the ring.

    The sample is folded inside the expression: a cell stays one row.
    """
    height, width = gh.cell_size(level)
    south, west = gh.south(i, level), gh.west(j, level)

    def add(total: Column, k: Column) -> Column:
        lat = south + (F.floor(k / n) + 0.5) / n * height
        lon = west + (k % n + 0.5) / n * width
        return total + polygon.inside(lat, lon, ring).cast("int")

    hits = F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0), add)
    return hits / F.lit(float(n * n))


def cell_summary(trips: DataFrame, ring: polygon.Ring, level: int = 6) -> DataFrame:
    """Cell counts with centre, inside share, centre membership and completeness class."""
    cells = with_centre(cell_counts(trips, level), level)
    cells = gh.with_index(cells, {"_c": "cell"}, level)
    return (
        cells.withColumn("inside_frac", inside_fraction(F.col("_c_i"), F.col("_c_j"), level, ring))
        .withColumn("in_region", polygon.inside(F.col("lat"), F.col("lon"), ring))
        .withColumn("completeness", polygon.completeness(F.col("inside_frac")))
        .drop("_c_i", "_c_j")
    )


def window_cells(cells: DataFrame, ring: polygon.Ring, pad_km: float = 3.0) -> DataFrame:
    """Cells whose centre is within pad_km of the ring's box."""
    return cells.where(polygon.padded_box(F.col("lat"), F.col("lon"), ring, pad_km))


def active_cells(cells: DataFrame, ring: polygon.Ring, pad_degrees: float) -> DataFrame:
    """Touched cells inside the ring's box padded by a number of degrees."""
    south, west, north, east = polygon.ring_box(ring)
    near = F.col("lat").between(south - pad_degrees, north + pad_degrees) & F.col("lon").between(
        west - pad_degrees, east + pad_degrees
    )
    return cells.where(near & (F.col("n_touching") > 0))


def unit_members(units: DataFrame, level: int, rows: int, columns: int, aligned: bool = True) -> DataFrame:
    """One row per (unit, member cell)."""
    return units.select("unit", F.explode(gh.member_cells(F.col("unit"), level, rows, columns, aligned)).alias("cell"))


def overlap_report(members: DataFrame) -> DataFrame:
    """Do the units partition their cells? Memberships against distinct cells."""
    return members.groupBy("cell").agg(F.count("*").alias("units")).agg(
        F.sum("units").alias("memberships"), F.count("*").alias("cells"), F.max("units").alias("max_units")
    ).withColumn("is_partition", F.col("memberships") == F.col("cells"))


def block_corner_share(ids: DataFrame, level: int, rows: int, columns: int) -> DataFrame:
    """Share of the ids that sit on the south-west corner of a rows x columns block."""
    indexed = gh.with_index(ids.select(F.col(ids.columns[0]).alias("unit")), {"_c": "unit"}, level)
    corner = (F.pmod("_c_i", F.lit(rows)) == 0) & (F.pmod("_c_j", F.lit(columns)) == 0)
    return indexed.agg(F.count("*").alias("ids"), F.avg(corner.cast("int")).alias("corner_share"))


def check_grid(ids: DataFrame, level: int, rows: int, columns: int, tolerance: float = 0.9) -> float:
    """Refuse ids that do not follow the declared grid; the full column is checked."""
    share = block_corner_share(ids, level, rows, columns).first()["corner_share"] or 0.0
    if share < tolerance:
        raise ValueError(f"only {share:.3f} of the ids start a {rows}x{columns} block")
    return share
