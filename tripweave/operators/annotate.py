"""Trip annotation: time parts, coarser cells, coordinates, distance, speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions import clock
from tripweave.functions import geohash as gh

CELL_LEVELS = (4, 5, 6)
TIMES = ("duration_min", "date", "hour", "minute", "dow", "is_weekend", "slot_15", "slot_60")
DISTANCES = ("crowfly_km", "implied_speed_kmh")


def add_times(df: DataFrame) -> DataFrame:
    """Duration, date, hour, minute, weekday, weekend, 15- and 60-minute slots of the start."""
    start = F.col("start_time")
    return df.withColumns(
        {
            "duration_min": clock.minutes_between(start, F.col("end_time")),
            "date": F.to_date(start),
            "hour": F.hour(start),
            "minute": F.minute(start),
            "dow": F.weekday(start),
            "is_weekend": F.weekday(start) >= 5,
            "slot_15": F.floor(clock.minute_of_day(start) / 15).cast("int"),
            "slot_60": F.hour(start),
        }
    )


def add_places(df: DataFrame, levels=CELL_LEVELS) -> DataFrame:
    """Lattice indices, coarser cells and centre coordinates of both ends; NULL where malformed."""
    columns = {}
    for side in ("start", "end"):
        cell = F.col(f"{side}_geohash")
        for level in levels:
            columns[f"{side}_cell{level}"] = gh.truncate(cell, level)
    df = gh.with_index(df, {"start": "start_geohash", "end": "end_geohash"}).withColumns(columns)
    return df.withColumns(
        {
            f"{side}_{name}": centre(F.col(f"{side}_{axis}"))
            for side in ("start", "end")
            for name, axis, centre in (("lat", "i", gh.centre_lat), ("lon", "j", gh.centre_lon))
        }
    )


def add_movement(df: DataFrame) -> DataFrame:
    """Crow-fly distance and implied speed; speed is unknown unless the duration is positive."""
    df = df.withColumn(
        "crowfly_km",
        gh.haversine_km(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")),
    )
    return df.withColumns(
        {
            "implied_speed_kmh": F.when(
                F.col("duration_min") > 0, F.try_divide(F.col("crowfly_km"), F.col("duration_min") / 60.0)
            ),
            "is_same_cell": F.col("start_geohash") == F.col("end_geohash"),
        }
    )


def annotate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Derived columns: all, or what the listed ones need.

    Decoding a cell is a step that the optimizer does not remove (see compute_once), so a caller that
    reads times only says so, and neither cell column is scanned.
    """

    def wanted(*names: str) -> bool:
        return columns is None or not set(names).isdisjoint(columns)

    far = wanted(*DISTANCES)
    levels = [n for n in CELL_LEVELS if wanted(f"start_cell{n}", f"end_cell{n}")]
    places = [f"{side}_{what}" for side in ("start", "end") for what in ("i", "j", "lat", "lon")]
    if far or wanted(*TIMES):
        df = add_times(df)
    if far or levels or wanted(*places):
        df = add_places(df, levels)
    if far:
        return add_movement(df)
    return df.withColumn("is_same_cell", F.col("start_geohash") == F.col("end_geohash")) if wanted("is_same_cell") else df


def endpoints(df: DataFrame, keep: list[str] = (), level: int | None = None) -> DataFrame:
    """One row per trip end: side, ts (time of that end), cell and the kept columns.

    A single pass over the trips: both ends are exploded, so the table is scanned once.
    """
    ends = F.array(
        *[
            F.struct(
                F.lit(name).alias("side"),
                F.col(f"{side}_time").alias("ts"),
                (F.col(f"{side}_geohash") if level is None else gh.truncate(F.col(f"{side}_geohash"), level)).alias("cell"),
            )
            for name, side in (("departure", "start"), ("arrival", "end"))
        ]
    )
    return df.select(*keep, F.explode(ends).alias("_end")).select(*keep, "_end.*")
