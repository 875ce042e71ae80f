"""Trips to complete count panels, their contract, and lag features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.functions import geohash as gh
from tripweave.functions.clock import DayTypes, Horizon
from tripweave.functions.once import compute_once
from tripweave.operators.annotate import endpoints
from tripweave.operators.domain import densify, observed_days
from tripweave.session import write_through

KEYS = ["block_id", "date", "slot"]


def slot_counts(
    trips: DataFrame, horizon: Horizon, types: DayTypes, rule="workday", level: int = 8, shape: tuple[int, int] = (1, 1)
) -> DataFrame:
    """Sparse departures and arrivals per (block_id, date, slot).

    Each end is selected by its own clock time, while both carry the trip's date. Cells are counted
    first; grouping them into larger units happens on the counts.
    """
    kept = trips.where(types.keep(F.col("date"), rule))
    ends = endpoints(kept, ["date"], level).withColumn("slot", horizon.slot(F.col("ts"))).where("slot >= 0")
    counts = ends.groupBy("cell", "date", "slot").agg(
        F.count_if(F.col("side") == "departure").alias("departures"),
        F.count_if(F.col("side") == "arrival").alias("arrivals"),
    )
    if shape == (1, 1):
        return counts.withColumnRenamed("cell", "block_id")
    units = counts.withColumn("block_id", gh.unit_id(F.col("cell"), level, *shape))
    return units.groupBy(*KEYS).agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))


def universe(counts: DataFrame, min_events: int = 1) -> DataFrame:
    """Units with at least `min_events` counted ends."""
    totals = counts.groupBy("block_id").agg(F.sum(F.col("departures") + F.col("arrivals")).alias("events"))
    return totals.where(F.col("events") >= max(1, min_events))


def build_panel(
    trips: DataFrame,
    horizon: Horizon,
    types: DayTypes,
    rule="workday",
    level: int = 8,
    shape: tuple[int, int] = (1, 1),
    units: DataFrame | None = None,
    min_events: int = 1,
) -> DataFrame:
    """Complete (block_id, date, slot) panel with arrivals, departures and the unit's centre.

    Units are the ones with enough events inside the horizon and the day rule, or the ids given in
    `units` (column block_id); days are the observed ones the rule keeps.
    """
    counts = slot_counts(trips, horizon, types, rule, level, shape)
    days = observed_days(trips.where(types.keep(F.col("date"), rule)))
    if units is None and min_events > 1:
        # Read twice: once for the totals, once for the grid.
        counts = write_through(counts)
        units = universe(counts, min_events).select("block_id")
    if units is None:
        counts = _with_unit_centre(counts, level, shape)
    else:
        units = _with_unit_centre(units.select("block_id").distinct(), level, shape)
    dense = densify(counts, ["block_id"], days, "slot", horizon.n_slots, ["departures", "arrivals"], units, ["lat", "lon"])
    return dense.select(*KEYS, "departures", "arrivals", "lat", "lon")


def _with_unit_centre(df: DataFrame, level: int, shape: tuple[int, int]) -> DataFrame:
    indexed = gh.with_index(df, {"_u": "block_id"}, level)
    centre = {"lat": gh.centre_lat(F.col("_u_i"), level), "lon": gh.centre_lon(F.col("_u_j"), level)}
    return compute_once(indexed, centre).drop("_u_i", "_u_j")


def panel_info(trips: DataFrame, counts: DataFrame, types: DayTypes, rule) -> DataFrame:
    """What a panel was counted from: rows read, days kept, events on both sides, units."""
    read = trips.agg(
        F.count("*").alias("rows_read"),
        F.count_distinct(F.when(types.keep(F.col("date"), rule), F.col("date"))).alias("days_kept"),
    )
    counted = counts.agg(
        F.sum("departures").alias("departures_events"),
        F.sum("arrivals").alias("arrivals_events"),
        F.count_distinct("block_id").alias("units"),
    )
    # Two one-row frames.
    return read.select("*", F.lit(1).alias("_one")).join(F.broadcast(counted.withColumn("_one", F.lit(1))), "_one").drop("_one")


# ---- contract ---------------------------------------------------------------


def normalise_panel(panel: DataFrame, unit_column: str = "block_id") -> DataFrame:
    """Rename the unit column and a legacy hour column, and type the key and the counts."""
    if unit_column != "block_id" and unit_column in panel.columns:
        panel = panel.drop("block_id").withColumnRenamed(unit_column, "block_id")
    if "slot" not in panel.columns and "hour" in panel.columns:
        panel = panel.withColumnRenamed("hour", "slot")
    lacking = [c for c in [*KEYS, "arrivals", "departures"] if c not in panel.columns]
    if lacking:
        raise ValueError(f"panel lacks {lacking}; it has {sorted(panel.columns)}")
    typed = {"date": F.to_date("date"), "slot": F.col("slot").cast("int")}
    return panel.withColumns({**typed, **{c: F.col(c).cast("long") for c in ("arrivals", "departures")}})


def panel_violations(panel: DataFrame, n_slots: int) -> DataFrame:
    """Rows that break the contract, by rule; one pass over the rows grouped by key."""
    by_key = panel.groupBy(*KEYS).agg(
        F.count("*").alias("_n"),
        F.count_if((F.col("arrivals") < 0) | (F.col("departures") < 0)).alias("_negative"),
        F.count_if(F.col("arrivals").isNull() | F.col("departures").isNull()).alias("_null"),
    )
    return by_key.agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(~F.coalesce(F.col("slot").between(0, n_slots - 1), F.lit(False)), F.col("_n"))), F.lit(0)).alias("bad_slot"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("duplicate_keys"),
        F.sum("_negative").alias("negative_counts"),
        F.sum("_null").alias("null_counts"),
    )


def validate_panel(panel: DataFrame, n_slots: int, unit_column: str = "block_id", geometry: bool = True) -> DataFrame:
    """Return the normalised panel, or refuse it with the rules it breaks."""
    panel = normalise_panel(panel, unit_column)
    if geometry and not {"lat", "lon"} <= set(panel.columns):
        raise ValueError("the geometry features need lat and lon columns")
    found = panel_violations(panel, n_slots).first().asDict()
    broken = {k: v for k, v in found.items() if k != "rows" and v}
    if broken:
        raise ValueError(f"panel breaks its contract: {broken}")
    return panel


def describe_panel(panel: DataFrame) -> DataFrame:
    """Rows, units, days, slots, sums and zero shares in one aggregation."""
    return panel.agg(
        F.count("*").alias("rows"),
        F.count_distinct("block_id").alias("units"),
        F.count_distinct("date").alias("days"),
        F.count_distinct("slot").alias("slots"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.sum("arrivals").alias("arrivals_sum"),
        F.sum("departures").alias("departures_sum"),
        F.avg((F.col("arrivals") == 0).cast("int")).alias("zero_share_arrivals"),
        F.avg((F.col("departures") == 0).cast("int")).alias("zero_share_departures"),
    )


def leaking_columns(features: DataFrame, candidates: list[str]) -> DataFrame:
    """Per candidate: does it equal "this row had a trip", or its opposite, on every row? One pass."""
    active = ((F.col("arrivals") + F.col("departures")) > 0).cast("double")
    row = features.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in candidates],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in candidates],
        *[F.bool_and(F.col(c).cast("double").eqNullSafe(active)).alias(f"same_{c}") for c in candidates],
        *[F.bool_and(F.col(c).cast("double").eqNullSafe(1.0 - active)).alias(f"opposite_{c}") for c in candidates],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.col(f"same_{c}") | F.col(f"opposite_{c}")).alias("leaks"),
            )
            for c in candidates
        ]
    )
    return row.select(F.inline(lines))


# ---- hourly lags ------------------------------------------------------------


def add_lags(panel: DataFrame, unit: list[str], slot: str, value: str, lags=(1, 24, 168), mean_of: int = 3) -> DataFrame:
    """Row lags and the mean of the preceding rows, per unit of a complete grid.

    Every unit has the same number of rows, one per grid position, so no unit is heavier than
    another whatever its trips; the grid already arrives partitioned by unit.
    """
    order = W.partitionBy(*unit).orderBy("day_position", slot)
    lagged = panel.withColumns({f"lag{n}": F.lag(value, n).over(order) for n in lags})
    return lagged.withColumn(f"lag1_ma{mean_of}", F.avg(value).over(order.rowsBetween(-mean_of, -1)))


def drop_warm_up(panel: DataFrame, lags=(1, 24, 168), per_day: int = 24) -> DataFrame:
    """Remove rows without every lag and number the remaining days from 0.

    On a complete grid the first max(lags) positions go, so the new day index is arithmetic.
    """
    kept = panel.where(F.col(f"lag{max(lags)}").isNotNull())
    return kept.withColumn("day_index", F.col("day_position") - F.lit(max(lags) // per_day)).drop("day_position")


def hourly_panel(departures: DataFrame) -> DataFrame:
    """Lag features, weekday and day index on a complete hourly departure grid."""
    lagged = drop_warm_up(add_lags(departures, ["cell"], "hour", "n"))
    return lagged.withColumns(
        {"dow": F.weekday("date"), "is_weekend": (F.weekday("date") >= 5).cast("int")}
    )
