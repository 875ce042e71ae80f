"""Complete, zero-filled grids.

A grid of units x days x slots is never built as a product and never shuffled. Sparse counts are
brought together by unit; each sparse row then emits itself and the empty positions up to the next
one. The result stays partitioned by unit, which is what the lag windows that follow need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.functions.once import compute_once


def observed_days(df: DataFrame, day: str = "date") -> DataFrame:
    """Distinct days with their position 0, 1, ... in calendar order.

    The window runs in one task over at most one row per calendar day.
    """
    return numbered(df.select(F.col(day).alias("date")).where(F.col(day).isNotNull()).distinct())


def numbered(days: DataFrame) -> DataFrame:
    """Positions 0, 1, ... for a frame of distinct dates; at most one row per calendar day."""
    return days.select("date").withColumn("day_position", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))


def calendar_days(df: DataFrame, day: str = "date") -> DataFrame:
    """Every calendar day from the first to the last observed one, with its position."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"), "lo")
    return days.select("date", F.datediff("date", "lo").cast("int").alias("day_position"))


def densify(
    counts: DataFrame,
    unit: list[str],
    days: DataFrame,
    slot: str,
    n_slots: int,
    values: list[str],
    units: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Fill a sparse count table out to every (unit, day, slot).

    `counts` has the unit columns, date, slot and integer `values`, unique per key; `days` has the dates
    of the grid. Counts outside `days` or 0..n_slots-1 are left out. `units`
    adds units without any count (and, if given, drops units not in it). `carry` columns are constant
    per unit and come from `units`, or from `counts` where no units are given.
    """
    carry = carry or []
    # The days as one sorted array, read as a one-value subquery wherever it is needed: the rows do
    # not carry it, and what `days` is derived from is scanned once. One element per calendar day.
    dates = days.agg(F.sort_array(F.collect_set("date"))).scalar()
    kept = carry if units is None else []
    place = F.array_position(dates, F.col("date")) - 1
    # Placed once per count; otherwise the test would be pushed down to every trip.
    sparse = compute_once(counts.where(F.col(slot).between(0, n_slots - 1)), {"_day": place}).where("_day >= 0")
    sparse = sparse.select(*unit, *kept, (F.col("_day") * n_slots + F.col(slot)).alias("_k"), *values)
    if units is not None:
        sparse = units.select(*unit, *carry).join(sparse, unit, "left")
    by_unit = W.partitionBy(*unit).orderBy("_k")
    end = (F.size(dates) * n_slots).cast("long")
    runs = sparse.withColumns(
        {
            "_next": F.coalesce(F.lead("_k").over(by_unit), end),
            "_from": F.when(F.row_number().over(by_unit) == 1, F.lit(0)).otherwise(F.col("_k")).cast("long"),
        }
    ).where("_next > _from")
    dense = runs.withColumn("_p", F.explode(F.expr("sequence(_from, _next - 1)")))
    day = F.expr(f"_p div {int(n_slots)}").cast("int")
    return dense.select(
        *unit,
        *carry,
        F.element_at(dates, day + 1).alias("date"),
        (F.col("_p") % n_slots).cast("int").alias(slot),
        *[F.when(F.col("_p") == F.col("_k"), F.col(v)).otherwise(F.lit(0)).cast("long").alias(v) for v in values],
        day.alias("day_position"),
    )
