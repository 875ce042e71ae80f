"""Volume over days, hours and weekdays."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.functions.clock import DayTypes


def daily_volume(trips: DataFrame) -> DataFrame:
    """Trips per calendar day. A day without trips keeps n NULL and is marked removed.

    Everything after the first aggregation has one row per calendar day.
    """
    daily = trips.where("date is not null").groupBy("date").agg(F.count("*").alias("n"))
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
    near = W.orderBy("date").rowsBetween(-3, 3)
    return calendar.join(daily, "date", "left").select(
        "date",
        "n",
        F.weekday("date").alias("dow"),
        (F.weekday("date") >= 5).alias("is_weekend"),
        F.col("n").isNull().alias("removed"),
        F.when(F.count("n").over(near) >= 4, F.avg("n").over(near)).alias("roll7"),
    )


def volume_bands(daily: DataFrame, bands: dict[str, tuple[date, date]]) -> DataFrame:
    """Mean, spread and range of daily volume, by day type and inside named date bands."""
    observed = daily.where(~F.col("removed"))
    inside = [
        F.avg(F.when(F.col("date").between(F.lit(lo), F.lit(hi)), F.col("n"))).alias(f"mean_{name}")
        for name, (lo, hi) in bands.items()
    ]
    return observed.agg(
        F.count("*").alias("days"),
        F.avg("n").alias("daily_mean"),
        F.var_samp("n").alias("daily_var"),
        F.stddev_samp("n").alias("daily_sd"),
        F.min("n").alias("daily_min"),
        F.max("n").alias("daily_max"),
        F.avg(F.when(~F.col("is_weekend"), F.col("n"))).alias("weekday_mean"),
        F.avg(F.when(F.col("is_weekend"), F.col("n"))).alias("weekend_mean"),
        *inside,
    )


def _per_occurrence(trips: DataFrame, group: str) -> DataFrame:
    """Counts per group and hour divided by the group's distinct days; hours are complete.

    Trips are reduced to (group, day, hour) once; both counts come from that reduction.
    """
    cells = trips.groupBy(group, "date", "hour").agg(F.count("*").alias("n"))
    per_hour = cells.groupBy(group, "hour").agg(F.sum("n").alias("n"))
    days = cells.groupBy(group).agg(F.count_distinct("date").alias("days"))
    # At most seven groups.
    grid = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    joined = F.broadcast(grid).join(per_hour, [group, "hour"], "left")
    return joined.select(group, "hour", "days", (F.coalesce("n", F.lit(0)) / F.col("days")).alias("per_day"))


def hour_profile(trips: DataFrame) -> DataFrame:
    """Mean trips per hour on weekdays and on weekends, per observed day of the type."""
    return _per_occurrence(trips, "is_weekend")


def weekday_hour_shares(trips: DataFrame) -> DataFrame:
    """Mean trips per (weekday, hour) and their share of the weekday."""
    means = _per_occurrence(trips, "dow")
    row = F.sum("per_day").over(W.partitionBy("dow"))
    return means.withColumn("share_pct", 100.0 * F.try_divide(F.col("per_day"), row))


def peak_hours(profile: DataFrame, group: str) -> DataFrame:
    """Busiest hour per group; the first of equals."""
    best = F.max(F.struct(F.col("per_day"), (-F.col("hour")).alias("h")))
    return profile.groupBy(group).agg(best.alias("b")).select(
        group, (-F.col("b.h")).alias("peak_hour"), F.col("b.per_day").alias("peak_per_day")
    )


def day_type(day: Column, types: DayTypes) -> Column:
    return (
        F.when(types.is_holiday(day), "holiday")
        .when(types.is_makeup(day), "makeup")
        .when(F.weekday(day) >= 5, "weekend")
        .otherwise("workday")
    )


def volume_by_day_type(trips: DataFrame, types: DayTypes) -> DataFrame:
    """Days, mean and median daily volume per day type."""
    daily = trips.groupBy("date").agg(F.count("*").alias("n"))
    return daily.groupBy(day_type(F.col("date"), types).alias("day_type")).agg(
        F.count("*").alias("days"),
        F.sum("n").alias("trips"),
        F.avg("n").alias("mean_n"),
        F.percentile("n", F.lit(0.5)).alias("median_n"),
    )


def special_days_against_workdays(trips: DataFrame, types: DayTypes) -> DataFrame:
    """Each holiday and make-up day against the mean workday."""
    daily = trips.groupBy("date").agg(F.count("*").alias("n"))
    typed = daily.withColumn("day_type", day_type(F.col("date"), types))
    usual = typed.where("day_type = 'workday'").agg(F.avg("n")).scalar()
    special = typed.where(F.col("day_type").isin("holiday", "makeup"))
    return special.withColumn("workday_mean", usual).withColumn("ratio", F.try_divide("n", "workday_mean"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts and density over unequal bins: left-closed, the last one closed on both sides."""
    last = len(edges) - 2
    position = F.lit(None).cast("int")
    for k in range(last, -1, -1):
        upper = F.col(column) <= edges[k + 1] if k == last else F.col(column) < edges[k + 1]
        position = F.when((F.col(column) >= edges[k]) & upper, F.lit(k)).otherwise(position)
    counted = df.select(position.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    lows = F.array(*[F.lit(float(e)) for e in edges])
    width = F.element_at(lows, F.col("bin") + 2) - F.element_at(lows, F.col("bin") + 1)
    return counted.select(
        "bin",
        F.element_at(lows, F.col("bin") + 1).alias("low"),
        F.element_at(lows, F.col("bin") + 2).alias("high"),
        "n",
        (F.col("n") / F.sum("n").over(W.partitionBy()) / width).alias("density"),
    )
