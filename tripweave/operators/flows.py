"""Flows between named groups of cells (gathering points, GP) and across a set of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.clock import MORNING, DayTypes, Horizon
from tripweave.operators.domain import calendar_days, densify, numbered
from tripweave.operators.joins import is_small, lookup, member_of

UNASSIGNED = "UNASSIGNED"


def in_window(ts: Column, horizon: Horizon = MORNING) -> Column:
    return horizon.slot(ts) >= 0


def assigned(ownership: DataFrame) -> DataFrame:
    """Cells that belong to a group."""
    return ownership.where(F.col("gp") != UNASSIGNED).select("geohash", "gp")


def with_groups(trips: DataFrame, ownership: DataFrame) -> DataFrame:
    """Group of both ends (sgp, egp), NULL outside every group, with both dates."""
    cells = assigned(ownership)
    small = is_small(cells)
    for side, name in (("start", "sgp"), ("end", "egp")):
        renamed = cells.select(F.col("geohash").alias(f"{side}_geohash"), F.col("gp").alias(name))
        trips = lookup(trips, renamed, [f"{side}_geohash"], small=small)
    return trips.withColumns({"date": F.to_date("start_time"), "end_date": F.to_date("end_time")})


def target_days(trips: DataFrame, types: DayTypes) -> DataFrame:
    """Target workdays of the whole calendar span, numbered."""
    return numbered(calendar_days(trips).where(types.is_target(F.col("date"))))


# ---- a set of core cells ----------------------------------------------------


def core_membership(trips: DataFrame, core: DataFrame) -> DataFrame:
    """Is each end in the core set? Adds start_in and end_in."""
    trips = member_of(trips, "start_geohash", core, "start_in")
    return member_of(trips, "end_geohash", core, "end_in")


def membership_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("start_in", "end_in").agg(F.count("*").alias("n"))


def core_boundary(tagged: DataFrame, types: DayTypes, horizon: Horizon = MORNING) -> DataFrame:
    """Per workday: trips out by start time, in by end time, net and ratio; quiet days included.

    One pass: each crossing trip yields one event on the side where it crosses.
    """
    leaving = F.col("start_in") & ~F.col("end_in")
    crossing = tagged.where(F.col("start_in") != F.col("end_in"))
    events = crossing.select(
        F.when(leaving, F.col("start_time")).otherwise(F.col("end_time")).alias("ts"), leaving.alias("out")
    ).where(in_window(F.col("ts"), horizon))
    daily = events.groupBy(F.to_date("ts").alias("date")).agg(
        F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in")
    )
    # At most one row per calendar day from here.
    calendar = calendar_days(tagged).where(types.is_workday(F.col("date"))).select("date")
    filled = calendar.join(daily, "date", "left").fillna(0, ["n_out", "n_in"])
    return filled.withColumns(
        {
            "net_in": F.col("n_in") - F.col("n_out"),
            "in_over_out": F.try_divide("n_in", F.expr("nullif(n_out, 0)")),
        }
    )


def boundary_summary(daily: DataFrame) -> DataFrame:
    """Totals, ratio, mean net and its standard error, paired t, days with more in than out."""
    n, sd = F.count("*"), F.stddev_samp("net_in")
    return daily.agg(
        n.alias("days"),
        F.sum("n_out").alias("out_total"),
        F.sum("n_in").alias("in_total"),
        F.try_divide(F.sum("n_in"), F.sum("n_out")).alias("in_over_out"),
        F.avg("net_in").alias("mean_net"),
        sd.alias("sd_net"),
        (sd / F.sqrt(n)).alias("se_net"),
        (n - 1).alias("df"),
        F.try_divide(F.avg("net_in"), sd / F.sqrt(n)).alias("paired_t"),
        F.count_if(F.col("net_in") > 0).alias("days_net_in"),
        F.avg("in_over_out").alias("mean_ratio"),
        F.stddev_samp("in_over_out").alias("sd_ratio"),
        F.min("in_over_out").alias("min_ratio"),
        F.max("in_over_out").alias("max_ratio"),
    )


# ---- between groups ---------------------------------------------------------


def group_trips(grouped: DataFrame, types: DayTypes, horizon: Horizon = MORNING, keep_self: bool = False) -> DataFrame:
    """Target-day trips with both ends in groups and inside the window; self trips left out."""
    kept = grouped.where(
        types.is_target(F.col("date"))
        & in_window(F.col("start_time"), horizon)
        & in_window(F.col("end_time"), horizon)
        & F.col("sgp").isNotNull()
        & F.col("egp").isNotNull()
    )
    return kept if keep_self else kept.where("sgp <> egp")


def od_counts(between: DataFrame) -> DataFrame:
    """Trips per (date, origin, destination): the one reduction every group table starts from."""
    return between.groupBy("date", "sgp", "egp").agg(F.count("*").alias("n"))


def daily_group_flows(od: DataFrame, gps: DataFrame, days: DataFrame) -> DataFrame:
    """Departures, arrivals and net outflow per (date, gp), complete over groups and days."""
    ends = F.array(
        F.struct(F.col("sgp").alias("gp"), F.col("n").alias("dep"), F.lit(0).cast("long").alias("arr")),
        F.struct(F.col("egp").alias("gp"), F.lit(0).cast("long").alias("dep"), F.col("n").alias("arr")),
    )
    sparse = od.select("date", F.inline(ends)).groupBy("gp", "date").agg(F.sum("dep").alias("dep"), F.sum("arr").alias("arr"))
    dense = densify(sparse.withColumn("slot", F.lit(0)), ["gp"], days, "slot", 1, ["dep", "arr"], gps)
    return dense.select("date", "gp", "dep", "arr", (F.col("dep") - F.col("arr")).alias("net_out"))


def daily_imbalance(flows: DataFrame) -> DataFrame:
    """Per day: trips, source, sink and balanced groups, gross imbalance and its share."""
    net = F.col("net_out")
    daily = flows.groupBy("date").agg(
        F.sum("dep").alias("trips"),
        F.count_if(net > 0).alias("source_gps"),
        F.count_if(net < 0).alias("sink_gps"),
        F.count_if(net == 0).alias("balanced_gps"),
        F.sum(F.greatest(net, F.lit(0))).alias("gross_imbalance"),
    )
    return daily.withColumn("gross_over_trips", F.try_divide("gross_imbalance", F.expr("nullif(trips, 0)")))


def group_summary(flows: DataFrame) -> DataFrame:
    """Per group over days: means, spread of net, ratio, days with net outflow, role."""
    summary = flows.groupBy("gp").agg(
        F.avg("dep").alias("dep_day"),
        F.avg("arr").alias("arr_day"),
        F.avg("net_out").alias("net_day"),
        F.stddev_samp("net_out").alias("sd_net"),
        F.try_divide(F.sum("arr"), F.sum("dep")).alias("in_over_out"),
        F.count_if(F.col("net_out") > 0).alias("days_net_out"),
        F.sum("net_out").alias("_net"),
    )
    role = F.when(F.col("_net") > 0, "source").when(F.col("_net") < 0, "sink").otherwise("balanced")
    return summary.withColumn("role", role).drop("_net")


def od_matrix(od: DataFrame, days: DataFrame) -> DataFrame:
    """Mean trips per target day of every origin-destination pair that occurs."""
    n_days = days.agg(F.count("*")).scalar()
    pairs = od.groupBy("sgp", "egp").agg(F.sum("n").alias("trips"))
    return pairs.withColumn("per_day", F.col("trips") / n_days)


def od_wide(od: DataFrame, days: DataFrame, gps: list[str]) -> DataFrame:
    """Export shape: one row per origin, one column per destination, zero where nothing went."""
    n_days = days.agg(F.count("*")).scalar()
    wide = od.groupBy("sgp").agg(
        *[(F.coalesce(F.sum(F.when(F.col("egp") == g, F.col("n"))), F.lit(0))).alias(g) for g in gps]
    )
    return wide.select("sgp", *[(F.col(g) / n_days).alias(g) for g in gps])


def group_boundary_events(grouped: DataFrame, types: DayTypes, horizon: Horizon = MORNING) -> DataFrame:
    """Trips between a group and the outside, dated by the end that is in a group.

    The trip's start date decides whether the day counts.
    """
    leaving = F.col("sgp").isNotNull() & F.col("egp").isNull()
    crossing = grouped.where(types.is_target(F.col("date")) & (F.col("sgp").isNull() != F.col("egp").isNull()))
    events = crossing.select(
        F.coalesce("sgp", "egp").alias("gp"),
        F.when(leaving, F.col("start_time")).otherwise(F.col("end_time")).alias("ts"),
        leaving.alias("out"),
    ).where(in_window(F.col("ts"), horizon))
    return events.groupBy("gp", F.to_date("ts").alias("date")).agg(
        F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in")
    )


def group_boundary_daily(events: DataFrame, days: DataFrame) -> DataFrame:
    """Boundary flow per target day; at most one row per calendar day."""
    daily = events.groupBy("date").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    filled = days.select("date").join(daily, "date", "left").fillna(0, ["n_out", "n_in"])
    return filled.withColumns(
        {
            "net_in": F.col("n_in") - F.col("n_out"),
            "in_over_out": F.try_divide("n_in", F.expr("nullif(n_out, 0)")),
        }
    )


def group_boundary_summary(events: DataFrame, gps: DataFrame, days: DataFrame) -> DataFrame:
    """Boundary flow per group and target day; every event counts, as in the event table."""
    n_days = days.agg(F.count("*")).scalar()
    sums = events.groupBy("gp").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    filled = gps.select("gp").join(sums, "gp", "left").fillna(0, ["n_out", "n_in"])
    return filled.select(
        "gp",
        (F.col("n_out") / n_days).alias("out_day"),
        (F.col("n_in") / n_days).alias("in_day"),
        ((F.col("n_out") - F.col("n_in")) / n_days).alias("net_out_day"),
        F.try_divide("n_in", F.expr("nullif(n_out, 0)")).alias("in_over_out"),
    )


def top_pairs(matrix: DataFrame, n: int) -> DataFrame:
    """Busiest ordered pairs; each task keeps n rows."""
    return matrix.where("sgp <> egp and trips > 0").orderBy(F.desc("trips"), "sgp", "egp").limit(n)


def ranked_groups(summary: DataFrame, n: int) -> DataFrame:
    """The strongest sources and sinks."""
    sources = summary.orderBy(F.desc("net_day"), "gp").limit(n).select(F.lit("source").alias("list"), "gp", "net_day")
    sinks = summary.orderBy("net_day", "gp").limit(n).select(F.lit("sink").alias("list"), "gp", "net_day")
    return sources.unionByName(sinks)


def typical_day(imbalance: DataFrame) -> DataFrame:
    """The day whose gross imbalance is closest to the median day's; the earliest of equals."""
    median = imbalance.agg(F.percentile("gross_imbalance", F.lit(0.5))).scalar()
    off = imbalance.withColumn("median", median).withColumn("distance", F.abs(F.col("gross_imbalance") - F.col("median")))
    best = off.agg(F.min(F.struct("distance", "date", "gross_imbalance", "median")).alias("b"))
    return best.select("b.date", "b.gross_imbalance", "b.median", "b.distance")
