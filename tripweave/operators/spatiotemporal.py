"""Cell-by-hour balances, roles, dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.operators.domain import densify, observed_days
from tripweave.operators.ranking import exact_quantiles


def cell_hours(trips: DataFrame) -> DataFrame:
    """Departures and arrivals per (cell, date, hour): the one reduction of the trips below.

    Both ends carry the trip's own start date and hour. Write it through once and read it many times.
    """
    ends = F.array(
        F.struct(F.col("start_cell6").alias("cell"), F.lit(1).alias("dep"), F.lit(0).alias("arr")),
        F.struct(F.col("end_cell6").alias("cell"), F.lit(0).alias("dep"), F.lit(1).alias("arr")),
    )
    both = trips.select("date", "hour", F.inline(ends))
    return both.groupBy("cell", "date", "hour").agg(F.sum("dep").alias("dep"), F.sum("arr").alias("arr"))


def weekdays_only(hours: DataFrame) -> DataFrame:
    return hours.where(F.weekday("date") < 5)


def busiest_cells(hours: DataFrame, n: int) -> DataFrame:
    """The n most touched cells; equals in cell order. Never more than n rows."""
    touching = hours.groupBy("cell").agg(F.sum(F.col("dep") + F.col("arr")).alias("n_touching"))
    return touching.orderBy(F.desc("n_touching"), "cell").limit(n)


def cell_hour_flows(hours: DataFrame, cells: DataFrame, min_gross: float) -> DataFrame:
    """Per (cell, hour): departures, arrivals, net and gross per observed day, balance where gross is enough.

    `cells` has at most a top-N of rows; every cell gets all 24 hours.
    """
    days = hours.agg(F.count_distinct("date")).scalar()
    counts = hours.groupBy("cell", "hour").agg(F.sum("dep").alias("dep"), F.sum("arr").alias("arr"))
    grid = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    filled = grid.join(counts, ["cell", "hour"], "left").fillna(0, ["dep", "arr"])
    net, gross = (F.col("dep") - F.col("arr")) / days, (F.col("dep") + F.col("arr")) / days
    rated = filled.withColumns({"net_out_day": net, "gross_day": gross})
    return rated.withColumn(
        "balance", F.when(F.col("gross_day") >= min_gross, F.try_divide("net_out_day", "gross_day"))
    )


def roles(flows: DataFrame, morning=(7, 8, 9), evening=(17, 18, 19), eps: float = 1.0) -> DataFrame:
    """Morning and evening mean net outflow per cell, with a role and a reading."""
    means = flows.groupBy("cell").agg(
        F.avg(F.when(F.col("hour").isin(*morning), F.col("net_out_day"))).alias("net_am"),
        F.avg(F.when(F.col("hour").isin(*evening), F.col("net_out_day"))).alias("net_pm"),
    )
    a, p = F.col("net_am"), F.col("net_pm")
    weak_a, weak_p = F.abs(a) < eps, F.abs(p) < eps
    role = (
        F.when(weak_a & weak_p, "flat")
        .when(weak_a | weak_p, "one-sided")
        .when(F.signum(a) != F.signum(p), "reversed")
        .otherwise("same")
    )
    reading = F.when((a > eps) & (p < -eps), "workplace").when((a < -eps) & (p > eps), "residential").otherwise("")
    return means.withColumns({"role": role, "reading": reading})


def anchor_net(hours: DataFrame, anchors: list[int]) -> DataFrame:
    """Net outflow per observed day of each cell at a few clock hours."""
    days = hours.agg(F.count_distinct("date")).scalar()
    at = hours.where(F.col("hour").isin(*anchors))
    net = at.groupBy("cell", "hour").agg(F.sum(F.col("dep") - F.col("arr")).alias("_n"))
    return net.select("cell", "hour", (F.col("_n") / days).alias("net_out_day"))


def hourly_departures(hours: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Complete (cell, observed day, hour) grid of departures; `cells` is a top-N, or every origin if None."""
    sparse = hours.where("dep > 0").select("cell", "date", "hour", F.col("dep").alias("n"))
    if cells is None:
        return densify(sparse, ["cell"], observed_days(hours), "hour", 24, ["n"])
    # A top-N of cells.
    few = F.broadcast(cells.select("cell"))
    kept = sparse.join(few, "cell", "left_semi")
    return densify(kept, ["cell"], observed_days(hours), "hour", 24, ["n"], few)


def cell_hour_stats(panel: DataFrame) -> DataFrame:
    """Across days per (cell, hour): size, mean, sample spread, total, exact p50 and p90, ratios.

    A group has one row per day, so the built-in exact percentile stays small.
    """
    stats = panel.groupBy("cell", "hour").agg(
        F.count("*").alias("n_days"),
        F.avg("n").alias("mean"),
        F.var_samp("n").alias("var"),
        F.stddev_samp("n").alias("std"),
        F.sum("n").alias("total"),
        F.percentile("n", F.array(F.lit(0.5), F.lit(0.9))).alias("q"),
    )
    return stats.select(
        "cell", "hour", "n_days", "mean", "var", "std", "total",
        F.element_at("q", 1).alias("p50"), F.element_at("q", 2).alias("p90"),
        F.expr("std / nullif(mean, 0)").alias("cv"), F.expr("var / nullif(mean, 0)").alias("var_over_mean"),
    )


def peak_hour_rows(stats: DataFrame) -> DataFrame:
    """Each cell's row at its busiest hour, the first of equals; a cell has 24 rows."""
    order = W.partitionBy("cell").orderBy(F.desc("mean"), "hour")
    return stats.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dispersion_fit(stats: DataFrame, min_mean: float) -> DataFrame:
    """Log-log slope of variance on mean, share above the Poisson line, median ratio."""
    d = stats.where((F.col("mean") >= min_mean) & (F.col("var") > 0))
    middle = exact_quantiles(d, "var_over_mean", {"median_var_over_mean": 0.5})
    fit = d.agg(
        F.count("*").alias("n"),
        F.regr_slope(F.ln("var"), F.ln("mean")).alias("slope"),
        F.regr_intercept(F.ln("var"), F.ln("mean")).alias("intercept"),
        # A variance equal to the mean up to rounding is on the line, not above it.
        F.avg((F.col("var") > F.col("mean") * (1 + 1e-9)).cast("int")).alias("above_poisson"),
    )
    return fit.withColumn("median_var_over_mean", middle.scalar())


def symmetric_limit(df: DataFrame, column: str, q: float = 0.98, floor: float = 1.0) -> DataFrame:
    """Robust symmetric limit: a quantile of the magnitude, not below `floor`, and how many exceed it."""
    sizes = df.select(F.abs(column).alias("v"), F.col(column))
    limit = exact_quantiles(sizes, "v", {"q": q}).select(F.greatest("q", F.lit(floor)).alias("q"))
    return sizes.withColumn("lim", limit.scalar()).agg(
        F.max("lim").alias("limit"), F.count("*").alias("n"), F.count_if(F.col("v") > F.col("lim")).alias("saturated")
    )
