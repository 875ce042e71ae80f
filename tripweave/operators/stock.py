"""Stock at the start of the morning: lower bounds, overnight prior, allocation, capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tripweave.functions.clock import MORNING, DayTypes, Horizon, minute_of_day
from tripweave.operators.domain import densify, numbered
from tripweave.session import write_through

# Overnight hours, and the tolerances of the allocation.
LATE_HOURS = (22, 23)
EARLY_HOURS = (0, 1, 2, 3, 4, 5)
WEIGHT_FLOOR = 1e-9
FREE_FLOOR = 1e-12
SLACK = 1e-9


def observed_workdays(grouped: DataFrame, types: DayTypes) -> DataFrame:
    """Distinct start dates that are working days, half days included."""
    return grouped.select("date").distinct().where(types.is_workday(F.col("date")))


def stock_days(workdays: DataFrame, types: DayTypes) -> DataFrame:
    """Observed target days, numbered."""
    return numbered(workdays.where(types.is_target(F.col("date"))))


def group_ends(grouped: DataFrame) -> DataFrame:
    """Both ends as (gp, ts, dep, arr), ends outside every group dropped."""
    ends = F.array(
        F.struct(F.col("sgp").alias("gp"), F.col("start_time").alias("ts"), F.lit(1).alias("dep"), F.lit(0).alias("arr")),
        F.struct(F.col("egp").alias("gp"), F.col("end_time").alias("ts"), F.lit(0).alias("dep"), F.lit(1).alias("arr")),
    )
    return grouped.select(F.inline(ends)).where("gp is not null")


def step_counts(grouped: DataFrame, width: int = 30) -> DataFrame:
    """Departures and arrivals per (gp, date, step of the day): the one reduction of the trips below.

    Each end has its own date and clock. Write it through once and read it many times.
    """
    ends = group_ends(grouped).withColumn("step", F.floor(minute_of_day(F.col("ts")) / width).cast("int"))
    return ends.groupBy("gp", F.to_date("ts").alias("date"), "step").agg(F.sum("dep").alias("dep"), F.sum("arr").alias("arr"))


def slot_panel(steps: DataFrame, gps: DataFrame, days: DataFrame, horizon: Horizon = MORNING, width: int = 30) -> DataFrame:
    """Complete (gp, date, slot) departures and arrivals over a horizon made of whole steps."""
    if horizon.start % width or horizon.width % width:
        raise ValueError(f"the horizon does not consist of whole {width}-minute steps")
    slot = F.floor((F.col("step") * width - horizon.start) / horizon.width).cast("int")
    inside = steps.withColumn("slot", slot).where(F.col("slot").between(0, horizon.n_slots - 1))
    sparse = inside.groupBy("gp", "date", "slot").agg(F.sum("dep").alias("dep"), F.sum("arr").alias("arr"))
    return densify(sparse, ["gp"], days, "slot", horizon.n_slots, ["dep", "arr"], gps).drop("day_position")


def _hour(width: int):
    return F.floor(F.col("step") * width / 60).cast("int")


def hour_window(steps: DataFrame, gps: DataFrame, days: DataFrame, hours, width: int = 30) -> DataFrame:
    """Complete (gp, date) departures and arrivals inside clock hours."""
    sparse = steps.where(_hour(width).isin(*hours)).groupBy("gp", "date").agg(F.sum("dep").alias("dep"), F.sum("arr").alias("arr"))
    dense = densify(sparse.withColumn("slot", F.lit(0)), ["gp"], days, "slot", 1, ["dep", "arr"], gps)
    return dense.select("gp", "date", "dep", "arr")


def daily_need(panel: DataFrame) -> DataFrame:
    """Per (gp, date): the largest shortfall if the morning started empty.

    Departures up to a slot against arrivals before it; a group has one row per slot.
    """
    order = W.partitionBy("gp", "date").orderBy("slot")
    out = F.sum("dep").over(order.rowsBetween(W.unboundedPreceding, 0))
    back = F.coalesce(F.sum("arr").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    short = panel.withColumn("need", F.greatest(out - back, F.lit(0)))
    return short.groupBy("gp", "date").agg(F.max("need").alias("need"))


def lower_bounds(panel: DataFrame) -> DataFrame:
    """m per group: mean daily need."""
    return daily_need(panel).groupBy("gp").agg(F.avg("need").alias("m"))


def previous_workdays(workdays: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target day with the working day before it; one row per calendar day at most."""
    paired = workdays.select("date", F.lag("date").over(W.orderBy("date")).alias("previous"))
    return paired.where("previous is not null").join(targets.select("date"), "date", "left_semi")


def overnight_prior(steps: DataFrame, gps: DataFrame, pairs: DataFrame, width: int = 30) -> DataFrame:
    """w per group: positive net arrivals from late on the previous workday to early on the day.

    A night on which no group gains counts arrivals instead.
    """
    hour = _hour(width)
    counts = steps.where(hour.isin(*LATE_HOURS, *EARLY_HOURS)).select(
        "gp", F.col("date").alias("seen"), hour.isin(*LATE_HOURS).alias("late"), "dep", "arr"
    )
    parts = F.array(
        F.struct(F.col("previous").alias("seen"), F.lit(True).alias("late"), F.col("date").alias("night")),
        F.struct(F.col("date").alias("seen"), F.lit(False).alias("late"), F.col("date").alias("night")),
    )
    # Two rows per target day.
    nights = F.broadcast(pairs.select(F.inline(parts)))
    per_night = counts.join(nights, ["seen", "late"]).groupBy("night", "gp").agg(
        F.sum("arr").alias("arr"), F.greatest(F.sum("arr") - F.sum("dep"), F.lit(0)).alias("gain")
    )
    gained = F.sum("gain").over(W.partitionBy("night"))
    used = per_night.withColumn("w", F.when(gained == 0, F.col("arr")).otherwise(F.col("gain")))
    sums = used.groupBy("gp").agg(F.sum("w").alias("w"))
    return gps.select("gp").join(sums, "gp", "left").fillna(0, ["w"])


def allocate(groups: DataFrame, scenario: list[str], parts: int = 64) -> DataFrame:
    """Split `total` over groups in proportion to `w`, never below the floor `m`.

    A floor presses with m / a, where a is the group's proportional part. Groups that press harder than the rate at which all
    others are filled sit on their floors. That rate is found without ordering the groups: a pass sums floors and parts over
    `parts` ranges of the pressures still in question, and tells for each boundary on which side of it the rate lies, see
    _narrow. Passes end when no pressure is left between the bounds. Only these sums, one row per scenario and range, reach the
    driver; a scenario is a parameter, so there are few. Adds `stock` and `pinned`.

    Without any weight all groups weigh the same. A total below the sum of the floors pins every group.
    """
    keyed = write_through(_pressures(groups, scenario))
    # Parts add up to the total, so the rate is at most one.
    bounds = {tuple(r): (0.0, 1.0) for r in keyed.select(*scenario).distinct().collect()}
    solved: dict[tuple, tuple[float, float | None]] = {}
    while bounds:
        sums: dict[tuple, dict[int, Row]] = {key: {} for key in bounds}
        for r in _range_sums(keyed, bounds, scenario, parts).collect():
            sums[tuple(r[c] for c in scenario)][r["_part"]] = r
        for key, (low, high) in list(bounds.items()):
            *bounds[key], rate, done = _narrow(low, high, sums[key], parts)
            if done:
                solved[key] = (bounds.pop(key)[1], rate)
    joined = _with_scenario_values(keyed, solved, scenario, ("_limit", "_rate"))
    pinned = F.col("_rate").isNull() | (F.col("_press") > F.col("_limit"))
    stock = F.when(pinned, F.col("m")).otherwise(F.col("_a") * F.col("_rate"))
    return joined.select(*groups.columns, stock.alias("stock"), pinned.alias("pinned"))


def _pressures(groups: DataFrame, scenario: list[str]) -> DataFrame:
    """Each group's proportional part of its scenario's total, and how hard its floor presses on it."""

    def with_sum(df: DataFrame, value: str, name: str) -> DataFrame:
        sums = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in scenario]).agg(F.sum(value).alias(name))
        # One row per scenario.
        return df.join(F.broadcast(sums), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in scenario]).drop(*sums.columns[:-1])

    weight = F.greatest(F.try_divide("w", "_all_w").cast("double"), F.lit(WEIGHT_FLOOR))
    weighted = with_sum(groups, "w", "_all_w").withColumn("_v", weight)
    made = with_sum(weighted, "_v", "_all_v").withColumn("_a", F.col("total") * F.col("_v") / F.col("_all_v"))
    press = F.when(F.col("m") <= 0, 0.0).otherwise(F.coalesce(F.try_divide("m", "_a"), F.lit(float("inf"))))
    return made.withColumn("_press", press).drop("_all_w", "_v", "_all_v")


def _with_scenario_values(keyed: DataFrame, values: dict[tuple, tuple], scenario: list[str], names: tuple[str, ...]) -> DataFrame:
    fields = [StructField(f"_k_{c}", keyed.schema[c].dataType) for c in scenario] + [StructField(n, DoubleType()) for n in names]
    small = keyed.sparkSession.createDataFrame([(*key, *found) for key, found in values.items()], StructType(fields))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in scenario]
    return keyed.join(F.broadcast(small), on).drop(*[f"_k_{c}" for c in scenario])


def _range_sums(keyed: DataFrame, bounds: dict[tuple, tuple[float, float]], scenario: list[str], parts: int) -> DataFrame:
    """Floors, parts and groups per scenario and range: range 0 ends at the low bound, range parts + 1 begins above the high one."""
    joined = _with_scenario_values(keyed, bounds, scenario, ("_low", "_high"))
    press, low, high = F.col("_press"), F.col("_low"), F.col("_high")
    inside = F.least(F.greatest(F.ceil((press - low) / (high - low) * parts), F.lit(1)), F.lit(parts))
    part = F.when(press <= low, 0).when(press > high, parts + 1).otherwise(inside).cast("int")
    sums = F.max("total").cast("double").alias("total"), F.sum("m").cast("double").alias("m"), F.sum("_a").alias("a"), F.count("*").alias("n")
    return joined.groupBy(*scenario, part.alias("_part")).agg(*sums)


def _narrow(low: float, high: float, sums: dict[int, Row], parts: int) -> tuple[float, float, float | None, bool]:
    """Bounds of the rate after a pass, the rate with all groups above the high bound pinned, and whether that is the answer.

    With all groups pinned that press harder than s, the others are filled at a rate r(s). Where r(s) >= s the rate sought is at
    least s; otherwise it is at most r(s). r is None where no group is left to fill.
    """
    total, floors = next(iter(sums.values()))["total"], sum(r["m"] for r in sums.values())
    if total < floors - SLACK * max(1.0, floors):
        return low, low, None, True
    new_low, new_high, rate = low, high, None
    # What the groups up to a boundary share: the spare total and their own floors.
    need, free = total - floors, 0.0
    for k in range(parts + 1):
        if k in sums:
            need, free = need + sums[k]["m"], free + sums[k]["a"]
        edge = low + (high - low) * k / parts
        rate = need / free if free > FREE_FLOOR else None
        if rate is None or rate >= edge:
            new_low = max(new_low, edge)
        else:
            new_high = min(new_high, rate)
    if high - low <= SLACK * high or not any(0 < k <= parts for k in sums):
        return low, high, rate, True
    return min(new_low, new_high), new_high, rate, False


def check_feasible(groups: DataFrame, total: float) -> None:
    """Refuse a total below the sum of the floors."""
    least = groups.agg(F.sum("m")).first()[0] or 0.0
    if total < least - SLACK:
        raise ValueError(f"a total of {total} cannot cover lower bounds that add up to {least}")


def feasibility(scenario_rows: DataFrame) -> DataFrame:
    """Per scenario: its total, the sum of the floors, and whether the floors fit."""
    sums = scenario_rows.groupBy("factor").agg(F.max("total").alias("total"), F.sum("m").alias("least"))
    return sums.withColumn("feasible", F.col("total") >= F.col("least") - SLACK)


def scenarios(bounds: DataFrame, factors: list[float]) -> DataFrame:
    """Every group once per total, the totals being multiples of the sum of the floors."""
    least = bounds.agg(F.sum("m")).scalar()
    totals = F.array(*[F.struct(F.lit(float(f)).alias("factor"), (F.lit(float(f)) * F.col("_least")).alias("total")) for f in factors])
    return bounds.withColumn("_least", least).select("gp", "m", "w", F.inline(totals))


def scenario_report(allocated: DataFrame) -> DataFrame:
    """Per total: allocated sum, groups on their floor, largest stock."""
    return allocated.groupBy("factor").agg(
        F.max("total").alias("total"),
        F.sum("stock").alias("allocated"),
        F.count_if("pinned").alias("on_floor"),
        F.max("stock").alias("max_stock"),
    )


def trajectories(panel: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock before and after every slot of every day, without rebalancing."""
    order = W.partitionBy("gp", "date").orderBy("slot")
    gain = F.col("arr") - F.col("dep")
    joined = panel.join(stock.select("gp", "stock"), "gp")
    return joined.withColumns(
        {
            "before": F.col("stock") + F.coalesce(F.sum(gain).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "after": F.col("stock") + F.sum(gain).over(order.rowsBetween(W.unboundedPreceding, 0)),
        }
    )


def capacity(paths: DataFrame) -> DataFrame:
    """Smallest whole capacity that never binds, and the days on which stock runs out."""
    by_day = paths.groupBy("gp", "date").agg(
        F.max("after").alias("peak"), F.max("stock").alias("stock"),
        F.bool_or(F.col("before") - F.col("dep") < -SLACK).alias("short"),
    )
    return by_day.groupBy("gp").agg(
        F.ceil(F.greatest(F.max("stock"), F.max("peak"))).cast("long").alias("q"),
        F.count_if("short").alias("short_days"),
    )
