"""Quality flags, drop policy and audit tables.

A flag is a boolean column that is never NULL; nothing is removed until a policy says so.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.functions import clock
from tripweave.functions import geohash as gh
from tripweave.operators.annotate import annotate
from tripweave.operators.joins import lookup
from tripweave.operators.ranking import exact_quantiles
from tripweave.session import write_through

REQUIRED = ["action_dt", "order_id", "bike_id", "start_time", "end_time", "start_geohash", "end_geohash"]

# The tier of every flag (None is informational and never drops a row).
TIERS = {
    "qc_unparsed": 0,
    "qc_null_required": 0,
    "qc_dup_order": 0,
    "qc_bad_geohash": 0,
    "qc_neg_dur": 1,
    "qc_zero_dur": 1,
    "qc_speed_gt_30": 1,
    "qc_cross_region": 1,
    "qc_dur_gt_180": 2,
    "qc_anomaly_day": 2,
    "qc_outside_window": 2,
    "qc_dur_gt_60": None,
    "qc_same_geohash": None,
}
FLAGS = list(TIERS)


@dataclass(frozen=True)
class Policy:
    """Thresholds, and which flags remove a row."""

    max_speed_kmh: float = 30.0
    prefix_length: int = 4
    min_prefix_share: float = 0.001
    long_minutes: float = 180.0
    info_minutes: float = 60.0
    low_day_ratio: float = 0.5
    study_start: date | None = None
    study_end: date | None = None
    released: tuple[str, ...] = ()

    def drop_flags(self) -> list[str]:
        return [f for f, tier in TIERS.items() if tier is not None and f not in self.released]

    def tag(self) -> str:
        """Output tag of a non-default policy."""
        names = {"qc_zero_dur": "keepzerodur", "qc_anomaly_day": "keepanomday"}
        return "_".join(names.get(f, "keep-" + f) for f in self.released)


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def missing_columns(raw: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in raw.columns]


def parse(raw: DataFrame) -> DataFrame:
    """Flags of each raw row by itself, with both times parsed and the text kept as *_text."""
    if missing_columns(raw):
        raise ValueError(f"input lacks the columns {missing_columns(raw)}")
    blank = reduce(or_, [F.coalesce(F.col(c), F.lit("")) == "" for c in REQUIRED])
    parsed = raw.withColumns(
        {
            "start_time_text": F.col("start_time"),
            "end_time_text": F.col("end_time"),
            "qc_null_required": blank,
            "qc_bad_geohash": ~(gh.is_cell8(F.col("start_geohash")) & gh.is_cell8(F.col("end_geohash"))),
        }
    ).withColumns(
        {
            "start_time": clock.parse_minute(F.col("start_time_text")),
            "end_time": clock.parse_minute(F.col("end_time_text")),
        }
    )
    return parsed.withColumn("qc_unparsed", F.col("start_time").isNull() | F.col("end_time").isNull())


def structural(raw: DataFrame) -> DataFrame:
    """The parsed rows with the flag of repeated keys, which counts all keys first."""
    return flag_duplicates(parse(raw), "order_id", "qc_dup_order")


def flag_duplicates(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Flag every copy of a repeated key.

    The keys are counted with partial sums, so a key that fills much of the table reaches no single
    task; only the repeated keys come back, through a size-checked lookup.
    """
    repeated = df.groupBy(key).count().where("count > 1").select(key, F.lit(True).alias(flag))
    repeated = write_through(repeated)
    return lookup(df, repeated, [key]).withColumn(flag, _sure(F.col(flag)))


def tally(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Trips per date and prefixes of both ends, written once: both side tables below read it instead of the trips.

    Its size depends on days and prefixes, not on trips.
    """
    prefixes = {f"{side}_geohash": F.substring(f"{side}_geohash", 1, policy.prefix_length) for side in ("start", "end")}
    counted = df.select("date", *[c.alias(n) for n, c in prefixes.items()]).groupBy("date", *prefixes).agg(F.count("*").alias("trips"))
    return write_through(counted)


def prefix_shares(df: DataFrame, policy: Policy = Policy(), weight: str | None = None) -> DataFrame:
    """Share of trip ends per cell prefix, both ends pooled, and whether the prefix is kept. A row counts once, or as often
    as its weight column says."""
    size = policy.prefix_length
    times = F.lit(1) if weight is None else F.col(weight)
    ends = df.select(
        times.alias("_times"), F.explode(F.array(F.substring("start_geohash", 1, size), F.substring("end_geohash", 1, size))).alias("prefix")
    )
    counts = ends.groupBy("prefix").agg(F.sum("_times").alias("n"))
    total = df.agg(2 * (F.count("*") if weight is None else F.sum(weight))).scalar()
    return counts.withColumn("share", F.col("n") / total).withColumn("kept", F.col("share") >= policy.min_prefix_share)


def daily_baseline(df: DataFrame, policy: Policy = Policy(), weight: str | None = None) -> DataFrame:
    """Trips per day against a centred seven-row median; at most one row per calendar day."""
    daily = df.where("date is not null").groupBy("date").agg((F.count("*") if weight is None else F.sum(weight)).alias("trips"))
    near = W.orderBy("date").rowsBetween(-3, 3)
    overall = daily.agg(F.percentile("trips", F.lit(0.5))).scalar()
    local = F.when(F.count("trips").over(near) >= 3, F.percentile("trips", F.lit(0.5)).over(near))
    rated = daily.withColumn("baseline", F.coalesce(local, overall)).withColumn(
        "ratio", F.try_divide(F.col("trips"), F.col("baseline"))
    )
    return rated.withColumn("low", _sure(F.col("ratio") < policy.low_day_ratio))


def derived_flags(df: DataFrame, policy: Policy = Policy(), basis: DataFrame | None = None) -> DataFrame:
    """Flags of the annotated columns. The two that need totals come from small side tables.

    Those are counted on `basis` (date and both cells of the same trips) where one is given, so that
    they read three columns instead of carrying the annotation along.
    """
    counts = tally(df if basis is None else basis, policy)
    minutes = F.col("duration_min")
    outside = F.lit(False)
    if policy.study_start is not None:
        outside = outside | (F.col("date") < F.lit(policy.study_start))
    if policy.study_end is not None:
        outside = outside | (F.col("date") > F.lit(policy.study_end))
    flagged = df.withColumns(
        {
            "qc_neg_dur": _sure(minutes < 0),
            "qc_zero_dur": _sure(minutes == 0),
            "qc_speed_gt_30": _sure(F.col("implied_speed_kmh") > policy.max_speed_kmh),
            "qc_dur_gt_60": _sure(minutes > policy.info_minutes),
            "qc_dur_gt_180": _sure(minutes > policy.long_minutes),
            "qc_same_geohash": _sure(F.col("is_same_cell")),
            "qc_outside_window": _sure(outside),
        }
    )
    # A kept prefix holds at least min_prefix_share of all ends, so at most 1/min_prefix_share exist.
    kept = prefix_shares(counts, policy, "trips").where("kept").select("prefix")
    for side in ("start", "end"):
        found = F.broadcast(kept.select(F.col("prefix").alias(f"_{side}"), F.lit(True).alias(f"_{side}_in")))
        prefix = F.substring(f"{side}_geohash", 1, policy.prefix_length)
        flagged = flagged.withColumn(f"_{side}", prefix).join(found, f"_{side}", "left")
    flagged = flagged.withColumn(
        "qc_cross_region", F.col("_start_in").isNull() | F.col("_end_in").isNull()
    ).drop("_start", "_end", "_start_in", "_end_in")
    # One row per calendar day at most.
    low = F.broadcast(daily_baseline(counts, policy, "trips").where("low").select("date", F.lit(True).alias("qc_anomaly_day")))
    return flagged.join(low, "date", "left").withColumn("qc_anomaly_day", _sure(F.col("qc_anomaly_day")))


def flag_all(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Raw text trips to annotated trips with all thirteen flags; every row is kept."""
    basis = raw.select("start_geohash", "end_geohash", F.to_date(clock.parse_minute(F.col("start_time"))).alias("date"))
    return derived_flags(annotate(structural(raw)), policy, basis)


def apply_policy(flagged: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Rows that no dropping flag hits."""
    return flagged.where(~reduce(or_, [F.col(f) for f in policy.drop_flags()]))


def _hits(flag: Column) -> Column:
    return F.count_if(flag)


def flag_audit(flagged: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Rows and percentage per flag, its tier and whether the policy applies it; one pass."""
    dropping = policy.drop_flags()
    row = flagged.agg(F.count("*").alias("total"), *[_hits(F.col(f)).alias(f) for f in FLAGS])
    lines = F.array(
        *[
            F.struct(
                F.lit(f).alias("flag"),
                F.lit(TIERS[f]).cast("int").alias("tier"),
                F.lit(f in dropping).alias("applied"),
                F.col(f).alias("n"),
                F.try_divide(F.lit(100.0) * F.col(f), F.col("total")).alias("pct"),
            )
            for f in FLAGS
        ]
    )
    return row.select(F.inline(lines))


def flag_summary(flagged: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Rows with no, one or several flags, and what the policy drops."""
    hits = reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in FLAGS])
    dropped = reduce(or_, [F.col(f) for f in policy.drop_flags()])
    zero, same = F.col("qc_zero_dur"), F.col("qc_same_geohash")
    return flagged.agg(
        F.count("*").alias("rows_in"),
        _hits(~dropped).alias("rows_out"),
        _hits(dropped).alias("rows_dropped"),
        _hits(hits == 0).alias("rows_no_flag"),
        _hits(hits == 1).alias("rows_one_flag"),
        _hits(hits >= 2).alias("rows_more_flags"),
        _hits(zero).alias("zero_minute"),
        _hits(zero & ~same).alias("zero_minute_moved"),
    )


def geohash_lengths(raw: DataFrame) -> DataFrame:
    """Histogram of text length over both ends."""
    sizes = F.explode(F.array(F.length("start_geohash"), F.length("end_geohash"))).alias("length")
    return raw.select(sizes).groupBy("length").agg(F.count("*").alias("n"))


def redundant_date(parsed: DataFrame) -> DataFrame:
    """Does action_dt repeat the start date, as a date and as padded text? NULL counts as different."""
    action = F.to_date(F.try_to_timestamp("action_dt", F.lit("yyyy/M/d")))
    day = F.to_date("start_time")
    return parsed.agg(
        _hits(~_sure(action == day)).alias("date_mismatches"),
        _hits(~_sure(F.trim("action_dt") == F.date_format("start_time", "yyyy/MM/dd"))).alias("text_differs"),
    )


def blank_counts(raw: DataFrame) -> DataFrame:
    """Blank values per required column."""
    row = raw.agg(*[_hits(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in REQUIRED])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("blanks")) for c in REQUIRED])
    return row.select(F.inline(pairs))


def time_coverage(df: DataFrame) -> DataFrame:
    """First and last times, observed and missing dates, span."""
    return df.agg(
        F.min("start_time").alias("start_first"),
        F.max("start_time").alias("start_last"),
        F.min("end_time").alias("end_first"),
        F.max("end_time").alias("end_last"),
        F.count_distinct("date").alias("distinct_dates"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("span_days"),
    ).withColumn("missing_dates", F.col("span_days") - F.col("distinct_dates"))


def missing_dates(df: DataFrame) -> DataFrame:
    """Calendar days inside the span without any trip."""
    days = df.select("date").where("date is not null").distinct()
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("date"))
    return calendar.join(days, "date", "left_anti")


def weekday_counts(df: DataFrame) -> DataFrame:
    return df.where("dow is not null").groupBy("dow").agg(F.count("*").alias("n"))


# Quantile levels of the duration report.
DURATION_LEVELS = {"q00": 0.0, "q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99, "q100": 1.0}


def profile(df: DataFrame, columns: list[str], levels: dict[str, float] = DURATION_LEVELS) -> DataFrame:
    """Size, mean, sample spread, range, coefficient of variation and exact quantiles per column.

    The columns are stacked, so the table is read once for the moments and once for the quantiles.
    """
    stacked = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
    known = df.select(F.inline(stacked)).where("value is not null")
    spread = known.groupBy("variable").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("var"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ).withColumn("cv", F.try_divide("std", "mean"))
    quantiles = exact_quantiles(known, "value", levels, ["variable"])
    # One row per column on both sides.
    return spread.join(F.broadcast(quantiles), "variable")
