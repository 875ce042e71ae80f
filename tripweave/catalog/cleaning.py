"""Queries over raw trip text: parsing, flags, policy, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.catalog.base import TRIPS_SQL, query, raw_trips, rounded, sql_haversine, trips, trips_sql
from tripweave.functions import geohash as gh
from tripweave.operators import qc
from tripweave.operators.annotate import annotate

RELEASED = qc.Policy(released=("qc_zero_dur", "qc_anomaly_day"))

# The faults of raw_trips, restated on the trips themselves.
RAW_SQL = f"""{TRIPS_SQL},
raw AS (
  SELECT strftime(start_time, '%Y/%-m/%-d') AS action_dt,
         CASE WHEN order_id % 3 = 0 THEN '' WHEN order_id % 499 = 1 THEN CAST(order_id + 1 AS VARCHAR)
              ELSE CAST(order_id AS VARCHAR) END AS order_key,
         CAST(bike_id AS VARCHAR) AS bike_id,
         CASE WHEN order_id % 991 = 0 THEN NULL ELSE start_time END AS t0,
         CASE WHEN order_id % 977 = 0 THEN start_time - INTERVAL 5 MINUTE ELSE end_time END AS t1,
         CASE WHEN order_id % 983 = 0 THEN 'a' || substr(start_geohash, 2) ELSE start_geohash END AS g0,
         CASE WHEN order_id % 971 = 0 THEN substr(end_geohash, 1, 6) ELSE end_geohash END AS g1,
         order_id % 983 = 0 AS broken0, order_id % 971 = 0 AS broken1, s_i, s_j, e_i, e_j,
         start_lat, start_lon, end_lat, end_lon
  FROM trips),
measured AS (
  SELECT *, (epoch(t1) - epoch(t0)) / 60.0 AS minutes, CAST(t0 AS DATE) AS date,
         CASE WHEN broken0 OR broken1 THEN NULL
              ELSE {sql_haversine('start_lat', 'start_lon', 'end_lat', 'end_lon')} END AS km
  FROM raw),
prefixes AS (
  SELECT prefix, count(*) AS n FROM (SELECT substr(g0, 1, 4) AS prefix FROM raw UNION ALL SELECT substr(g1, 1, 4) FROM raw) GROUP BY 1),
shares AS (SELECT prefix, n, n / (SELECT sum(n) FROM prefixes) AS share FROM prefixes),
daily AS (SELECT date, count(*) AS trips FROM measured WHERE date IS NOT NULL GROUP BY 1),
rated0 AS (
  SELECT date, trips, count(*) OVER w AS around, quantile_cont(trips, 0.5) OVER w AS med
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
rated AS (
  SELECT date, trips, CASE WHEN around >= 3 THEN med ELSE (SELECT quantile_cont(trips, 0.5) FROM daily) END AS baseline FROM rated0),
dups AS (SELECT order_key FROM raw GROUP BY 1 HAVING count(*) > 1),
flagged AS (
  SELECT m.*, t0 IS NULL OR t1 IS NULL AS qc_unparsed,
         action_dt = '' OR order_key = '' OR bike_id = '' OR g0 = '' OR g1 = '' AS qc_null_required,
         order_key IN (SELECT order_key FROM dups) AS qc_dup_order,
         broken0 OR broken1 AS qc_bad_geohash,
         coalesce(minutes < 0, false) AS qc_neg_dur, coalesce(minutes = 0, false) AS qc_zero_dur,
         coalesce(minutes > 0 AND km / (minutes / 60.0) > 30, false) AS qc_speed_gt_30,
         NOT (substr(g0, 1, 4) IN (SELECT prefix FROM shares WHERE share >= 0.001)
              AND substr(g1, 1, 4) IN (SELECT prefix FROM shares WHERE share >= 0.001)) AS qc_cross_region,
         coalesce(minutes > 180, false) AS qc_dur_gt_180,
         coalesce(date IN (SELECT date FROM rated WHERE trips / baseline < 0.5), false) AS qc_anomaly_day,
         false AS qc_outside_window,
         coalesce(minutes > 60, false) AS qc_dur_gt_60, g0 = g1 AS qc_same_geohash
  FROM measured m)"""

DROPS = {p: " OR ".join(policy.drop_flags()) for p, policy in (("default", qc.Policy()), ("released", RELEASED))}
HITS = " + ".join(f"CAST({f} AS INT)" for f in qc.FLAGS)


def raw_sql(body: str) -> str:
    return "WITH " + RAW_SQL.strip() + "\n" + body


def flagged_rows(spark, sf, policy=qc.Policy()):
    return qc.flag_all(raw_trips(spark, sf), policy)


@query(
    "qc_flag_rows",
    raw_sql("SELECT order_key AS order_id, bike_id, g0 AS start_geohash, g1 AS end_geohash, date, " + ", ".join(qc.FLAGS) + " FROM flagged"),
)
def qc_flag_rows(spark, sf):
    return flagged_rows(spark, sf).select("order_id", "bike_id", "start_geohash", "end_geohash", "date", *qc.FLAGS)


def _audit_sql(drops: str, policy) -> str:
    parts = []
    for f in qc.FLAGS:
        tier = "NULL" if qc.TIERS[f] is None else qc.TIERS[f]
        parts.append(
            f"SELECT '{f}' AS flag, CAST({tier} AS INT) AS tier, {str(f in policy.drop_flags()).lower()} AS applied, "
            f"count(*) FILTER ({f}) AS n, round(100.0 * count(*) FILTER ({f}) / count(*), 6) AS pct FROM flagged"
        )
    return raw_sql("\nUNION ALL ".join(parts))


@query("qc_flag_audit", _audit_sql(DROPS["default"], qc.Policy()))
def qc_flag_audit(spark, sf):
    return rounded(qc.flag_audit(flagged_rows(spark, sf)), "pct")


@query("qc_flag_audit_released", _audit_sql(DROPS["released"], RELEASED))
def qc_flag_audit_released(spark, sf):
    return rounded(qc.flag_audit(flagged_rows(spark, sf, RELEASED), RELEASED), "pct")


@query(
    "qc_flag_summary",
    raw_sql(
        f"""SELECT count(*) AS rows_in, count(*) FILTER (NOT ({DROPS['default']})) AS rows_out,
  count(*) FILTER ({DROPS['default']}) AS rows_dropped, count(*) FILTER ({HITS} = 0) AS rows_no_flag,
  count(*) FILTER ({HITS} = 1) AS rows_one_flag, count(*) FILTER ({HITS} >= 2) AS rows_more_flags,
  count(*) FILTER (qc_zero_dur) AS zero_minute, count(*) FILTER (qc_zero_dur AND NOT qc_same_geohash) AS zero_minute_moved
  FROM flagged"""
    ),
)
def qc_flag_summary(spark, sf):
    return qc.flag_summary(flagged_rows(spark, sf))


@query(
    "qc_clean_trips",
    raw_sql(f"SELECT order_key AS order_id, t0 AS start_text, date, minutes AS duration_min, g0 AS start_geohash, g1 AS end_geohash FROM flagged WHERE NOT ({DROPS['released']})").replace(
        "t0 AS start_text", "strftime(t0, '%Y/%-m/%-d %-H:%M') AS start_text"
    ),
)
def qc_clean_trips(spark, sf):
    clean = qc.apply_policy(flagged_rows(spark, sf, RELEASED), RELEASED)
    return clean.select(
        "order_id", F.col("start_time_text").alias("start_text"), "date", "duration_min", "start_geohash", "end_geohash"
    )


@query(
    "qc_study_window",
    trips_sql("SELECT date, count(*) AS n, bool_or(date < DATE '2024-01-08' OR date > DATE '2024-01-28') AS qc_outside_window FROM trips GROUP BY 1"),
)
def qc_study_window(spark, sf):
    from datetime import date

    policy = qc.Policy(study_start=date(2024, 1, 8), study_end=date(2024, 1, 28))
    flagged = qc.derived_flags(annotate(trips(spark, sf)), policy)
    return flagged.groupBy("date").agg(F.count("*").alias("n"), F.bool_or("qc_outside_window").alias("qc_outside_window"))


@query("qc_prefix_shares", raw_sql("SELECT prefix, n, round(share, 9) AS share, share >= 0.001 AS kept FROM shares"))
def qc_prefix_shares(spark, sf):
    return rounded(qc.prefix_shares(raw_trips(spark, sf)), "share", digits=9)


@query(
    "qc_daily_baseline",
    raw_sql("SELECT date, trips, baseline, round(trips / baseline, 6) AS ratio, trips / baseline < 0.5 AS low FROM rated"),
)
def qc_daily_baseline(spark, sf):
    return rounded(qc.daily_baseline(annotate(qc.parse(raw_trips(spark, sf)), ["date"])), "ratio")


@query(
    "qc_geohash_lengths",
    raw_sql("SELECT CAST(length(g) AS INT) AS length, count(*) AS n FROM (SELECT g0 AS g FROM raw UNION ALL SELECT g1 FROM raw) GROUP BY 1"),
)
def qc_geohash_lengths(spark, sf):
    return qc.geohash_lengths(raw_trips(spark, sf))


@query(
    "qc_redundant_date",
    raw_sql(
        """SELECT count(*) FILTER (t0 IS NULL) AS date_mismatches,
  count(*) FILTER (t0 IS NULL OR action_dt <> strftime(t0, '%Y/%m/%d')) AS text_differs FROM raw"""
    ),
)
def qc_redundant_date(spark, sf):
    return qc.redundant_date(qc.parse(raw_trips(spark, sf)))


@query(
    "qc_blank_counts",
    raw_sql(
        "\nUNION ALL ".join(
            f"SELECT '{name}' AS column_name, count(*) FILTER ({col} = '') AS blanks FROM raw"
            for name, col in (("action_dt", "action_dt"), ("order_id", "order_key"), ("bike_id", "bike_id"),
                              ("start_time", "action_dt"), ("end_time", "action_dt"), ("start_geohash", "g0"), ("end_geohash", "g1"))
        )
    ),
)
def qc_blank_counts(spark, sf):
    return qc.blank_counts(raw_trips(spark, sf))


@query(
    "qc_time_coverage",
    raw_sql(
        """SELECT strftime(min(t0), '%Y-%m-%d %H:%M') AS start_first, strftime(max(t0), '%Y-%m-%d %H:%M') AS start_last,
  strftime(min(t1), '%Y-%m-%d %H:%M') AS end_first, strftime(max(t1), '%Y-%m-%d %H:%M') AS end_last,
  count(DISTINCT date) AS distinct_dates, CAST(max(date) - min(date) + 1 AS BIGINT) AS span_days,
  CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) AS missing_dates FROM measured"""
    ),
)
def qc_time_coverage(spark, sf):
    cover = qc.time_coverage(annotate(qc.parse(raw_trips(spark, sf)), ["date"]))
    times = ("start_first", "start_last", "end_first", "end_last")
    return cover.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in times})


@query(
    "qc_missing_dates",
    """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
span AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days)
SELECT date FROM span WHERE date NOT IN (SELECT date FROM days)""",
)
def qc_missing_dates(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return qc.missing_dates(orders.select(F.to_date("o_orderdate").alias("date")))


@query("qc_weekday_counts", trips_sql("SELECT dow, count(*) AS n FROM trips GROUP BY 1"))
def qc_weekday_counts(spark, sf):
    return qc.weekday_counts(annotate(trips(spark, sf), ["dow"]))


def _profile_sql(source: str, column: str, levels: dict[str, float], where: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in levels.items())
    return f"""SELECT '{column}' AS variable, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(var_samp(v), 6) AS var, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_samp(v) / avg(v), 6) AS cv, {quantiles}
  FROM (SELECT CAST({source} AS DOUBLE) AS v FROM flagged WHERE {where}) WHERE v IS NOT NULL"""


PROFILE_COLUMNS = ["mean", "std", "var", "min", "max", "cv", *qc.DURATION_LEVELS]


@query("qc_duration_before", raw_sql(_profile_sql("minutes", "duration_min", qc.DURATION_LEVELS, "true")))
def qc_duration_before(spark, sf):
    parsed = annotate(qc.parse(raw_trips(spark, sf)), ["duration_min"])
    return rounded(qc.profile(parsed, ["duration_min"]), *PROFILE_COLUMNS)


@query("qc_duration_after", raw_sql(_profile_sql("minutes", "duration_min", qc.DURATION_LEVELS, f"NOT ({DROPS['default']})")))
def qc_duration_after(spark, sf):
    clean = qc.apply_policy(flagged_rows(spark, sf))
    return rounded(qc.profile(clean, ["duration_min"]), *PROFILE_COLUMNS)


@query(
    "annotate_trips",
    trips_sql(
        f"""SELECT order_id, date, hour, minute, dow, is_weekend, CAST(s_min // 15 AS INT) AS slot_15, hour AS slot_60, duration_min,
  substr(start_geohash, 1, 4) AS start_cell4, substr(start_geohash, 1, 5) AS start_cell5, start_cell6,
  substr(end_geohash, 1, 4) AS end_cell4, substr(end_geohash, 1, 5) AS end_cell5, end_cell6,
  round(start_lat, 9) AS start_lat, round(start_lon, 9) AS start_lon, round(end_lat, 9) AS end_lat, round(end_lon, 9) AS end_lon,
  round(km, 6) AS crowfly_km, CASE WHEN duration_min > 0 THEN round(km / (duration_min / 60.0), 6) END AS implied_speed_kmh,
  s_i = e_i AND s_j = e_j AS is_same_cell
  FROM (SELECT *, {sql_haversine('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS km FROM trips)"""
    ),
)
def annotate_trips(spark, sf):
    df = annotate(trips(spark, sf))
    df = rounded(df, "start_lat", "start_lon", "end_lat", "end_lon", digits=9)
    df = rounded(df, "crowfly_km", "implied_speed_kmh")
    cells = [f"{side}_cell{level}" for side in ("start", "end") for level in (4, 5, 6)]
    return df.select(
        "order_id", "date", "hour", "minute", "dow", "is_weekend", "slot_15", "slot_60", "duration_min", *cells,
        "start_lat", "start_lon", "end_lat", "end_lon", "crowfly_km", "implied_speed_kmh", "is_same_cell",
    )


@query(
    "qc_negative_ship_gap",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (m < 0) AS qc_neg_dur, count(*) FILTER (m = 0) AS qc_zero_dur,
  CAST(min(m) AS DOUBLE) AS min_minutes FROM (SELECT l_returnflag, (epoch(l_shipdate) - epoch(o_orderdate)) / 60.0 AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def qc_negative_ship_gap(spark, sf):
    """Durations of the longer order-to-shipment series, where many are negative."""
    from tripweave.functions.clock import minutes_between

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_returnflag")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    gaps = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_returnflag",
        minutes_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("m"),
    )
    return gaps.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("m") < 0).alias("qc_neg_dur"),
        F.count_if(F.col("m") == 0).alias("qc_zero_dur"), F.min("m").alias("min_minutes"),
    )


@query(
    "geohash_roundtrip",
    trips_sql("SELECT start_geohash AS cell, s_i AS i, s_j AS j, start_geohash AS again, count(*) AS n FROM trips GROUP BY 1, 2, 3"),
)
def geohash_roundtrip(spark, sf):
    cells = trips(spark, sf).groupBy(F.col("start_geohash").alias("cell")).agg(F.count("*").alias("n"))
    cells = cells.withColumns({"i": gh.lat_index(F.col("cell")), "j": gh.lon_index(F.col("cell"))})
    return cells.select("cell", "i", "j", gh.encode(F.col("i"), F.col("j")).alias("again"), "n")
