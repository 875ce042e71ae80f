"""Queries over distributions, time, cell-hour balances, dispersion and concentration."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tripweave.catalog.base import DAY_TYPES, HOLIDAY, MAKEUP, query, rounded, sql_haversine, sql_target, sql_workday, trips, trips_sql
from tripweave.functions.clock import MORNING
from tripweave.operators import cells, qc, ranking, spatiotemporal, temporal
from tripweave.operators.annotate import add_movement, add_places, add_times
from tripweave.operators.joins import lookup
from tripweave.session import write_through

KM = sql_haversine("start_lat", "start_lon", "end_lat", "end_lon")
# Quantile levels and duration bins of the trip profile.
LEVELS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
BINS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 90, 120, 150, 180]


def timed(spark, sf):
    df = add_times(trips(spark, sf))
    return df.withColumns({"start_cell6": F.substring("start_geohash", 1, 6), "end_cell6": F.substring("end_geohash", 1, 6)})


def moved(spark, sf):
    return add_movement(add_places(add_times(trips(spark, sf)), levels=()))


def _profile(variable: str, source: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in LEVELS.items())
    return f"""SELECT '{variable}' AS variable, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(var_samp(v), 6) AS var, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_samp(v) / avg(v), 6) AS cv, {quantiles}
FROM (SELECT {source} AS v FROM trips) WHERE v IS NOT NULL"""


@query(
    "trip_profile",
    trips_sql(
        "\nUNION ALL ".join(
            (
                _profile("duration_min", "duration_min"),
                _profile("crowfly_km", KM),
                _profile("implied_speed_kmh", f"CASE WHEN duration_min > 0 THEN {KM} / (duration_min / 60.0) END"),
            )
        )
    ),
)
def trip_profile(spark, sf):
    out = qc.profile(moved(spark, sf), ["duration_min", "crowfly_km", "implied_speed_kmh"], LEVELS)
    return rounded(out, "mean", "std", "var", "min", "max", "cv", *LEVELS)


_BIN_ROWS = ", ".join(f"({k}, {a}, {b}, {str(k == len(BINS) - 2).lower()})" for k, (a, b) in enumerate(zip(BINS, BINS[1:])))


@query(
    "duration_histogram",
    trips_sql(
        f"""bins(bin, low, high, closed) AS (VALUES {_BIN_ROWS}),
counted AS (SELECT bin, low, high, count(*) AS n FROM trips JOIN bins ON duration_min >= low AND (duration_min < high OR (closed AND duration_min = high)) GROUP BY 1, 2, 3)
SELECT bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, n, round(n / sum(n) OVER () / (high - low), 9) AS density FROM counted"""
    ),
)
def duration_histogram(spark, sf):
    return rounded(temporal.histogram(add_times(trips(spark, sf)), "duration_min", BINS), "density", digits=9)


@query(
    "distance_log_histogram",
    trips_sql(
        f"""SELECT CAST(floor(log10(km) * 4) AS BIGINT) AS log_bin, count(*) AS n FROM (SELECT {KM} AS km FROM trips) WHERE km > 0 GROUP BY 1"""
    ),
)
def distance_log_histogram(spark, sf):
    df = moved(spark, sf).select("crowfly_km").where("crowfly_km > 0")
    return df.groupBy(F.floor(F.log10("crowfly_km") * 4).alias("log_bin")).agg(F.count("*").alias("n"))


DEPARTURES = "dep AS (SELECT start_cell6 AS cell, count(*) AS n FROM trips GROUP BY 1)"


def departures(spark, sf):
    return timed(spark, sf).groupBy(F.col("start_cell6").alias("cell")).agg(F.count("*").alias("n"))


@query(
    "departures_gini",
    trips_sql(
        f"""{DEPARTURES}, o AS (SELECT n, row_number() OVER (ORDER BY n, cell) AS i, count(*) OVER () AS c FROM dep)
SELECT any_value(c) AS holders, CAST(sum(n) AS BIGINT) AS total,
  round((2.0 * sum(i * n) - (any_value(c) + 1) * sum(n)) / (any_value(c) * sum(n)), 9) AS gini FROM o"""
    ),
)
def departures_gini(spark, sf):
    return rounded(ranking.gini(departures(spark, sf), "n"), "gini", digits=9)


@query(
    "departures_lorenz",
    trips_sql(
        f"""{DEPARTURES}, v AS (SELECT n, count(*) AS holders FROM dep GROUP BY 1)
SELECT n, holders, round(sum(holders) OVER (ORDER BY n) / sum(holders) OVER (), 9) AS holder_share,
  round(sum(n * holders) OVER (ORDER BY n) / sum(n * holders) OVER (), 9) AS total_share FROM v"""
    ),
)
def departures_lorenz(spark, sf):
    return rounded(ranking.lorenz(departures(spark, sf), "n"), "holder_share", "total_share", digits=9)


@query(
    "departures_cover_80",
    trips_sql(
        f"""{DEPARTURES}, o AS (SELECT row_number() OVER (ORDER BY n DESC, cell) AS r, sum(n) OVER (ORDER BY n DESC, cell) / (SELECT sum(n) FROM dep) AS s FROM dep)
SELECT min(r) FILTER (s >= 0.8) AS n_holders, count(*) AS n_all FROM o"""
    ),
)
def departures_cover_80(spark, sf):
    return ranking.holders_to_cover(departures(spark, sf), "n", 0.8)


@query(
    "departures_concentration",
    trips_sql(
        f"""{DEPARTURES} SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) AS cell_rank,
  round(100.0 * sum(n) OVER (ORDER BY n DESC, cell) / sum(n) OVER (), 6) AS cum_share_pct FROM dep"""
    ),
)
def departures_concentration(spark, sf):
    dep = departures(spark, sf)
    total = dep.agg(F.sum("n")).scalar()
    ranked = ranking.running_totals(dep, [F.desc("n"), F.asc("cell")], {"cell_rank": F.lit(1), "_cum": F.col("n")})
    return rounded(ranked.withColumn("cum_share_pct", 100.0 * F.col("_cum") / total).drop("_cum"), "cum_share_pct")


@query(
    "daily_volume",
    trips_sql(
        """d AS (SELECT date, count(*) AS n FROM trips GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
j AS (SELECT c.date, n FROM c LEFT JOIN d ON c.date = d.date)
SELECT date, n, CAST(isodow(date) - 1 AS INT) AS dow, isodow(date) >= 6 AS is_weekend, n IS NULL AS removed,
  round(CASE WHEN count(n) OVER w >= 4 THEN avg(n) OVER w END, 6) AS roll7 FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""
    ),
)
def daily_volume(spark, sf):
    return rounded(temporal.daily_volume(add_times(trips(spark, sf))), "roll7")


@query(
    "daily_volume_gaps",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
j AS (SELECT c.date, n FROM c LEFT JOIN d ON c.date = d.date)
SELECT date, n, CAST(isodow(date) - 1 AS INT) AS dow, isodow(date) >= 6 AS is_weekend, n IS NULL AS removed,
  round(CASE WHEN count(n) OVER w >= 4 THEN avg(n) OVER w END, 6) AS roll7 FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def daily_volume_gaps(spark, sf):
    """The same over all orders, a series of years in which a few days are missing."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return rounded(temporal.daily_volume(orders.select(F.to_date("o_orderdate").alias("date"))), "roll7")


@query(
    "volume_bands",
    trips_sql(
        """d AS (SELECT date, isodow(date) >= 6 AS we, count(*) AS n FROM trips GROUP BY 1)
SELECT count(*) AS days, round(avg(n), 6) AS daily_mean, round(var_samp(n), 6) AS daily_var, round(stddev_samp(n), 6) AS daily_sd,
  min(n) AS daily_min, max(n) AS daily_max, round(avg(n) FILTER (NOT we), 6) AS weekday_mean, round(avg(n) FILTER (we), 6) AS weekend_mean,
  round(avg(n) FILTER (date <= DATE '2024-01-15'), 6) AS mean_first_half, round(avg(n) FILTER (date > DATE '2024-01-15'), 6) AS mean_second_half FROM d"""
    ),
)
def volume_bands(spark, sf):
    bands = {"first_half": (date(2024, 1, 1), date(2024, 1, 15)), "second_half": (date(2024, 1, 16), date(2024, 1, 31))}
    out = temporal.volume_bands(temporal.daily_volume(add_times(trips(spark, sf))), bands)
    return rounded(out, "daily_mean", "daily_var", "daily_sd", "weekday_mean", "weekend_mean", "mean_first_half", "mean_second_half")


def _occurrence_sql(group: str) -> str:
    return f"""days AS (SELECT {group}, count(DISTINCT date) AS days FROM trips GROUP BY 1),
grid AS (SELECT {group}, days, CAST(h AS INT) AS hour FROM days, range(24) AS r(h)),
means AS (SELECT g.{group}, g.hour, g.days, coalesce(n, 0) / days AS per_day FROM grid g
  LEFT JOIN (SELECT {group}, hour, count(*) AS n FROM trips GROUP BY 1, 2) c ON c.{group} = g.{group} AND c.hour = g.hour)"""


@query("hour_profile", trips_sql(f"{_occurrence_sql('is_weekend')} SELECT is_weekend, hour, days, round(per_day, 6) AS per_day FROM means"))
def hour_profile(spark, sf):
    return rounded(temporal.hour_profile(add_times(trips(spark, sf))), "per_day")


@query(
    "weekday_hour_shares",
    trips_sql(
        f"""{_occurrence_sql('dow')} SELECT dow, hour, days, round(per_day, 6) AS per_day,
  round(100.0 * per_day / sum(per_day) OVER (PARTITION BY dow), 6) AS share_pct FROM means"""
    ),
)
def weekday_hour_shares(spark, sf):
    return rounded(temporal.weekday_hour_shares(add_times(trips(spark, sf))), "per_day", "share_pct")


@query(
    "peak_hours",
    trips_sql(
        f"""{_occurrence_sql('dow')} SELECT dow, hour AS peak_hour, round(per_day, 6) AS peak_per_day FROM means
QUALIFY row_number() OVER (PARTITION BY dow ORDER BY per_day DESC, hour) = 1"""
    ),
)
def peak_hours(spark, sf):
    return rounded(temporal.peak_hours(temporal.weekday_hour_shares(add_times(trips(spark, sf))), "dow"), "peak_per_day")


TYPE = f"CASE WHEN date = DATE '{HOLIDAY}' THEN 'holiday' WHEN date = DATE '{MAKEUP}' THEN 'makeup' WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'workday' END"


def morning(spark, sf):
    df = add_times(trips(spark, sf))
    return df.where(MORNING.slot(F.col("start_time")) >= 0)


MORNING_DAILY = f"d AS (SELECT date, {TYPE} AS day_type, count(*) AS n FROM trips WHERE s_min >= 390 AND s_min < 630 GROUP BY 1)"


@query(
    "volume_by_day_type",
    trips_sql(f"{MORNING_DAILY} SELECT day_type, count(*) AS days, CAST(sum(n) AS BIGINT) AS trips, round(avg(n), 6) AS mean_n, quantile_cont(n, 0.5) AS median_n FROM d GROUP BY 1"),
)
def volume_by_day_type(spark, sf):
    return rounded(temporal.volume_by_day_type(morning(spark, sf), DAY_TYPES), "mean_n")


@query(
    "special_days_ratio",
    trips_sql(
        f"""{MORNING_DAILY}, u AS (SELECT avg(n) AS m FROM d WHERE day_type = 'workday')
SELECT date, n, day_type, round(m, 6) AS workday_mean, round(n / m, 6) AS ratio FROM d, u WHERE day_type IN ('holiday', 'makeup')"""
    ),
)
def special_days_ratio(spark, sf):
    return rounded(temporal.special_days_against_workdays(morning(spark, sf), DAY_TYPES), "workday_mean", "ratio")


@query(
    "day_rules",
    trips_sql(
        f"""SELECT date, count(*) AS n, true AS keep_all, {sql_workday('date')} AS keep_workday, NOT {sql_workday('date')} AS keep_weekend,
  {sql_workday('date')} OR date = DATE '{HOLIDAY}' AS keep_labelled, date IN (DATE '2024-01-03', DATE '2024-01-21') AS keep_list,
  {sql_target('date')} AS is_target,
  CAST(CASE WHEN date = DATE '{HOLIDAY}' THEN 5 WHEN date = DATE '{MAKEUP}' THEN 4 ELSE isodow(date) - 1 END AS INT) AS effective_weekday
FROM trips GROUP BY 1"""
    ),
)
def day_rules(spark, sf):
    days = add_times(trips(spark, sf)).groupBy("date").agg(F.count("*").alias("n"))
    day = F.col("date")
    rules = {f"keep_{r}": DAY_TYPES.keep(day, r) for r in ("all", "workday", "weekend", "labelled")}
    return days.withColumns(
        {
            **rules,
            "keep_list": DAY_TYPES.keep(day, [date(2024, 1, 3), date(2024, 1, 21)]),
            "is_target": DAY_TYPES.is_target(day),
            "effective_weekday": DAY_TYPES.effective_weekday(day),
        }
    )


@query(
    "slot_assignment",
    trips_sql(
        """SELECT CAST(CASE WHEN s_min >= 390 AND s_min < 630 THEN (s_min - 390) // 30 ELSE -1 END AS INT) AS slot,
  CASE WHEN s_min >= 390 AND s_min < 630 THEN strftime(DATE '2024-01-01' + to_minutes((390 + (s_min - 390) // 30 * 30)::BIGINT), '%H:%M') ELSE '06:00' END AS label,
  count(*) AS n FROM trips GROUP BY 1, 2"""
    ),
)
def slot_assignment(spark, sf):
    slots = trips(spark, sf).select(MORNING.slot(F.col("start_time")).alias("slot"))
    return slots.groupBy("slot").agg(F.count("*").alias("n")).withColumn("label", MORNING.label(F.col("slot")))


# ---- cell by hour ----------------------------------------------------------

TOP = 30
TOUCH = f"""touch AS (SELECT cell, count(*) AS n FROM (SELECT start_cell6 AS cell FROM trips UNION ALL SELECT end_cell6 FROM trips) GROUP BY 1
  ORDER BY n DESC, cell LIMIT {TOP})"""
FLOWS = f"""{TOUCH}, wk AS (SELECT * FROM trips WHERE NOT is_weekend), nd AS (SELECT count(DISTINCT date) AS d FROM wk),
grid AS (SELECT cell, CAST(h AS INT) AS hour FROM touch, range(24) AS r(h)),
dep AS (SELECT start_cell6 AS cell, hour, count(*) AS n FROM wk GROUP BY 1, 2), arr AS (SELECT end_cell6 AS cell, hour, count(*) AS n FROM wk GROUP BY 1, 2),
flows AS (SELECT g.cell, g.hour, coalesce(dep.n, 0) AS dep, coalesce(arr.n, 0) AS arr, (coalesce(dep.n, 0) - coalesce(arr.n, 0)) / d AS net_out_day,
  (coalesce(dep.n, 0) + coalesce(arr.n, 0)) / d AS gross_day FROM grid g CROSS JOIN nd
  LEFT JOIN dep ON dep.cell = g.cell AND dep.hour = g.hour LEFT JOIN arr ON arr.cell = g.cell AND arr.hour = g.hour)"""


def cell_hours(spark, sf):
    return write_through(spatiotemporal.cell_hours(timed(spark, sf)))


def cell_flows(spark, sf):
    hours = cell_hours(spark, sf)
    top = spatiotemporal.busiest_cells(hours, TOP)
    return spatiotemporal.cell_hour_flows(spatiotemporal.weekdays_only(hours), top, 2.0)


@query(
    "cell_hour_balance",
    trips_sql(
        f"""{FLOWS} SELECT cell, hour, dep, arr, round(net_out_day, 6) AS net_out_day, round(gross_day, 6) AS gross_day,
  round(CASE WHEN gross_day >= 2 THEN net_out_day / nullif(gross_day, 0) END, 6) AS balance FROM flows"""
    ),
)
def cell_hour_balance(spark, sf):
    return rounded(cell_flows(spark, sf), "net_out_day", "gross_day", "balance")


@query(
    "cell_roles",
    trips_sql(
        f"""{FLOWS}, m AS (SELECT cell, avg(net_out_day) FILTER (hour IN (7, 8, 9)) AS a, avg(net_out_day) FILTER (hour IN (17, 18, 19)) AS p FROM flows GROUP BY 1)
SELECT cell, round(a, 6) AS net_am, round(p, 6) AS net_pm, CASE WHEN abs(a) < 0.2 AND abs(p) < 0.2 THEN 'flat'
  WHEN abs(a) < 0.2 OR abs(p) < 0.2 THEN 'one-sided' WHEN sign(a) <> sign(p) THEN 'reversed' ELSE 'same' END AS role,
  CASE WHEN a > 0.2 AND p < -0.2 THEN 'workplace' WHEN a < -0.2 AND p > 0.2 THEN 'residential' ELSE '' END AS reading FROM m"""
    ),
)
def cell_roles(spark, sf):
    return rounded(spatiotemporal.roles(cell_flows(spark, sf), eps=0.2), "net_am", "net_pm")


@query(
    "anchor_hour_net",
    trips_sql(
        """nd AS (SELECT count(DISTINCT date) AS d FROM trips),
e AS (SELECT start_cell6 AS cell, hour, 1 AS s FROM trips UNION ALL SELECT end_cell6, hour, -1 FROM trips)
SELECT cell, hour, round(sum(s) / any_value(d), 6) AS net_out_day FROM e, nd WHERE hour IN (8, 18) GROUP BY 1, 2"""
    ),
)
def anchor_hour_net(spark, sf):
    return rounded(spatiotemporal.anchor_net(cell_hours(spark, sf), [8, 18]), "net_out_day")


def _stats_sql(source: str, cells_sql: str) -> str:
    return f"""{TOUCH}, src AS ({source}), chosen AS ({cells_sql}), days AS (SELECT DISTINCT date FROM src),
panel AS (SELECT g.cell, g.hour, coalesce(n, 0) AS n FROM (SELECT cell, date, CAST(h AS INT) AS hour FROM chosen, days, range(24) AS r(h)) g
  LEFT JOIN (SELECT start_cell6 AS cell, date, hour, count(*) AS n FROM src GROUP BY 1, 2, 3) c ON c.cell = g.cell AND c.date = g.date AND c.hour = g.hour),
stats AS (SELECT cell, hour, count(*) AS n_days, avg(n) AS mean, var_samp(n) AS var, stddev_samp(n) AS std, CAST(sum(n) AS BIGINT) AS total,
  quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, stddev_samp(n) / nullif(avg(n), 0) AS cv, var_samp(n) / nullif(avg(n), 0) AS var_over_mean
  FROM panel GROUP BY 1, 2)"""


_ALL, _TOPC = "SELECT * FROM trips", "SELECT cell FROM touch"
_STATS_COLUMNS = """cell, hour, n_days, round(mean, 6) AS mean, round(var, 6) AS var, round(std, 6) AS std, total, round(p50, 6) AS p50,
  round(p90, 6) AS p90, round(cv, 6) AS cv, round(var_over_mean, 6) AS var_over_mean"""
_STATS = ("mean", "var", "std", "p50", "p90", "cv", "var_over_mean")


def hour_stats(spark, sf, weekdays_only=False, everywhere=False):
    hours = cell_hours(spark, sf)
    chosen = None if everywhere else spatiotemporal.busiest_cells(hours, TOP).select("cell")
    if weekdays_only:
        hours = spatiotemporal.weekdays_only(hours)
    return spatiotemporal.cell_hour_stats(spatiotemporal.hourly_departures(hours, chosen))


@query("cell_hour_stats", trips_sql(f"{_stats_sql(_ALL, _TOPC)} SELECT {_STATS_COLUMNS} FROM stats"))
def cell_hour_stats(spark, sf):
    return rounded(hour_stats(spark, sf), *_STATS)


@query(
    "cell_peak_hours",
    trips_sql(f"{_stats_sql(_ALL, _TOPC)} SELECT {_STATS_COLUMNS} FROM stats QUALIFY row_number() OVER (PARTITION BY cell ORDER BY mean DESC, hour) = 1"),
)
def cell_peak_hours(spark, sf):
    return rounded(spatiotemporal.peak_hour_rows(hour_stats(spark, sf)), *_STATS)


def _fit_sql(source: str, chosen: str) -> str:
    return trips_sql(
        f"""{_stats_sql(source, chosen)} SELECT count(*) AS n, round(regr_slope(ln(var), ln(mean)), 6) AS slope,
  round(regr_intercept(ln(var), ln(mean)), 6) AS intercept, round(avg(CAST(var > mean * (1 + 1e-9) AS INT)), 6) AS above_poisson,
  round(quantile_cont(var_over_mean, 0.5), 6) AS median_var_over_mean FROM stats WHERE mean >= 0.05 AND var > 0"""
    )


_FIT = ("slope", "intercept", "above_poisson", "median_var_over_mean")


@query("dispersion_top_cells", _fit_sql(_ALL, _TOPC))
def dispersion_top_cells(spark, sf):
    return rounded(spatiotemporal.dispersion_fit(write_through(hour_stats(spark, sf)), 0.05), *_FIT)


@query("dispersion_weekdays", _fit_sql("SELECT * FROM trips WHERE NOT is_weekend", _TOPC))
def dispersion_weekdays(spark, sf):
    return rounded(spatiotemporal.dispersion_fit(write_through(hour_stats(spark, sf, weekdays_only=True)), 0.05), *_FIT)


@query("dispersion_all_cells", _fit_sql(_ALL, "SELECT DISTINCT start_cell6 AS cell FROM trips"))
def dispersion_all_cells(spark, sf):
    return rounded(spatiotemporal.dispersion_fit(write_through(hour_stats(spark, sf, everywhere=True)), 0.05), *_FIT)


@query(
    "net_flow_limit",
    trips_sql(
        """net AS (SELECT cell, sum(s) AS net FROM (SELECT start_geohash AS cell, 1 AS s FROM trips UNION ALL SELECT end_geohash, -1 FROM trips) GROUP BY 1),
lim AS (SELECT greatest(quantile_cont(abs(net), 0.98), 1.0) AS l FROM net)
SELECT round(any_value(l), 6) AS "limit", count(*) AS n, count(*) FILTER (abs(net) > l) AS saturated FROM net, lim"""
    ),
)
def net_flow_limit(spark, sf):
    net = cells.cell_counts(trips(spark, sf), 8).select("net_out")
    return rounded(spatiotemporal.symmetric_limit(net, "net_out"), "limit")


@query(
    "rank_correlation",
    trips_sql(
        """c AS (SELECT cell, CAST(sum(d) AS BIGINT) AS dep, CAST(sum(1 - d) AS BIGINT) AS arr FROM
  (SELECT start_geohash AS cell, 1 AS d FROM trips UNION ALL SELECT end_geohash, 0 FROM trips) GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY dep) + (count(*) OVER (PARTITION BY dep) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY arr) + (count(*) OVER (PARTITION BY arr) - 1) / 2.0 AS b FROM c)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"""
    ),
)
def rank_correlation(spark, sf):
    counts = cells.cell_counts(trips(spark, sf), 8)
    return rounded(ranking.average_rank_correlation(counts, "n_departures", "n_arrivals"), "rho")


@query(
    "lookup_beyond_limit",
    trips_sql(
        """c AS (SELECT start_geohash AS cell, count(*) AS n FROM trips GROUP BY 1 HAVING count(*) > 1)
SELECT n, count(*) AS trips FROM trips LEFT JOIN c ON cell = end_geohash GROUP BY 1"""
    ),
)
def lookup_beyond_limit(spark, sf):
    """Departures of each trip's last cell, by the path of dimensions that are too large to broadcast (limit of one byte)."""
    made = trips(spark, sf).select("order_id", F.col("end_geohash").alias("cell"))
    starts = trips(spark, sf).groupBy(F.col("start_geohash").alias("cell")).agg(F.count("*").alias("n")).where("n > 1")
    found = lookup(made, write_through(starts), ["cell"], limit=1)
    return found.groupBy("n").agg(F.count("*").alias("trips"))
