"""Queries over slot panels and hourly lag panels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.catalog.base import DAY_TYPES, HOLIDAY, query, rounded, sql_encode, sql_lat, sql_lon, sql_workday, trips, trips_sql
from tripweave.catalog.exploration import cell_hours
from tripweave.functions.clock import HOURLY, MORNING
from tripweave.operators import panel as P
from tripweave.operators import spatiotemporal
from tripweave.operators.annotate import add_times
from tripweave.operators.domain import calendar_days, densify


def panel_sql(rule: str, unit: int = 1, start: int = 390, span: int = 240, width: int = 30, having: int = 1, units: str | None = None) -> str:
    """Panel as a product of units, days and slots with the counts joined on."""
    i, j = (f"({c} - {c} % {unit})" if unit > 1 else c for c in ("i", "j"))
    units = units or f"SELECT bi, bj, block_id FROM evt GROUP BY 1, 2, 3 HAVING count(*) >= {having}"
    return f"""kept AS (SELECT * FROM trips WHERE {rule}),
evt0 AS (SELECT date, s_i AS i, s_j AS j, s_min AS m, 1 AS d FROM kept UNION ALL SELECT date, e_i, e_j, e_min, 0 FROM kept),
evt AS (SELECT date, {i} AS bi, {j} AS bj, {sql_encode(i, j)} AS block_id, CAST((m - {start}) // {width} AS INT) AS slot, d FROM evt0 WHERE m >= {start} AND m < {start + span}),
units AS ({units}),
cnt AS (SELECT block_id, date, slot, CAST(sum(d) AS BIGINT) AS departures, CAST(sum(1 - d) AS BIGINT) AS arrivals FROM evt GROUP BY 1, 2, 3),
panel AS (SELECT u.block_id, x.date, CAST(s AS INT) AS slot, coalesce(departures, 0) AS departures, coalesce(arrivals, 0) AS arrivals,
  {sql_lat('bi')} AS lat, {sql_lon('bj')} AS lon
  FROM units u CROSS JOIN (SELECT DISTINCT date FROM kept) x CROSS JOIN range({span // width}) AS r(s)
  LEFT JOIN cnt c ON c.block_id = u.block_id AND c.date = x.date AND c.slot = s)"""


WORKDAY_PANEL = panel_sql(sql_workday("date"))


def morning_panel(spark, sf, rule="workday", **options):
    return P.build_panel(add_times(trips(spark, sf)), MORNING, DAY_TYPES, rule, **options)


_ROWS = "SELECT block_id, date, slot, departures, arrivals, round(lat, 9) AS lat, round(lon, 9) AS lon FROM panel"


@query("panel_slot", trips_sql(f"{WORKDAY_PANEL} {_ROWS}"))
def panel_slot(spark, sf):
    return rounded(morning_panel(spark, sf), "lat", "lon", digits=9)


@query("panel_slot_labelled", trips_sql(f"{panel_sql(sql_workday('date') + f' OR date = DATE {chr(39)}{HOLIDAY}{chr(39)}')} {_ROWS}"))
def panel_slot_labelled(spark, sf):
    return rounded(morning_panel(spark, sf, "labelled"), "lat", "lon", digits=9)


@query("panel_slot_3x3", trips_sql(f"{panel_sql(sql_workday('date'), unit=3)} {_ROWS}"))
def panel_slot_3x3(spark, sf):
    return rounded(morning_panel(spark, sf, shape=(3, 3)), "lat", "lon", digits=9)


@query("panel_slot_min_events", trips_sql(f"{panel_sql(sql_workday('date'), having=5)} {_ROWS}"))
def panel_slot_min_events(spark, sf):
    return rounded(morning_panel(spark, sf, min_events=5), "lat", "lon", digits=9)


_LISTED = f"SELECT DISTINCT s_i AS bi, s_j AS bj, start_geohash AS block_id FROM trips WHERE is_weekend"


@query("panel_slot_listed_units", trips_sql(f"{panel_sql(sql_workday('date'), units=_LISTED)} {_ROWS}"))
def panel_slot_listed_units(spark, sf):
    """Units from a list (cells that start trips at weekends); idle ones stay as zeros."""
    df = add_times(trips(spark, sf))
    listed = df.where("is_weekend").select(F.col("start_geohash").alias("block_id")).distinct()
    out = P.build_panel(df, MORNING, DAY_TYPES, "workday", units=listed)
    return rounded(out, "lat", "lon", digits=9)


_CHOSEN = "date IN (DATE '2024-01-03', DATE '2024-01-21')"


@query("panel_hourly_listed_days", trips_sql(f"{panel_sql(_CHOSEN, start=0, span=1440, width=60)} {_ROWS}"))
def panel_hourly_listed_days(spark, sf):
    from datetime import date

    out = P.build_panel(add_times(trips(spark, sf)), HOURLY, DAY_TYPES, [date(2024, 1, 3), date(2024, 1, 21)])
    return rounded(out, "lat", "lon", digits=9)


@query(
    "panel_slot_net_ranked",
    trips_sql(
        f"""{WORKDAY_PANEL}, net AS (SELECT block_id, slot, CAST(sum(departures) AS BIGINT) AS departures, CAST(sum(arrivals) AS BIGINT) AS arrivals,
  CAST(sum(departures - arrivals) AS BIGINT) AS net_out, count(*) AS days FROM panel GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY slot ORDER BY net_out DESC, block_id) AS INT) AS place FROM net QUALIFY place <= 10"""
    ),
)
def panel_slot_net_ranked(spark, sf):
    """Flagship: the ten strongest sources of every half-hour, over a complete morning panel."""
    net = morning_panel(spark, sf).groupBy("block_id", "slot").agg(
        F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"),
        F.sum(F.col("departures") - F.col("arrivals")).alias("net_out"), F.count("*").alias("days"),
    )
    order = W.partitionBy("slot").orderBy(F.desc("net_out"), "block_id")
    return net.withColumn("place", F.row_number().over(order)).where("place <= 10")


@query(
    "panel_info",
    trips_sql(
        f"""{WORKDAY_PANEL} SELECT (SELECT count(*) FROM trips) AS rows_read, (SELECT count(DISTINCT date) FROM kept) AS days_kept,
  CAST(sum(d) AS BIGINT) AS departures_events, CAST(sum(1 - d) AS BIGINT) AS arrivals_events, count(DISTINCT block_id) AS units FROM evt"""
    ),
)
def panel_info(spark, sf):
    df = add_times(trips(spark, sf))
    return P.panel_info(df, P.slot_counts(df, MORNING, DAY_TYPES), DAY_TYPES, "workday")


@query(
    "panel_describe",
    trips_sql(
        f"""{WORKDAY_PANEL} SELECT count(*) AS rows, count(DISTINCT block_id) AS units, count(DISTINCT date) AS days, count(DISTINCT slot) AS slots,
  min(date) AS date_min, max(date) AS date_max, CAST(sum(arrivals) AS BIGINT) AS arrivals_sum, CAST(sum(departures) AS BIGINT) AS departures_sum,
  round(avg(CAST(arrivals = 0 AS INT)), 9) AS zero_share_arrivals, round(avg(CAST(departures = 0 AS INT)), 9) AS zero_share_departures FROM panel"""
    ),
)
def panel_describe(spark, sf):
    return rounded(P.describe_panel(morning_panel(spark, sf)), "zero_share_arrivals", "zero_share_departures", digits=9)


@query(
    "panel_violations",
    trips_sql(
        """evt AS (SELECT start_geohash AS block_id, date, hour AS slot, order_id % 7 - 1 AS arrivals, CASE WHEN order_id % 11 = 0 THEN NULL ELSE 1 END AS departures FROM trips),
keyed AS (SELECT block_id, date, slot, count(*) AS n FROM evt GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM evt) AS rows, (SELECT count(*) FROM evt WHERE slot > 9) AS bad_slot,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM keyed) AS duplicate_keys, (SELECT count(*) FROM evt WHERE arrivals < 0) AS negative_counts,
  (SELECT count(*) FROM evt WHERE departures IS NULL) AS null_counts"""
    ),
)
def panel_violations(spark, sf):
    """Contract check on an event-level table that breaks every rule."""
    df = add_times(trips(spark, sf))
    broken = df.select(
        F.col("start_geohash").alias("unit"), "date", "hour", (F.col("order_id") % 7 - 1).alias("arrivals"),
        F.when(F.col("order_id") % 11 == 0, F.lit(None)).otherwise(F.lit(1)).alias("departures"),
    )
    return P.panel_violations(P.normalise_panel(broken, "unit"), 10)


# ---- hourly lag panel -------------------------------------------------------

TOP = 30
HOURLY_SQL = f"""touch AS (SELECT cell FROM (SELECT start_cell6 AS cell FROM trips UNION ALL SELECT end_cell6 FROM trips) GROUP BY 1 ORDER BY count(*) DESC, cell LIMIT {TOP}),
grid AS (SELECT cell, date, CAST(h AS INT) AS hour FROM touch, (SELECT DISTINCT date FROM trips), range(24) AS r(h)),
base AS (SELECT g.cell, g.date, g.hour, coalesce(n, 0) AS n FROM grid g LEFT JOIN (SELECT start_cell6 AS cell, date, hour, count(*) AS n FROM trips GROUP BY 1, 2, 3) c
  ON c.cell = g.cell AND c.date = g.date AND c.hour = g.hour),
lagged AS (SELECT *, lag(n, 1) OVER w AS lag1, lag(n, 24) OVER w AS lag24, lag(n, 168) OVER w AS lag168,
  avg(n) OVER (PARTITION BY cell ORDER BY date, hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lag1_ma3 FROM base WINDOW w AS (PARTITION BY cell ORDER BY date, hour)),
hourly AS (SELECT *, CAST(isodow(date) - 1 AS INT) AS dow, CAST(isodow(date) >= 6 AS INT) AS is_weekend,
  CAST(dense_rank() OVER (ORDER BY date) - 1 AS INT) AS day_index FROM lagged WHERE lag168 IS NOT NULL)"""


def hourly(spark, sf):
    hours = cell_hours(spark, sf)
    top = spatiotemporal.busiest_cells(hours, TOP).select("cell")
    return P.hourly_panel(spatiotemporal.hourly_departures(hours, top))


@query(
    "panel_hourly_lags",
    trips_sql(f"{HOURLY_SQL} SELECT cell, date, hour, n, lag1, lag24, lag168, round(lag1_ma3, 6) AS lag1_ma3, dow, is_weekend, day_index FROM hourly"),
)
def panel_hourly_lags(spark, sf):
    return rounded(hourly(spark, sf), "lag1_ma3")


@query(
    "panel_calendar_lags",
    """WITH d AS (SELECT o_orderpriority AS cell, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2),
span AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
grid AS (SELECT cell, date FROM (SELECT DISTINCT cell FROM d), span),
base AS (SELECT g.cell, g.date, coalesce(n, 0) AS n FROM grid g LEFT JOIN d ON d.cell = g.cell AND d.date = g.date)
SELECT cell, date, n, lag(n, 1) OVER w AS lag1, lag(n, 7) OVER w AS lag7, round(avg(n) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS lag1_ma3
FROM base WINDOW w AS (PARTITION BY cell ORDER BY date)""",
)
def panel_calendar_lags(spark, sf):
    """Daily lags over the full calendar of a long series with missing days."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    counts = orders.groupBy(F.col("o_orderpriority").alias("cell"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    dense = densify(counts.withColumn("slot", F.lit(0)), ["cell"], calendar_days(counts), "slot", 1, ["n"])
    lagged = P.add_lags(dense, ["cell"], "slot", "n", (1, 7))
    return rounded(lagged.select("cell", "date", "n", "lag1", "lag7", "lag1_ma3"), "lag1_ma3")


@query(
    "top_units_by_gross",
    trips_sql(f"{WORKDAY_PANEL} SELECT block_id, CAST(sum(arrivals + departures) AS BIGINT) AS gross FROM panel GROUP BY 1 ORDER BY gross DESC, block_id LIMIT 20"),
)
def top_units_by_gross(spark, sf):
    from tripweave.operators.features import top_units

    return top_units(morning_panel(spark, sf), 20)
