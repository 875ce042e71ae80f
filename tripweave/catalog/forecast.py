"""Queries over features, folds, baselines and scores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tripweave.catalog.base import DAY_TYPES, HOLIDAY, MAKEUP, query, rounded, sql_workday, trips, trips_sql
from tripweave.catalog.panels import HOURLY_SQL, morning_panel, panel_sql
from tripweave.catalog.panels import hourly as hourly_panel
from tripweave.functions.clock import MORNING
from tripweave.operators import cells, features, folds, models, panel, scoring
from tripweave.session import side_by_side, write_through
from tripweave.sources import weather as weather_source

LABELLED = panel_sql(f"{sql_workday('date')} OR date = DATE '{HOLIDAY}'")
CUT = date(2024, 1, 20)
CENTRE = (39.98, 116.32)


def hourly(spark, sf):
    """The hourly lag panel as a table: folds, priors and scores all read it."""
    return write_through(hourly_panel(spark, sf))


def labelled(spark, sf):
    """The slot panel of workdays and holidays as a table."""
    return write_through(morning_panel(spark, sf, "labelled"))


def readings(spark, sf):
    """One weather reading per event, so hours repeat; every fiftieth hour has none."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_trunc("hour", F.col("ts")).alias("time"))
    h = F.floor((F.unix_seconds(F.col("time").cast("timestamp")) - 1704067200) / 3600)
    hours = events.withColumn("h", h).where("h % 50 <> 0")
    return hours.select(
        "event_id", "time", F.greatest(F.lit(0), (F.col("h") * 37) % 11 - 7).alias("precipitation"),
        ((F.col("h") * 13) % 30).alias("temperature_2m"), (F.col("event_id") % 10).alias("wind_speed_10m"),
        F.when(F.col("h") % 7 != 0, F.col("event_id") % 100).alias("cloud_cover"),
    )


WEATHER_SQL = """rd AS (SELECT event_id, date_trunc('hour', ts) AS ts, CAST((epoch(date_trunc('hour', ts)) - 1704067200) // 3600 AS BIGINT) AS h FROM events),
weather AS (SELECT ts, CAST(greatest(0, (h * 37) % 11 - 7) AS DOUBLE) AS precip_mm, CAST((h * 13) % 30 AS DOUBLE) AS temp_c,
  CAST(event_id % 10 AS DOUBLE) AS wind_ms, CAST(CASE WHEN h % 7 <> 0 THEN event_id % 100 END AS DOUBLE) AS cloud_pct
  FROM rd WHERE h % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1)"""


@query("weather_readings", trips_sql(f"{WEATHER_SQL} SELECT strftime(ts, '%Y-%m-%d %H') AS hour, precip_mm, temp_c, wind_ms, cloud_pct FROM weather"))
def weather_readings(spark, sf):
    table = weather_source.normalise(readings(spark, sf), "event_id")
    return table.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "precip_mm", "temp_c", "wind_ms", "cloud_pct")


# ---- feature blocks ---------------------------------------------------------

_DOW = f"CASE WHEN date = DATE '{HOLIDAY}' THEN 5 WHEN date = DATE '{MAKEUP}' THEN 4 ELSE isodow(date) - 1 END"
_WEEKEND = f"CASE WHEN date = DATE '{HOLIDAY}' THEN 1 WHEN date = DATE '{MAKEUP}' THEN 0 WHEN isodow(date) >= 6 THEN 1 ELSE 0 END"


@query(
    "feature_calendar",
    trips_sql(
        f"""{LABELLED} SELECT date, slot, CAST({_DOW} AS INT) AS dow, {_WEEKEND} AS is_weekend, 1 - {_WEEKEND} AS is_weekday, CAST(date = DATE '{HOLIDAY}' AS INT) AS is_holiday,
  CAST(date + 1 = DATE '{HOLIDAY}' AS INT) AS is_day_before_holiday, CAST(date - 1 = DATE '{HOLIDAY}' AS INT) AS is_day_after_holiday, CAST(date = DATE '{MAKEUP}' AS INT) AS is_makeup_workday,
  CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day_of_month, CAST((date - (SELECT min(date) FROM panel)) // 7 AS INT) AS week_of_window,
  CAST(date - (SELECT min(date) FROM panel) AS INT) AS day_of_window, count(*) AS rows FROM panel GROUP BY date, slot"""
    ),
)
def feature_calendar(spark, sf):
    block = features.Calendar(DAY_TYPES)
    out = block.transform(labelled(spark, sf))
    return out.groupBy("date", *block.columns).agg(F.count("*").alias("rows"))


@query(
    "feature_geometry",
    trips_sql(
        f"""{LABELLED}, m AS (SELECT DISTINCT block_id, radians(lon - 116.32e0) * 6371000e0 * cos(radians(39.98e0)) AS x, radians(lat - 39.98e0) * 6371000e0 AS y FROM panel)
SELECT block_id, round(x, 6) AS x_m, round(y, 6) AS y_m, round(sqrt(x * x + y * y), 6) AS dist_to_centroid_m, round(y / sqrt(x * x + y * y), 6) AS bearing_sin,
  round(x / sqrt(x * x + y * y), 6) AS bearing_cos FROM m"""
    ),
)
def feature_geometry(spark, sf):
    block = features.Geometry(CENTRE)
    units = labelled(spark, sf).select("block_id", "lat", "lon").distinct()
    return rounded(block.transform(units).select("block_id", *block.columns), *block.columns)


TREND_SQL = f"""{LABELLED}, tr AS (SELECT * FROM panel WHERE date < DATE '{CUT}'),
td AS (SELECT date, sum(arrivals) AS n, {_DOW} >= 5 AS weekend, date - (SELECT min(date) FROM tr) AS t FROM tr GROUP BY date),
ln0 AS (SELECT weekend, count(*) AS c, regr_slope(ln(greatest(n, 1)), t) AS s, avg(ln(greatest(n, 1))) AS y, avg(t) AS x, ln(greatest(avg(n), 1)) AS flat FROM td GROUP BY 1),
lines AS (SELECT weekend, CASE WHEN c >= 4 THEN s ELSE 0.0 END AS slope, CASE WHEN c >= 4 THEN y - s * x ELSE flat END AS intercept FROM ln0)"""


def calendar_panel(spark, sf):
    return features.Calendar(DAY_TYPES).transform(labelled(spark, sf))


@query("feature_trend_lines", trips_sql(f"{TREND_SQL} SELECT weekend, round(slope, 9) AS slope, round(intercept, 9) AS intercept FROM lines"))
def feature_trend_lines(spark, sf):
    train = calendar_panel(spark, sf).where(F.col("date") < F.lit(CUT))
    return rounded(features.Trend("arrivals").line_table(train).select("weekend", "slope", "intercept"), "slope", "intercept", digits=9)


@query(
    "feature_trend",
    trips_sql(
        f"""{TREND_SQL}, ref AS (SELECT avg(intercept) AS r FROM lines)
SELECT date, round(least(greatest(exp(intercept + slope * (date - (SELECT min(date) FROM tr)) - r), 0.3), 3.0), 6) AS trend_scale, count(*) AS rows
FROM panel JOIN lines ON weekend = ({_WEEKEND} = 1), ref GROUP BY date, intercept, slope, r"""
    ),
)
def feature_trend(spark, sf):
    df = calendar_panel(spark, sf)
    block = features.Trend("arrivals").fit(df.where(F.col("date") < F.lit(CUT)))
    return rounded(block.transform(df), "trend_scale").groupBy("date", "trend_scale").agg(F.count("*").alias("rows"))


PROFILE_SQL = f"""{LABELLED}, tr AS (SELECT * FROM panel WHERE date < DATE '{CUT}' AND block_id NOT LIKE '%7'),
um AS (SELECT block_id, avg(arrivals) AS a, avg(departures) AS d FROM tr GROUP BY 1),
prof AS (SELECT t.block_id, slot, avg(arrivals) AS am, avg(departures) AS dm, stddev_pop(arrivals) AS asd, stddev_pop(departures) AS dsd,
  coalesce(avg(arrivals) / nullif(any_value(a), 0), 0) AS ash, coalesce(avg(departures) / nullif(any_value(d), 0), 0) AS dsh FROM tr t JOIN um USING (block_id) GROUP BY 1, 2),
gl AS (SELECT slot, avg(arrivals) AS ga, avg(departures) AS gd FROM tr GROUP BY 1)"""


def _profile(spark, sf, fallback):
    """Units whose id ends in 7 are kept out of training, so that the fallback has work to do."""
    df = labelled(spark, sf)
    train = df.where((F.col("date") < F.lit(CUT)) & ~F.col("block_id").endswith("7"))
    block = features.Profile(fallback).fit(train)
    out = block.transform(df.select("block_id", "date", "slot"))
    return rounded(out.groupBy("block_id", "slot", *block.columns).agg(F.count("*").alias("rows")), *block.columns)


def _profile_sql(arr: str, dep: str) -> str:
    return trips_sql(
        f"""{PROFILE_SQL} SELECT p.block_id, p.slot, round({arr}, 6) AS arr_slot_mean, round({dep}, 6) AS dep_slot_mean, round(coalesce(asd, 0), 6) AS arr_slot_std,
  round(coalesce(dsd, 0), 6) AS dep_slot_std, round(coalesce(ash, 0), 6) AS arr_slot_share, round(coalesce(dsh, 0), 6) AS dep_slot_share, count(*) AS rows
FROM panel p LEFT JOIN prof f ON f.block_id = p.block_id AND f.slot = p.slot JOIN gl ON gl.slot = p.slot GROUP BY ALL"""
    )


@query("feature_profile", _profile_sql("coalesce(am, 0)", "coalesce(dm, 0)"))
def feature_profile(spark, sf):
    return _profile(spark, sf, "zero")


@query("feature_profile_global", _profile_sql("coalesce(am, ga)", "coalesce(dm, gd)"))
def feature_profile_global(spark, sf):
    return _profile(spark, sf, "global")


@query(
    "feature_weather",
    trips_sql(
        f"""{LABELLED}, {WEATHER_SQL}
SELECT date, slot, precip_mm, round(ln(1 + precip_mm), 6) AS log_precip, CAST(precip_mm > 0 AS DOUBLE) AS is_raining, CAST(precip_mm >= 2 AS DOUBLE) AS is_heavy_rain, temp_c,
  CAST(temp_c <= 2 AS DOUBLE) AS is_cold, CAST(temp_c >= 26 AS DOUBLE) AS is_hot, wind_ms, cloud_pct, count(*) AS rows
FROM panel LEFT JOIN weather ON weather.ts = date_trunc('hour', CAST(date AS TIMESTAMP) + to_minutes(CAST(390 + slot * 30 AS BIGINT))) GROUP BY ALL"""
    ),
)
def feature_weather(spark, sf):
    table = weather_source.normalise(readings(spark, sf), "event_id")
    block = features.Weather(table, MORNING)
    out = rounded(block.transform(labelled(spark, sf)), "log_precip")
    return out.groupBy("date", "slot", *block.columns).agg(F.count("*").alias("rows"))


@query(
    "feature_unit_column",
    trips_sql(
        f"""{LABELLED} SELECT block_id, CAST(count(*) AS DOUBLE) AS n_cells_touched, count(*) AS rows FROM panel GROUP BY 1"""
    ),
)
def feature_unit_column(spark, sf):
    df = labelled(spark, sf)
    sizes = df.groupBy("block_id").agg(F.count("*").alias("n_cells_touched"))
    carried = df.join(sizes, "block_id")
    block = features.UnitColumn().fit(carried)
    return block.transform(carried).groupBy("block_id", "n_cells_touched").agg(F.count("*").alias("rows"))


def weather_table(spark, sf):
    """The reading of each hour as a table, for queries that fit blocks more than once: the events are read for it once."""
    return write_through(weather_source.normalise(readings(spark, sf), "event_id"))


def blocks(spark, sf, target="arrivals", weather=None):
    table = weather_source.normalise(readings(spark, sf), "event_id") if weather is None else weather
    return [
        features.Calendar(DAY_TYPES), features.Geometry(CENTRE), features.Trend(target), features.Profile(),
        features.Weather(table, MORNING),
    ]


_X, _Y = "radians(p.lon - 116.32e0) * 6371000e0 * cos(radians(39.98e0))", "radians(p.lat - 39.98e0) * 6371000e0"
_R = f"sqrt(pow({_X}, 2) + pow({_Y}, 2))"


@query(
    "feature_set",
    trips_sql(
        f"""{TREND_SQL}, ref AS (SELECT avg(intercept) AS r, (SELECT min(date) FROM tr) AS d0, (SELECT min(date) FROM panel) AS w0 FROM lines), {WEATHER_SQL},
um AS (SELECT block_id, avg(arrivals) AS a, avg(departures) AS d FROM tr GROUP BY 1),
prof AS (SELECT t.block_id, slot, avg(arrivals) AS am, avg(departures) AS dm, stddev_pop(arrivals) AS asd, stddev_pop(departures) AS dsd,
  coalesce(avg(arrivals) / nullif(any_value(a), 0), 0) AS ash, coalesce(avg(departures) / nullif(any_value(d), 0), 0) AS dsh FROM tr t JOIN um USING (block_id) GROUP BY 1, 2)
SELECT p.block_id, p.date, p.slot, CAST({_DOW} AS INT) AS dow, {_WEEKEND} AS is_weekend, 1 - {_WEEKEND} AS is_weekday, CAST(date = DATE '{HOLIDAY}' AS INT) AS is_holiday,
  CAST(date + 1 = DATE '{HOLIDAY}' AS INT) AS is_day_before_holiday, CAST(date - 1 = DATE '{HOLIDAY}' AS INT) AS is_day_after_holiday, CAST(date = DATE '{MAKEUP}' AS INT) AS is_makeup_workday,
  CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day_of_month, CAST((date - w0) // 7 AS INT) AS week_of_window, CAST(date - w0 AS INT) AS day_of_window,
  round({_X}, 6) AS x_m, round({_Y}, 6) AS y_m, round({_R}, 6) AS dist_to_centroid_m, round({_Y} / {_R}, 6) AS bearing_sin, round({_X} / {_R}, 6) AS bearing_cos,
  round(least(greatest(exp(intercept + slope * (date - d0) - r), 0.3), 3.0), 6) AS trend_scale,
  round(coalesce(am, 0), 6) AS arr_slot_mean, round(coalesce(dm, 0), 6) AS dep_slot_mean, round(coalesce(asd, 0), 6) AS arr_slot_std, round(coalesce(dsd, 0), 6) AS dep_slot_std,
  round(coalesce(ash, 0), 6) AS arr_slot_share, round(coalesce(dsh, 0), 6) AS dep_slot_share,
  precip_mm, round(ln(1 + precip_mm), 6) AS log_precip, CAST(precip_mm > 0 AS DOUBLE) AS is_raining, CAST(precip_mm >= 2 AS DOUBLE) AS is_heavy_rain, temp_c,
  CAST(temp_c <= 2 AS DOUBLE) AS is_cold, CAST(temp_c >= 26 AS DOUBLE) AS is_hot, wind_ms, cloud_pct
FROM panel p JOIN lines ON weekend = ({_WEEKEND} = 1) CROSS JOIN ref LEFT JOIN prof f ON f.block_id = p.block_id AND f.slot = p.slot
LEFT JOIN weather ON weather.ts = date_trunc('hour', CAST(date AS TIMESTAMP) + to_minutes(CAST(390 + p.slot * 30 AS BIGINT)))"""
    ),
)
def feature_set(spark, sf):
    """All blocks fitted on the past and applied to the whole panel, targets removed first."""
    df = labelled(spark, sf)
    chain = features.FeatureSet(blocks(spark, sf)).fit(df.where(F.col("date") < F.lit(CUT)))
    out = chain.transform(df).select("block_id", "date", *chain.columns)
    made = [c for b in chain.blocks if b.name in ("geometry", "trend", "profile") for c in b.columns]
    return rounded(out, *made, "log_precip")


@query(
    "feature_leak_check",
    trips_sql(
        f"""{LABELLED}, f AS (SELECT arrivals, departures, CAST({_WEEKEND} AS DOUBLE) AS is_weekend, CAST(arrivals + departures > 0 AS DOUBLE) AS leak, CAST(slot AS DOUBLE) AS slot FROM panel)
SELECT 'is_weekend' AS feature, bool_and(is_weekend = CAST(arrivals + departures > 0 AS INT)) OR bool_and(is_weekend = CAST(arrivals + departures = 0 AS INT)) AS leaks FROM f
UNION ALL SELECT 'leak', bool_and(leak = CAST(arrivals + departures > 0 AS INT)) FROM f
UNION ALL SELECT 'slot', bool_and(slot = CAST(arrivals + departures > 0 AS INT)) FROM f"""
    ),
)
def feature_leak_check(spark, sf):
    df = calendar_panel(spark, sf).withColumn("leak", (F.col("arrivals") + F.col("departures") > 0).cast("double"))
    return panel.leaking_columns(df, ["is_weekend", "leak", "slot"])


# ---- rows and weights -------------------------------------------------------

TOP_UNITS = "chosen AS (SELECT block_id FROM panel GROUP BY 1 ORDER BY sum(arrivals + departures) DESC, block_id LIMIT 20)"


@query(
    "row_score_mask",
    trips_sql(
        f"{LABELLED}, {TOP_UNITS} SELECT slot, block_id IN (SELECT block_id FROM chosen) AND slot IN (2, 3) AS scored, count(*) AS n FROM panel GROUP BY 1, 2"
    ),
)
def row_score_mask(spark, sf):
    df = labelled(spark, sf)
    masked = features.with_score_mask(df, features.select_units(df, "top_n", 20), [2, 3])
    return masked.groupBy("slot", "scored").agg(F.count("*").alias("n"))


@query(
    "row_weights",
    trips_sql(
        f"""{LABELLED}, {TOP_UNITS}, tagged AS (SELECT block_id IN (SELECT block_id FROM chosen) AS scored, lat > 39.98e0 AS is_group FROM panel WHERE slot IN (0, 1, 2, 3)),
c AS (SELECT count(*) FILTER (is_group) AS g, count(*) FILTER (NOT is_group) AS o FROM tagged)
SELECT scored, is_group, round(CASE WHEN scored THEN 1.0 ELSE 0.25 END * CASE WHEN is_group THEN 0.3 * (g + o) / g ELSE 0.7 * (g + o) / o END, 6) AS weight, count(*) AS n
FROM tagged, c GROUP BY ALL"""
    ),
)
def row_weights(spark, sf):
    whole = labelled(spark, sf)
    df = features.keep_slots(whole, [0, 1, 2, 3])
    df = features.with_score_mask(df, features.select_units(whole, "top_n", 20))
    df = df.withColumn("is_group", F.col("lat") > CENTRE[0])
    weighted = rounded(features.with_row_weights(df, 0.25, "is_group", 0.3), "weight")
    return weighted.groupBy("scored", "is_group", "weight").agg(F.count("*").alias("n"))


# ---- folds ------------------------------------------------------------------

BLOCKS_SQL = f"""{HOURLY_SQL}, dl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS d FROM (SELECT DISTINCT date FROM hourly)),
bl AS (SELECT date, CAST(p AS INT) AS day_position, CAST((SELECT max(b) FROM range(4) AS r(b) WHERE floor(b * d / 4e0) <= p) AS INT) AS block FROM dl)"""


@query("fold_equal_blocks", trips_sql(f"{BLOCKS_SQL} SELECT date, day_position, block FROM bl"))
def fold_equal_blocks(spark, sf):
    return folds.equal_blocks(hourly(spark, sf), 4)


@query(
    "fold_walk_forward",
    trips_sql(
        f"""{BLOCKS_SQL}, b AS (SELECT block, count(*) AS valid_rows, count(DISTINCT date) AS valid_days, min(date) AS valid_start, max(date) AS valid_end FROM hourly JOIN bl USING (date) GROUP BY 1),
t AS (SELECT *, sum(valid_rows) OVER w AS train_rows, sum(valid_days) OVER w AS train_days, max(valid_end) OVER w AS train_end FROM b WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT block AS fold, valid_rows, valid_days, valid_start, valid_end, CAST(train_rows AS BIGINT) AS train_rows, CAST(train_days AS BIGINT) AS train_days, train_end FROM t WHERE block > 0"""
    ),
)
def fold_walk_forward(spark, sf):
    df = hourly(spark, sf)
    return folds.fold_table(df, folds.folds(df, 4, "walk_forward"))


@query(
    "fold_week_forward",
    trips_sql(
        f"""{LABELLED}, dl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS d FROM (SELECT DISTINCT date FROM panel)),
mon AS (SELECT p, d FROM dl WHERE isodow(date) = 1 AND p < d - 1 AND p > 0),
c1 AS (SELECT p AS c FROM mon ORDER BY abs(p - d / 3e0), p LIMIT 1),
c2 AS (SELECT p AS c FROM mon, c1 WHERE p > c ORDER BY abs(p - c - d / 3e0), p LIMIT 1),
b AS (SELECT CAST(CASE WHEN p >= (SELECT c FROM c2) THEN 2 WHEN p >= (SELECT c FROM c1) THEN 1 ELSE 0 END AS INT) AS block, count(*) AS valid_rows, count(DISTINCT date) AS valid_days,
  min(date) AS valid_start, max(date) AS valid_end FROM panel JOIN dl USING (date) GROUP BY 1),
t AS (SELECT *, sum(valid_rows) OVER w AS train_rows, sum(valid_days) OVER w AS train_days, max(valid_end) OVER w AS train_end FROM b WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT block AS fold, valid_rows, valid_days, valid_start, valid_end, CAST(train_rows AS BIGINT) AS train_rows, CAST(train_days AS BIGINT) AS train_days, train_end FROM t WHERE block > 0"""
    ),
)
def fold_week_forward(spark, sf):
    df = labelled(spark, sf)
    return folds.fold_table(df, folds.folds(df, 3, "week_forward"))


@query(
    "cell_prior",
    trips_sql(
        f"""{BLOCKS_SQL}, tr AS (SELECT cell, avg(n) AS p FROM hourly JOIN bl USING (date) WHERE block < 2 AND cell NOT IN (SELECT min(cell) FROM hourly) GROUP BY 1)
SELECT h.cell, round(coalesce(p, (SELECT avg(p) FROM tr)), 6) AS cell_prior, count(*) AS rows FROM hourly h JOIN bl USING (date) LEFT JOIN tr ON tr.cell = h.cell WHERE block = 2 GROUP BY 1, 2"""
    ),
)
def cell_prior(spark, sf):
    df = hourly(spark, sf)
    fold = folds.folds(df, 4, "walk_forward")[1]
    known = fold.train(df).where(F.col("cell") != df.agg(F.min("cell")).scalar())
    out = models.with_cell_prior(known, fold.valid(df))
    return rounded(out.groupBy("cell", "cell_prior").agg(F.count("*").alias("rows")), "cell_prior")


# ---- seasonal naive and its scores ------------------------------------------

NAIVE_SQL = f"""{BLOCKS_SQL}, hb AS (SELECT h.*, block FROM hourly h JOIN bl USING (date)),
preds AS (SELECT v.block AS fold, v.cell, v.date, v.hour, v.dow, v.n AS actual,
  coalesce((SELECT avg(t.n) FROM hb t WHERE t.block < v.block AND t.cell = v.cell AND t.hour = v.hour AND t.dow = v.dow),
           (SELECT avg(t.n) FROM hb t WHERE t.block < v.block AND t.cell = v.cell AND t.hour = v.hour),
           (SELECT avg(t.n) FROM hb t WHERE t.block < v.block)) AS pred FROM hb v WHERE v.block > 0)"""
DEV = "2 * (CASE WHEN actual > 0 THEN actual * ln(actual / greatest({p}, 1e-9)) ELSE 0 END - (actual - greatest({p}, 1e-9)))"


def naive(spark, sf):
    df = hourly(spark, sf)
    blocked = df.join(F.broadcast(folds.equal_blocks(df, 4).select("date", "block")), "date")
    out = models.seasonal_naive_walk(blocked, ["cell", "hour", "dow"], ["cell", "hour"])
    return out.select("fold", "cell", "date", "hour", "dow", F.col("n").alias("actual"), "pred")


@query("seasonal_naive_folds", trips_sql(f"{NAIVE_SQL} SELECT fold, cell, date, hour, actual, round(pred, 6) AS pred FROM preds"))
def seasonal_naive_folds(spark, sf):
    return rounded(naive(spark, sf).drop("dow"), "pred")


@query(
    "seasonal_naive_fallback",
    trips_sql(
        f"""{BLOCKS_SQL}, hb AS (SELECT h.*, block FROM hourly h JOIN bl USING (date)), tr AS (SELECT * FROM hb WHERE block < 1 AND dow <> 2 AND hour <> 5)
SELECT v.cell, v.date, v.hour, round(coalesce(a.m, b.m, (SELECT avg(n) FROM tr)), 6) AS pred FROM hb v
LEFT JOIN (SELECT cell, hour, dow, avg(n) AS m FROM tr GROUP BY 1, 2, 3) a ON a.cell = v.cell AND a.hour = v.hour AND a.dow = v.dow
LEFT JOIN (SELECT cell, hour, avg(n) AS m FROM tr GROUP BY 1, 2) b ON b.cell = v.cell AND b.hour = v.hour WHERE block = 1"""
    ),
)
def seasonal_naive_fallback(spark, sf):
    """One fold, a weekday and an hour missing from training: both fallbacks are used."""
    df = hourly(spark, sf)
    fold = folds.folds(df, 4, "walk_forward")[0]
    train = fold.train(df).where("dow <> 2 and hour <> 5")
    out = models.seasonal_naive(train, fold.valid(df), ["cell", "hour", "dow"], ["cell", "hour"])
    return rounded(out.select("cell", "date", "hour", "pred"), "pred")


def _measures_sql(pred: str = "pred") -> str:
    return f"""count(*) AS n, round(avg(abs({pred} - actual)), 6) AS mae, round(sqrt(avg(pow({pred} - actual, 2))), 6) AS rmse, round(avg({DEV.format(p=pred)}), 6) AS poisson_deviance,
  round(sum({pred}), 6) AS pred_sum, CAST(sum(actual) AS DOUBLE) AS obs_sum, round(sum({pred}) / nullif(sum(actual), 0), 6) AS calibration, round(avg({pred} - actual), 6) AS bias, round(max({pred}), 6) AS pred_max"""


_MEASURES = ("mae", "rmse", "poisson_deviance", "pred_sum", "calibration", "bias", "pred_max")
BAND = """CASE WHEN actual <= 0 THEN '0' WHEN actual <= 1 THEN '1' WHEN actual <= 2 THEN '2' WHEN actual <= 5 THEN '3-5' WHEN actual <= 10 THEN '6-10' WHEN actual <= 20 THEN '11-20' WHEN actual <= 50 THEN '21-50' ELSE '51+' END"""


@query("score_pooled", trips_sql(f"{NAIVE_SQL} SELECT {_measures_sql()} FROM preds"))
def score_pooled(spark, sf):
    return rounded(scoring.score(naive(spark, sf)), *_MEASURES)


@query(
    "score_by_dimension",
    trips_sql(
        f"""{NAIVE_SQL}, b AS (SELECT *, {BAND} AS band FROM preds)
SELECT CASE WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(cell) = 0 THEN 'cell' WHEN grouping(band) = 0 THEN 'band' ELSE 'all' END AS level,
  fold, hour, cell, band, {_measures_sql()} FROM b GROUP BY GROUPING SETS ((), (fold), (hour), (cell), (band))"""
    ),
)
def score_by_dimension(spark, sf):
    preds = naive(spark, sf).withColumn("band", scoring.count_band(F.col("actual")))
    return rounded(scoring.score_sets(preds, [[], ["fold"], ["hour"], ["cell"], ["band"]]), *_MEASURES)


@query("score_prediction_tail", trips_sql(f"{NAIVE_SQL} SELECT fold, round(quantile_cont(pred, 0.999), 6) AS pred_p999 FROM preds GROUP BY 1"))
def score_prediction_tail(spark, sf):
    return rounded(scoring.prediction_tail(naive(spark, sf), ["fold"]), "pred_p999")


@query("score_mean_residuals", trips_sql(f"{NAIVE_SQL} SELECT cell, count(*) AS n, round(avg(pred - actual), 6) AS mean_residual FROM preds GROUP BY 1"))
def score_mean_residuals(spark, sf):
    return rounded(scoring.mean_residuals(naive(spark, sf), ["cell"]), "mean_residual")


@query(
    "score_error_by_hour",
    trips_sql(
        f"""{NAIVE_SQL} SELECT hour, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mean_err, round(quantile_cont(abs(pred - actual), 0.25), 6) AS q25,
  round(quantile_cont(abs(pred - actual), 0.5), 6) AS q50, round(quantile_cont(abs(pred - actual), 0.75), 6) AS q75 FROM preds GROUP BY 1"""
    ),
)
def score_error_by_hour(spark, sf):
    return rounded(scoring.error_by_hour(naive(spark, sf)), "mean_err", "q25", "q50", "q75")


@query(
    "score_residual_volume",
    trips_sql(
        f"""{NAIVE_SQL}, v AS (SELECT cell, count(*) AS volume FROM (SELECT start_cell6 AS cell FROM trips UNION ALL SELECT end_cell6 FROM trips) GROUP BY 1),
c AS (SELECT round(avg(pred - actual), 9) AS a, any_value(volume) AS b FROM preds JOIN v USING (cell) GROUP BY cell),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b FROM c)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"""
    ),
)
def score_residual_volume(spark, sf):
    volume = cells.cell_counts(trips(spark, sf), 6).select("cell", F.col("n_touching").alias("volume"))
    return rounded(scoring.residual_volume_correlation(naive(spark, sf), volume, "cell"), "rho")


@query(
    "score_extremes",
    trips_sql(
        f"""{NAIVE_SQL}, e AS (SELECT fold, cell, date, hour, actual, round(pred, 6) AS pred, round(pred - actual, 6) AS error FROM preds)
SELECT 'over' AS kind, * FROM (SELECT * FROM e ORDER BY error DESC, cell, date, hour LIMIT 5) UNION ALL SELECT 'under', * FROM (SELECT * FROM e ORDER BY error, cell, date, hour LIMIT 5)"""
    ),
)
def score_extremes(spark, sf):
    preds = rounded(naive(spark, sf).drop("dow"), "pred")
    return rounded(scoring.extreme_errors(preds, ["cell", "date", "hour"]), "error")


GROUP_SQL = f"{NAIVE_SQL}, g AS (SELECT *, substr(cell, 6, 1) IN ('8', '9', 'b', 'c', 'd', 'e', 'f') AS is_group, {DEV.format(p='pred')} AS dev FROM preds)"


def grouped_naive(spark, sf):
    return naive(spark, sf).withColumn("is_group", F.substring("cell", 6, 1).isin(*"89bcdef"))


_LOSS = ("loss_group", "loss_other", "loss_all")


@query(
    "loss_by_group",
    trips_sql(
        f"""{GROUP_SQL} SELECT fold, round(avg(dev) FILTER (is_group), 6) AS loss_group, round(avg(dev) FILTER (NOT is_group), 6) AS loss_other, round(avg(dev), 6) AS loss_all,
  count(*) FILTER (is_group) AS n_group, count(*) FILTER (NOT is_group) AS n_other FROM g GROUP BY 1"""
    ),
)
def loss_by_group(spark, sf):
    return rounded(scoring.group_losses(grouped_naive(spark, sf), "is_group", ["fold"]), *_LOSS)


GAMMAS = [k / 10 for k in range(11)]


def _gamma_sql(loss: str, mode: str) -> str:
    return trips_sql(
        f"""{GROUP_SQL}, l AS (SELECT avg(dev) FILTER (is_group) AS a, avg(dev) FILTER (NOT is_group) AS b, avg(dev) AS c, count(*) FILTER (is_group) AS ng, count(*) FILTER (NOT is_group) AS no FROM g)
SELECT gamma, round({loss}, 6) AS loss, '{mode}' AS mode FROM l, (VALUES {', '.join(f'({g}e0)' for g in GAMMAS)}) AS v(gamma)"""
    )


def _swept(spark, sf, mode):
    losses = scoring.group_losses(grouped_naive(spark, sf), "is_group")
    return rounded(scoring.blend(losses, GAMMAS, mode).select("gamma", "loss", "mode"), "loss")


@query("loss_gamma_sweep", _gamma_sql("gamma * a + (1 - gamma) * b", "group_mean"))
def loss_gamma_sweep(spark, sf):
    return _swept(spark, sf, "group_mean")


@query("loss_row_weighted", _gamma_sql("(gamma * ng * a + (1 - gamma) * no * b) / (gamma * ng + (1 - gamma) * no)", "row_weighted"))
def loss_row_weighted(spark, sf):
    return _swept(spark, sf, "row_weighted")


@query("loss_off", trips_sql(f"{GROUP_SQL} SELECT CAST(NULL AS DOUBLE) AS gamma, round(avg(dev), 6) AS loss, 'off' AS mode FROM g"))
def loss_off(spark, sf):
    return _swept(spark, sf, "off")


SUMS = f"{NAIVE_SQL}, s AS (SELECT fold, sum(actual) AS o, sum(pred) AS r FROM preds GROUP BY 1)"
FACTOR_SQL = f"{SUMS}, f AS (SELECT fold, coalesce(lag(o / r) OVER (ORDER BY fold), 1.0) AS factor FROM s)"


def raw_naive(spark, sf):
    return naive(spark, sf).withColumnRenamed("pred", "pred_raw")


@query("calibration_factors", trips_sql(f"{FACTOR_SQL} SELECT fold, round(factor, 9) AS factor FROM f"))
def calibration_factors(spark, sf):
    return rounded(scoring.forward_factors(raw_naive(spark, sf)), "factor", digits=9)


@query(
    "calibration_factors_compound",
    trips_sql(
        f"""{SUMS}, k AS (SELECT (SELECT o / r FROM s WHERE fold = 1) AS a, (SELECT o / r FROM s WHERE fold = 2) AS b)
SELECT fold, round(CASE fold WHEN 1 THEN 1.0 WHEN 2 THEN a ELSE b / a END, 9) AS factor FROM s, k"""
    ),
)
def calibration_factors_compound(spark, sf):
    return rounded(scoring.forward_factors(raw_naive(spark, sf), compound=True), "factor", digits=9)


@query("calibrated_scores", trips_sql(f"{FACTOR_SQL}, c AS (SELECT p.fold, actual, p.pred * factor AS pred FROM preds p JOIN f USING (fold)) SELECT fold, {_measures_sql()} FROM c GROUP BY 1"))
def calibrated_scores(spark, sf):
    return rounded(scoring.score(scoring.calibrate(raw_naive(spark, sf)), ["fold"]), *_MEASURES)


@query(
    "compare_same_rows",
    trips_sql(
        f"""{NAIVE_SQL}, o AS (SELECT v.cell, v.date, v.hour, v.lag1_ma3 AS p2 FROM hb v WHERE block > 1),
j AS (SELECT actual, pred, p2 FROM preds JOIN o USING (cell, date, hour))
SELECT count(*) AS n, round(avg({DEV.format(p='pred')}), 6) AS deviance_a, round(avg({DEV.format(p='p2')}), 6) AS deviance_b,
  round(100 * (avg({DEV.format(p='p2')}) - avg({DEV.format(p='pred')})) / avg({DEV.format(p='pred')}), 6) AS change_pct FROM j"""
    ),
)
def compare_same_rows(spark, sf):
    """Seasonal naive against the mean of the last three hours, on the rows both cover."""
    df = hourly(spark, sf)
    found = folds.folds(df, 4, "walk_forward")
    other = df.where(folds.fold_number(found) > 1).select("cell", "date", "hour", F.col("lag1_ma3").alias("pred"))
    out = scoring.compare_same_rows(naive(spark, sf), other, ["cell", "date", "hour"])
    return rounded(out, "deviance_a", "deviance_b", "change_pct")


@query(
    "gap_by_cell_and_day_type",
    trips_sql(
        f"""{NAIVE_SQL}, x AS (SELECT cell, isodow(date) >= 6 AS weekend, sum(abs(pred - actual)) AS gap FROM preds GROUP BY 1, 2)
SELECT cell, weekend, round(gap, 6) AS gap, round(100 * gap / sum(gap) OVER (), 6) AS share_pct FROM x"""
    ),
)
def gap_by_cell_and_day_type(spark, sf):
    typed = naive(spark, sf).withColumn("weekend", F.weekday("date") >= 5)
    return rounded(scoring.gap_shares(typed, ["cell", "weekend"]), "gap", "share_pct")


@query(
    "training_without_holidays",
    trips_sql(
        f"""{BLOCKS_SQL}, hb AS (SELECT h.*, block FROM hourly h JOIN bl USING (date)),
arms AS (SELECT 'all' AS arm, 'DATE' AS x UNION ALL SELECT 'dropped', 'x'),
preds AS (SELECT arm, v.block AS fold, v.dow >= 5 AS weekend, v.n AS actual,
  coalesce((SELECT avg(t.n) FROM hb t WHERE t.block < v.block AND t.cell = v.cell AND t.hour = v.hour AND (arm = 'all' OR t.date NOT IN (DATE '2024-01-08', DATE '2024-01-13'))), 0) AS pred
  FROM hb v, arms WHERE v.block > 0)
SELECT arm, weekend, {_measures_sql()} FROM preds GROUP BY 1, 2"""
    ),
)
def training_without_holidays(spark, sf):
    """The same folds with two days left out of training only, scored by day type."""
    df = hourly(spark, sf)
    found = folds.folds(df, 4, "walk_forward")
    special = F.col("date").isin(date(2024, 1, 8), date(2024, 1, 13))

    def run(train, valid):
        return models.seasonal_naive(train, valid, ["cell", "hour"], ["cell"])

    both = models.training_comparison(df, found, special, run)
    typed = both.select("arm", (F.col("dow") >= 5).alias("weekend"), F.col("n").alias("actual"), "pred")
    return rounded(scoring.score(typed, ["arm", "weekend"]), *_MEASURES)


# ---- fitted models ----------------------------------------------------------
# What is exact of a fit: the rows and the observed total of each fold, and that the model does better than predicting the
# scored rows' own overall mean. The scores themselves have no SQL; tests/test_models.py checks them on made-up counts.


def _model_checks(preds):
    flat = preds.withColumn("flat", preds.agg(F.avg("n")).scalar()).withColumnRenamed("n", "actual")
    better = F.avg(scoring.poisson_deviance("actual", "pred")) < F.avg(scoring.poisson_deviance("actual", "flat"))
    return flat.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("actual").cast("double")).alias("obs_sum"), better.alias("beats_mean"))


MODEL_SQL = trips_sql(f"{NAIVE_SQL} SELECT fold, count(*) AS n, CAST(sum(actual) AS DOUBLE) AS obs_sum, true AS beats_mean FROM preds GROUP BY 1")


@query("model_poisson_glm", MODEL_SQL)
def model_poisson_glm(spark, sf):
    df = hourly(spark, sf)
    found = folds.folds(df, 4, "walk_forward")
    return _model_checks(models.walk_forward(df, found, models.glm_fit_predict("poisson")))


@query("model_overdispersed_glm", MODEL_SQL)
def model_overdispersed_glm(spark, sf):
    df = hourly(spark, sf)
    found = folds.folds(df, 4, "walk_forward")
    return _model_checks(models.walk_forward(df, found, models.glm_fit_predict("tweedie")))


@query("model_negative_binomial", MODEL_SQL)
def model_negative_binomial(spark, sf):
    """Negative binomial whose dispersion is estimated on each fold's training rows."""
    df = hourly(spark, sf)
    found = folds.folds(df, 4, "walk_forward")
    return _model_checks(models.walk_forward(df, found, models.negative_binomial_fit_predict()))


BOOSTED = ["hour", "dow", "is_weekend", "lag1", "lag24", "lag168", "lag1_ma3", "cell_prior"]


def _boosted(df, found, loss, rounds=10):
    make = models.poisson_fit_predict if loss == "poisson" else models.boosted_fit_predict
    return models.walk_forward(df, found, make(BOOSTED, rounds=rounds, depth=4))


@query("model_boosted", MODEL_SQL)
def model_boosted(spark, sf):
    """Trees fitted on the Poisson loss."""
    df = hourly(spark, sf)
    return _model_checks(_boosted(df, folds.folds(df, 4, "walk_forward"), "poisson"))


@query("model_boosted_log_counts", MODEL_SQL)
def model_boosted_log_counts(spark, sf):
    """Trees fitted on the squared loss of log counts, brought back to the mean."""
    df = hourly(spark, sf)
    return _model_checks(_boosted(df, folds.folds(df, 4, "walk_forward"), "squared"))


@query("model_boosted_losses")
def model_boosted_losses(spark, sf):
    """Deviance of each fold for either loss."""
    df = hourly(spark, sf)
    found = folds.folds(df, 4, "walk_forward")
    parts = [scoring.score(_boosted(df, found, loss).withColumnRenamed("n", "actual"), ["fold"]).select(F.lit(loss).alias("fitted_on"), "fold", "n", "poisson_deviance") for loss in ("poisson", "squared")]
    return parts[0].unionByName(parts[1])


def slot_rows(spark, sf, df):
    """Rows of a run: all units train, the busiest 20 are scored, units north of the centre are a group with 30 % of the weight."""
    units = write_through(features.top_units(df, 20).select("block_id"))
    group = write_through(df.where(F.col("lat") > CENTRE[0]).select("block_id").distinct())
    return models.Rows(score_units=units, off_target=0.25, group=group, group_weight=0.3)


@query("model_slot_features")
def model_slot_features(spark, sf):
    """Feature blocks and weighted boosted trees on the slot panel for both targets, calibrated forward, on the scored rows."""
    df = labelled(spark, sf)
    found, rows, weather = folds.folds(df, 3, "week_forward"), slot_rows(spark, sf, df), weather_table(spark, sf)

    def scores(target):
        run = models.feature_fit_predict(lambda: blocks(spark, sf, target, weather), target, rows, rounds=5, depth=4)
        preds = scoring.calibrate(write_through(models.walk_forward(df, found, run))).where("scored")
        return rounded(scoring.score(preds, ["fold"]), *_MEASURES).withColumn("target", F.lit(target))

    parts = side_by_side(spark, [lambda t=target: scores(t) for target in features.TARGETS])
    return parts[0].unionByName(parts[1])
