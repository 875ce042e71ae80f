"""Queries over flows between groups and the morning stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.catalog.base import DAY_TYPES, I0, J0, query, rounded, sql_target, sql_workday, trips, trips_sql
from tripweave.functions import geohash as gh
from tripweave.operators import flows, ranking, stock
from tripweave.session import write_through


def _gp_sql(i: str, j: str) -> str:
    return (
        f"CASE WHEN ({i} + {j}) % 4 = 0 OR {i} - {I0} >= 4096 THEN NULL "
        f"ELSE 'G' || CAST(({i} - {I0}) // 32 AS VARCHAR) || '_' || CAST(({j} - {J0}) // 32 AS VARCHAR) END"
    )


GROUPED_SQL = f"""grouped AS (SELECT *, {_gp_sql('s_i', 's_j')} AS sgp, {_gp_sql('e_i', 'e_j')} AS egp FROM trips),
gps AS (SELECT sgp AS gp FROM grouped WHERE sgp IS NOT NULL UNION SELECT egp FROM grouped WHERE egp IS NOT NULL),
cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM trips),
days AS (SELECT date FROM cal WHERE {sql_target('date')})"""
S_WIN, E_WIN = "(s_min >= 390 AND s_min < 630)", "(e_min >= 390 AND e_min < 630)"


def ownership(spark, sf):
    """Cell to group, derived from every cell the trips touch."""
    t = trips(spark, sf)
    cells = t.select(F.explode(F.array("start_geohash", "end_geohash")).alias("geohash")).distinct()
    c = gh.with_index(cells, {"c": "geohash"})
    row, column = F.floor((F.col("c_i") - I0) / 32), F.floor((F.col("c_j") - J0) / 32)
    outside = ((F.col("c_i") + F.col("c_j")) % 4 == 0) | (F.col("c_i") - I0 >= 4096)
    gp = F.when(outside, flows.UNASSIGNED).otherwise(F.concat(F.lit("G"), row.cast("string"), F.lit("_"), column.cast("string")))
    table = c.select(
        "geohash", gp.alias("gp"), gh.centre_lat(F.col("c_i")).alias("lat"), gh.centre_lon(F.col("c_j")).alias("lon")
    )
    # Elsewhere this is a table on disk; it is one here too.
    return write_through(table)


def grouped(spark, sf):
    """Trips with the groups of both ends, and the groups."""
    own = ownership(spark, sf)
    return flows.with_groups(trips(spark, sf), own), flows.assigned(own).select("gp").distinct()


# ---- core cells -------------------------------------------------------------


@query(
    "core_membership",
    trips_sql(f"{GROUPED_SQL} SELECT sgp IS NOT NULL AS start_in, egp IS NOT NULL AS end_in, count(*) AS n FROM grouped GROUP BY 1, 2"),
)
def core_membership(spark, sf):
    core = flows.assigned(ownership(spark, sf)).select("geohash")
    return flows.membership_counts(flows.core_membership(trips(spark, sf), core))


CORE_SQL = f"""{GROUPED_SQL}, o AS (SELECT date, count(*) AS n FROM grouped WHERE sgp IS NOT NULL AND egp IS NULL AND {S_WIN} GROUP BY 1),
i AS (SELECT end_date AS date, count(*) AS n FROM grouped WHERE sgp IS NULL AND egp IS NOT NULL AND {E_WIN} GROUP BY 1),
core AS (SELECT c.date, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(i.n, 0) - coalesce(o.n, 0) AS net_in,
  coalesce(i.n, 0) / nullif(coalesce(o.n, 0), 0) AS in_over_out FROM cal c LEFT JOIN o ON o.date = c.date LEFT JOIN i ON i.date = c.date WHERE {sql_workday('c.date')})"""


def core_daily(spark, sf):
    core = flows.assigned(ownership(spark, sf)).select("geohash")
    tagged = flows.core_membership(trips(spark, sf), core).withColumn("date", F.to_date("start_time"))
    return flows.core_boundary(tagged, DAY_TYPES)


@query("core_boundary_daily", trips_sql(f"{CORE_SQL} SELECT date, n_out, n_in, net_in, round(in_over_out, 6) AS in_over_out FROM core"))
def core_boundary_daily(spark, sf):
    return rounded(core_daily(spark, sf), "in_over_out")


_SUMMARY = ("in_over_out", "mean_net", "sd_net", "se_net", "paired_t", "mean_ratio", "sd_ratio", "min_ratio", "max_ratio")


@query(
    "core_boundary_summary",
    trips_sql(
        f"""{CORE_SQL} SELECT count(*) AS days, CAST(sum(n_out) AS BIGINT) AS out_total, CAST(sum(n_in) AS BIGINT) AS in_total,
  round(sum(n_in) / sum(n_out), 6) AS in_over_out, round(avg(net_in), 6) AS mean_net, round(stddev_samp(net_in), 6) AS sd_net,
  round(stddev_samp(net_in) / sqrt(count(*)), 6) AS se_net, count(*) - 1 AS df, round(avg(net_in) / (stddev_samp(net_in) / sqrt(count(*))), 6) AS paired_t,
  count(*) FILTER (net_in > 0) AS days_net_in, round(avg(in_over_out), 6) AS mean_ratio, round(stddev_samp(in_over_out), 6) AS sd_ratio,
  round(min(in_over_out), 6) AS min_ratio, round(max(in_over_out), 6) AS max_ratio FROM core"""
    ),
)
def core_boundary_summary(spark, sf):
    return rounded(flows.boundary_summary(core_daily(spark, sf)), *_SUMMARY)


# ---- between groups ---------------------------------------------------------

BETWEEN_SQL = f"""{GROUPED_SQL}, btw AS (SELECT * FROM grouped WHERE {sql_target('date')} AND {S_WIN} AND {E_WIN} AND sgp IS NOT NULL AND egp IS NOT NULL AND sgp <> egp),
gf AS (SELECT x.date, g.gp, coalesce(d.n, 0) AS dep, coalesce(a.n, 0) AS arr, coalesce(d.n, 0) - coalesce(a.n, 0) AS net_out FROM gps g CROSS JOIN days x
  LEFT JOIN (SELECT date, sgp AS gp, count(*) AS n FROM btw GROUP BY 1, 2) d ON d.date = x.date AND d.gp = g.gp
  LEFT JOIN (SELECT date, egp AS gp, count(*) AS n FROM btw GROUP BY 1, 2) a ON a.date = x.date AND a.gp = g.gp)"""


def between(spark, sf):
    """Origin-destination counts, groups and target days."""
    all_trips, gps = grouped(spark, sf)
    return flows.od_counts(flows.group_trips(all_trips, DAY_TYPES)), gps, flows.target_days(all_trips, DAY_TYPES)


@query("group_flows_daily", trips_sql(f"{BETWEEN_SQL} SELECT date, gp, dep, arr, net_out FROM gf"))
def group_flows_daily(spark, sf):
    return flows.daily_group_flows(*between(spark, sf))


IMBALANCE_SQL = f"""{BETWEEN_SQL}, imb AS (SELECT date, CAST(sum(dep) AS BIGINT) AS trips, count(*) FILTER (net_out > 0) AS source_gps, count(*) FILTER (net_out < 0) AS sink_gps,
  count(*) FILTER (net_out = 0) AS balanced_gps, CAST(sum(greatest(net_out, 0)) AS BIGINT) AS gross_imbalance, sum(greatest(net_out, 0)) / nullif(sum(dep), 0) AS gross_over_trips
  FROM gf GROUP BY 1)"""


@query("group_imbalance_daily", trips_sql(f"{IMBALANCE_SQL} SELECT * REPLACE (round(gross_over_trips, 6) AS gross_over_trips) FROM imb"))
def group_imbalance_daily(spark, sf):
    return rounded(flows.daily_imbalance(flows.daily_group_flows(*between(spark, sf))), "gross_over_trips")


SUMMARY_SQL = f"""{BETWEEN_SQL}, gsum AS (SELECT gp, avg(dep) AS dep_day, avg(arr) AS arr_day, avg(net_out) AS net_day, stddev_samp(net_out) AS sd_net,
  sum(arr) / nullif(sum(dep), 0) AS in_over_out, count(*) FILTER (net_out > 0) AS days_net_out,
  CASE WHEN sum(net_out) > 0 THEN 'source' WHEN sum(net_out) < 0 THEN 'sink' ELSE 'balanced' END AS role FROM gf GROUP BY 1)"""


@query(
    "group_summary",
    trips_sql(
        f"""{SUMMARY_SQL} SELECT gp, round(dep_day, 6) AS dep_day, round(arr_day, 6) AS arr_day, round(net_day, 6) AS net_day, round(sd_net, 6) AS sd_net,
  round(in_over_out, 6) AS in_over_out, days_net_out, role FROM gsum"""
    ),
)
def group_summary(spark, sf):
    out = flows.group_summary(flows.daily_group_flows(*between(spark, sf)))
    return rounded(out, "dep_day", "arr_day", "net_day", "sd_net", "in_over_out")


@query(
    "group_sources_sinks",
    trips_sql(
        f"""{SUMMARY_SQL} SELECT 'source' AS list, gp, round(net_day, 6) AS net_day FROM (SELECT * FROM gsum ORDER BY net_day DESC, gp LIMIT 5)
UNION ALL SELECT 'sink', gp, round(net_day, 6) FROM (SELECT * FROM gsum ORDER BY net_day, gp LIMIT 5)"""
    ),
)
def group_sources_sinks(spark, sf):
    return rounded(flows.ranked_groups(flows.group_summary(flows.daily_group_flows(*between(spark, sf))), 5), "net_day")


OD_SQL = f"{BETWEEN_SQL}, od AS (SELECT sgp, egp, count(*) AS trips, count(*) / (SELECT count(*) FROM days) AS per_day FROM btw GROUP BY 1, 2)"


@query("od_matrix", trips_sql(f"{OD_SQL} SELECT sgp, egp, trips, round(per_day, 6) AS per_day FROM od"))
def od_matrix(spark, sf):
    od, _, days = between(spark, sf)
    return rounded(flows.od_matrix(od, days), "per_day")


# Every group there is: the ownership table names them by row and column.
GROUPS = [f"G{row}_{column}" for row in range(5) for column in range(5)]


@query(
    "od_matrix_wide",
    trips_sql(
        f"""{OD_SQL} SELECT sgp, {', '.join(f"round(coalesce(sum(per_day) FILTER (egp = '{g}'), 0.0), 6) AS {g}" for g in GROUPS)} FROM od GROUP BY 1"""
    ),
)
def od_matrix_wide(spark, sf):
    od, _, days = between(spark, sf)
    return rounded(flows.od_wide(od, days, GROUPS), *GROUPS)


@query("od_top_pairs", trips_sql(f"{OD_SQL} SELECT sgp, egp, trips, round(per_day, 6) AS per_day FROM od ORDER BY trips DESC, sgp, egp LIMIT 15"))
def od_top_pairs(spark, sf):
    od, _, days = between(spark, sf)
    return rounded(flows.top_pairs(flows.od_matrix(od, days), 15), "per_day")


@query(
    "typical_day",
    trips_sql(
        f"""{IMBALANCE_SQL}, m AS (SELECT quantile_cont(gross_imbalance, 0.5) AS median FROM imb)
SELECT date, gross_imbalance, median, abs(gross_imbalance - median) AS distance FROM imb, m ORDER BY distance, date LIMIT 1"""
    ),
)
def typical_day(spark, sf):
    return flows.typical_day(flows.daily_imbalance(flows.daily_group_flows(*between(spark, sf))))


BEVENTS_SQL = f"""{GROUPED_SQL}, bev AS (SELECT sgp AS gp, date, 1 AS o FROM grouped WHERE {sql_target('date')} AND {S_WIN} AND sgp IS NOT NULL AND egp IS NULL
  UNION ALL SELECT egp, end_date, 0 FROM grouped WHERE {sql_target('date')} AND {E_WIN} AND sgp IS NULL AND egp IS NOT NULL)"""


@query(
    "group_boundary_daily",
    trips_sql(
        f"""{BEVENTS_SQL}, c AS (SELECT d.date, CAST(coalesce(sum(o), 0) AS BIGINT) AS n_out, CAST(coalesce(sum(1 - o), 0) AS BIGINT) AS n_in FROM days d LEFT JOIN bev ON bev.date = d.date GROUP BY 1)
SELECT date, n_out, n_in, n_in - n_out AS net_in, round(n_in / nullif(n_out, 0), 6) AS in_over_out FROM c"""
    ),
)
def group_boundary_daily(spark, sf):
    all_trips, _ = grouped(spark, sf)
    events = flows.group_boundary_events(all_trips, DAY_TYPES)
    return rounded(flows.group_boundary_daily(events, flows.target_days(all_trips, DAY_TYPES)), "in_over_out")


@query(
    "group_boundary_summary",
    trips_sql(
        f"""{BEVENTS_SQL}, c AS (SELECT g.gp, coalesce(sum(o), 0) AS n_out, coalesce(sum(1 - o), 0) AS n_in FROM gps g LEFT JOIN bev ON bev.gp = g.gp GROUP BY 1), n AS (SELECT count(*) AS d FROM days)
SELECT gp, round(n_out / d, 6) AS out_day, round(n_in / d, 6) AS in_day, round((n_out - n_in) / d, 6) AS net_out_day, round(n_in / nullif(n_out, 0), 6) AS in_over_out FROM c, n"""
    ),
)
def group_boundary_summary(spark, sf):
    all_trips, gps = grouped(spark, sf)
    events = flows.group_boundary_events(all_trips, DAY_TYPES)
    out = flows.group_boundary_summary(events, gps, flows.target_days(all_trips, DAY_TYPES))
    return rounded(out, "out_day", "in_day", "net_out_day", "in_over_out")


# ---- ownership tables -------------------------------------------------------

OWN_SQL = f"""own AS (SELECT DISTINCT geohash, i, j, coalesce({_gp_sql('i', 'j')}, 'UNASSIGNED') AS gp FROM (SELECT start_geohash AS geohash, s_i AS i, s_j AS j FROM trips UNION SELECT end_geohash, e_i, e_j FROM trips)),
placed AS (SELECT *, -90e0 + (i + 0.5e0) * 180e0 / 1048576 AS lat, -180e0 + (j + 0.5e0) * 360e0 / 1048576 AS lon FROM own WHERE gp <> 'UNASSIGNED'),
master AS (SELECT gp, count(*) AS n_cells, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM placed GROUP BY 1)"""


@query(
    "group_master",
    trips_sql(
        f"{OWN_SQL} SELECT gp, n_cells, round(lat, 9) AS lat, round(lon, 9) AS lon, round(south, 9) AS south, round(north, 9) AS north, round(west, 9) AS west, round(east, 9) AS east FROM master"
    ),
)
def group_master(spark, sf):
    from tripweave.sources.ownership import group_bounds, with_centroids

    own = ownership(spark, sf)
    empty = own.select("gp").distinct().where("gp <> 'UNASSIGNED'").withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    out = with_centroids(empty, own).join(group_bounds(own), "gp")
    return rounded(out, "lat", "lon", "south", "north", "west", "east", digits=9)


@query(
    "group_datum_check",
    trips_sql(
        f"""{OWN_SQL}, d AS (SELECT p.gp, sqrt(pow((p.lat - m.lat) * 110540, 2) + pow((p.lon - m.lon) * 111320 * cos(radians(m.lat)), 2)) AS metres FROM placed p JOIN master m ON m.gp = p.gp)
SELECT count(*) AS cells, round(max(metres), 6) AS max_m, round(quantile_cont(metres, 0.5), 6) AS median_m, round(quantile_cont(metres, 0.99), 6) AS p99_m, count(*) FILTER (metres > 350) AS beyond FROM d"""
    ),
)
def group_datum_check(spark, sf):
    from tripweave.sources.ownership import centre_distances, with_centroids

    own = ownership(spark, sf)
    empty = own.select("gp").distinct().where("gp <> 'UNASSIGNED'").withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    return rounded(centre_distances(own, with_centroids(empty, own)), "max_m", "median_m", "p99_m")


# ---- stock ------------------------------------------------------------------

STOCK_SQL = f"""{GROUPED_SQL}, wd AS (SELECT DISTINCT date FROM trips WHERE {sql_workday('date')}), tgt AS (SELECT date FROM wd WHERE {sql_target('date')}),
ge AS (SELECT sgp AS gp, date, start_time AS ts, s_min AS m, 1 AS d FROM grouped WHERE sgp IS NOT NULL UNION ALL SELECT egp, end_date, end_time, e_min, 0 FROM grouped WHERE egp IS NOT NULL),
sp AS (SELECT g.gp, t.date, CAST(s AS INT) AS slot, coalesce(dep, 0) AS dep, coalesce(arr, 0) AS arr FROM gps g CROSS JOIN tgt t CROSS JOIN range(8) AS r(s)
  LEFT JOIN (SELECT gp, date, (m - 390) // 30 AS slot, CAST(sum(d) AS BIGINT) AS dep, CAST(sum(1 - d) AS BIGINT) AS arr FROM ge WHERE m >= 390 AND m < 630 GROUP BY 1, 2, 3) c
  ON c.gp = g.gp AND c.date = t.date AND c.slot = s),
cum AS (SELECT *, sum(dep) OVER (PARTITION BY gp, date ORDER BY slot) - coalesce(sum(arr) OVER (PARTITION BY gp, date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS need FROM sp),
lb AS (SELECT gp, avg(need) AS m FROM (SELECT gp, date, max(greatest(need, 0)) AS need FROM cum GROUP BY 1, 2) GROUP BY 1)"""


def stock_inputs(spark, sf):
    """Half-hour counts, groups, observed workdays, target days and the morning panel."""
    all_trips, gps = grouped(spark, sf)
    steps = write_through(stock.step_counts(all_trips))
    workdays = write_through(stock.observed_workdays(all_trips, DAY_TYPES))
    days = stock.stock_days(workdays, DAY_TYPES)
    return steps, gps, workdays, days, stock.slot_panel(steps, gps, days)


@query("stock_slot_panel", trips_sql(f"{STOCK_SQL} SELECT gp, date, slot, dep, arr FROM sp"))
def stock_slot_panel(spark, sf):
    return stock_inputs(spark, sf)[4]


@query(
    "stock_hour_window",
    trips_sql(
        f"""{STOCK_SQL} SELECT g.gp, t.date, coalesce(dep, 0) AS dep, coalesce(arr, 0) AS arr FROM gps g CROSS JOIN tgt t
LEFT JOIN (SELECT gp, date, CAST(sum(d) AS BIGINT) AS dep, CAST(sum(1 - d) AS BIGINT) AS arr FROM ge WHERE m < 360 GROUP BY 1, 2) c ON c.gp = g.gp AND c.date = t.date"""
    ),
)
def stock_hour_window(spark, sf):
    steps, gps, _, days, _ = stock_inputs(spark, sf)
    return stock.hour_window(steps, gps, days, stock.EARLY_HOURS)


@query("stock_lower_bound", trips_sql(f"{STOCK_SQL} SELECT gp, round(m, 6) AS m FROM lb"))
def stock_lower_bound(spark, sf):
    return rounded(stock.lower_bounds(stock_inputs(spark, sf)[4]), "m")


PRIOR_SQL = f"""{STOCK_SQL}, pv AS (SELECT * FROM (SELECT date, lag(date) OVER (ORDER BY date) AS previous FROM wd) WHERE previous IS NOT NULL AND date IN (SELECT date FROM tgt)),
nt AS (SELECT p.date AS night, gp, sum(1 - d) AS arr, greatest(sum(1 - d) - sum(d), 0) AS gain FROM ge JOIN pv p ON (ge.date = p.previous AND m >= 1320) OR (ge.date = p.date AND m < 360) GROUP BY 1, 2),
pr AS (SELECT g.gp, CAST(coalesce(sum(CASE WHEN tot = 0 THEN arr ELSE gain END), 0) AS BIGINT) AS w FROM gps g LEFT JOIN (SELECT *, sum(gain) OVER (PARTITION BY night) AS tot FROM nt) n ON n.gp = g.gp GROUP BY 1)"""


@query("stock_previous_workday", trips_sql(f"{PRIOR_SQL} SELECT date, previous FROM pv"))
def stock_previous_workday(spark, sf):
    _, _, workdays, days, _ = stock_inputs(spark, sf)
    return stock.previous_workdays(workdays, days)


@query("stock_overnight_prior", trips_sql(f"{PRIOR_SQL} SELECT gp, w FROM pr"))
def stock_overnight_prior(spark, sf):
    return prior(spark, sf)[1]


def prior(spark, sf):
    steps, gps, workdays, days, panel = stock_inputs(spark, sf)
    return panel, stock.overnight_prior(steps, gps, stock.previous_workdays(workdays, days))


FACTORS = [1.0, 1.25, 1.5, 2.0, 3.0]


def allocated(spark, sf):
    panel, w = prior(spark, sf)
    # One row per group; every scenario starts from it.
    bounds = write_through(stock.lower_bounds(panel).join(w, "gp"))
    return panel, stock.allocate(stock.scenarios(bounds, FACTORS), ["factor"])


# Rates by a self-join on "presses harder" instead of running sums.
ALLOC_SQL = f"""{PRIOR_SQL}, sc AS (SELECT f AS factor, gp, m, w, f * (SELECT sum(m) FROM lb) AS total FROM lb JOIN pr USING (gp), (VALUES {', '.join(f'({f}e0)' for f in FACTORS)}) AS v(f)),
wt AS (SELECT *, greatest(w / (SELECT sum(w) FROM pr), 1e-9) AS v FROM sc),
sh AS (SELECT *, total * v / sum(v) OVER (PARTITION BY factor) AS a, m / (total * v / sum(v) OVER (PARTITION BY factor)) AS press FROM wt),
rt AS (SELECT x.factor, x.gp, any_value(x.m) AS m, any_value(x.a) AS a, any_value(x.press) AS press, any_value(x.total) AS total,
  any_value(x.total) - coalesce(sum(y.m), 0) AS need, any_value(x.total) - coalesce(sum(y.a), 0) AS free
  FROM sh x LEFT JOIN sh y ON y.factor = x.factor AND (y.press > x.press OR (y.press = x.press AND y.gp < x.gp)) GROUP BY 1, 2),
ok AS (SELECT factor, max(press) AS press, arg_min(need / free, (-press, gp)) AS rate FROM rt WHERE free > 1e-12 AND press <= need / free * (1 + 1e-9) GROUP BY 1),
al AS (SELECT rt.*, CASE WHEN ok.press IS NULL OR rt.press > ok.press THEN m ELSE a * rate END AS stock, ok.press IS NULL OR rt.press > ok.press AS pinned FROM rt LEFT JOIN ok USING (factor))"""


@query("stock_allocation", trips_sql(f"{ALLOC_SQL} SELECT factor, gp, round(stock, 6) AS stock FROM al"))
def stock_allocation(spark, sf):
    return rounded(allocated(spark, sf)[1].select("factor", "gp", "stock"), "stock")


@query(
    "stock_scenarios",
    trips_sql(
        f"""{ALLOC_SQL} SELECT factor, round(max(total), 6) AS total, round(sum(stock), 6) AS allocated, count(*) FILTER (stock <= m * (1 + 1e-9)) AS on_floor,
  round(max(stock), 6) AS max_stock FROM al GROUP BY 1"""
    ),
)
def stock_scenarios(spark, sf):
    out = allocated(spark, sf)[1].withColumn("pinned", F.col("stock") <= F.col("m") * (1 + 1e-9))
    return rounded(stock.scenario_report(out), "total", "allocated", "max_stock")


@query(
    "stock_feasibility",
    trips_sql(
        f"""{STOCK_SQL} SELECT f AS factor, round(f * s, 6) AS total, round(s, 6) AS least, f * s >= s - 1e-9 AS feasible
FROM (SELECT sum(m) AS s FROM lb), (VALUES (0.5e0), (0.9e0), (1.0e0), (1.5e0)) AS v(f)"""
    ),
)
def stock_feasibility(spark, sf):
    panel, w = prior(spark, sf)
    bounds = write_through(stock.lower_bounds(panel).join(w, "gp"))
    return rounded(stock.feasibility(stock.scenarios(bounds, [0.5, 0.9, 1.0, 1.5])), "total", "least")


@query(
    "stock_capacity",
    trips_sql(
        f"""{ALLOC_SQL}, tr AS (SELECT p.gp, p.date, p.dep, stock, stock + sum(arr - dep) OVER w AS af,
  stock + coalesce(sum(arr - dep) OVER (PARTITION BY p.gp, p.date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf
  FROM sp p JOIN al ON al.gp = p.gp AND al.factor = 1.5 WINDOW w AS (PARTITION BY p.gp, p.date ORDER BY slot))
SELECT gp, CAST(ceil(round(greatest(max(stock), max(af)), 9)) AS BIGINT) AS q, count(DISTINCT date) FILTER (bf - dep < -1e-9) AS short_days FROM tr GROUP BY 1"""
    ),
)
def stock_capacity(spark, sf):
    panel, split = allocated(spark, sf)
    start = split.where("factor = 1.5").withColumn("stock", F.round("stock", 9))
    return stock.capacity(stock.trajectories(panel, start))


@query(
    "stock_concentration",
    trips_sql(
        f"""{ALLOC_SQL}, x AS (SELECT stock, row_number() OVER (ORDER BY stock, gp) AS i, row_number() OVER (ORDER BY stock DESC, gp) AS r, count(*) OVER () AS c FROM al WHERE factor = 1.5)
SELECT any_value(c) AS holders, round(sum(stock), 6) AS total, round((2 * sum(i * stock) - (any_value(c) + 1) * sum(stock)) / (any_value(c) * sum(stock)), 6) AS gini,
  round(100 * sum(stock) FILTER (r <= 5) / sum(stock), 6) AS top5_share_pct FROM x"""
    ),
)
def stock_concentration(spark, sf):
    held = allocated(spark, sf)[1].where("factor = 1.5").select("gp", "stock")
    top = held.orderBy(F.desc("stock"), "gp").limit(5).agg(F.sum("stock")).scalar()
    out = ranking.gini(held, "stock").withColumn("top5_share_pct", 100 * top / F.col("total"))
    return rounded(out, "total", "gini", "top5_share_pct")


@query(
    "stock_rank_correlation",
    trips_sql(
        f"""{PRIOR_SQL}, c AS (SELECT m, w FROM lb JOIN pr USING (gp)),
r AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS b FROM c)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"""
    ),
)
def stock_rank_correlation(spark, sf):
    panel, w = prior(spark, sf)
    return rounded(ranking.average_rank_correlation(stock.lower_bounds(panel).join(w, "gp"), "m", "w"), "rho")
