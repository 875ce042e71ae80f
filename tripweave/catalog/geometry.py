"""Queries over cells, grids and the ring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.catalog.base import I0, J0, query, rounded, sql_encode, sql_haversine, sql_lat, sql_lon, trips, trips_sql
from tripweave.functions import geohash as gh
from tripweave.functions import polygon
from tripweave.operators import cells, region
from tripweave.operators.annotate import add_movement, add_places, add_times

SIDE = 9  # cells per ring edge


def _corner(i: int, j: int) -> tuple[float, float]:
    height, width = gh.cell_size(8)
    return (I0 + i) * height - 90.0, (J0 + j) * width - 180.0


def _side(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[float, float]]:
    """Vertices from a (inclusive) to b (exclusive), SIDE cells apart."""
    steps = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    marks = range(0, steps, SIDE)
    sign = lambda x: (x > 0) - (x < 0)
    return [_corner(a[0] + sign(b[0] - a[0]) * k, a[1] + sign(b[1] - a[1]) * k) for k in marks]


# An L: cells I0+30..110 by J0+30..110 without the north-east quarter.
CORNERS = [(30, 30), (30, 111), (71, 111), (71, 71), (111, 71), (111, 30)]
RING = [v for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1]) for v in _side(a, b)]


def sql_inside(i: str, j: str) -> str:
    return (
        f"({i} BETWEEN {I0 + 30} AND {I0 + 110} AND {j} BETWEEN {J0 + 30} AND {J0 + 110} "
        f"AND NOT ({i} >= {I0 + 71} AND {j} >= {J0 + 71}))"
    )


CLASS_SQL = f"""classed AS (
  SELECT *, CASE WHEN a AND b THEN 'internal' WHEN a THEN 'outflow' WHEN b THEN 'inflow' ELSE 'external' END AS class
  FROM (SELECT *, {sql_inside('s_i', 's_j')} AS a, {sql_inside('e_i', 'e_j')} AS b FROM trips))"""


def placed(spark, sf):
    return add_places(add_times(trips(spark, sf)), levels=(6,))


def classed(spark, sf):
    return region.classify(placed(spark, sf), RING)


# ---- cells ----------------------------------------------------------------

ENDS6 = """ends AS (SELECT s_i >> 5 AS i, s_j >> 5 AS j, start_cell6 AS cell, 1 AS d FROM trips
  UNION ALL SELECT e_i >> 5, e_j >> 5, end_cell6, 0 FROM trips),
summ AS (SELECT cell, i, j, CAST(sum(d) AS BIGINT) AS n_departures, CAST(sum(1 - d) AS BIGINT) AS n_arrivals FROM ends GROUP BY 1, 2, 3)"""
SAMPLE = f"""sampled AS (
  SELECT cell, avg(CAST({sql_inside("floor(i * 32 + (a + 0.5) * 2)", "floor(j * 32 + (b + 0.5) * 2)")} AS INT)) AS inside_frac
  FROM summ, range(16) AS ra(a), range(16) AS rb(b) GROUP BY 1)"""


@query(
    "cell_summary_l6",
    trips_sql(
        f"""{ENDS6}, {SAMPLE}
SELECT cell, n_departures, n_arrivals, n_departures + n_arrivals AS n_touching, n_departures - n_arrivals AS net_out,
  round({sql_lat('i', 6)}, 9) AS lat, round({sql_lon('j', 6)}, 9) AS lon, inside_frac,
  {sql_inside("i * 32 + 16", "j * 32 + 16")} AS in_region,
  CASE WHEN inside_frac >= 0.999 THEN 'complete' WHEN inside_frac > 0 THEN 'straddle' ELSE 'outside' END AS completeness
FROM summ JOIN sampled USING (cell)"""
    ),
)
def cell_summary_l6(spark, sf):
    return rounded(cells.cell_summary(trips(spark, sf), RING, 6), "lat", "lon", digits=9)


@query(
    "cell_summary_l8",
    trips_sql(
        f"""summ AS (SELECT i, j, CAST(sum(d) AS BIGINT) AS n_departures, CAST(sum(1 - d) AS BIGINT) AS n_arrivals FROM
  (SELECT s_i AS i, s_j AS j, 1 AS d FROM trips UNION ALL SELECT e_i, e_j, 0 FROM trips) GROUP BY 1, 2)
SELECT {sql_encode('i', 'j')} AS cell, n_departures, n_arrivals, n_departures + n_arrivals AS n_touching,
  n_departures - n_arrivals AS net_out, round({sql_lat('i')}, 9) AS lat, round({sql_lon('j')}, 9) AS lon FROM summ"""
    ),
)
def cell_summary_l8(spark, sf):
    return rounded(cells.with_centre(cells.cell_counts(trips(spark, sf), 8), 8), "lat", "lon", digits=9)


@query(
    "cells_top_touching",
    trips_sql(f"{ENDS6} SELECT cell, n_departures + n_arrivals AS n_touching FROM summ ORDER BY n_touching DESC, cell LIMIT 10"),
)
def cells_top_touching(spark, sf):
    counts = cells.cell_counts(trips(spark, sf), 6).select("cell", "n_touching")
    return counts.orderBy(F.desc("n_touching"), "cell").limit(10)


@query(
    "cells_net_extremes",
    trips_sql(
        f"""{ENDS6}, net AS (SELECT cell, n_departures - n_arrivals AS net_out FROM summ)
SELECT 'drains' AS kind, * FROM (SELECT * FROM net ORDER BY net_out DESC, cell LIMIT 5)
UNION ALL SELECT 'fills', * FROM (SELECT * FROM net ORDER BY net_out, cell LIMIT 5)"""
    ),
)
def cells_net_extremes(spark, sf):
    net = cells.cell_counts(trips(spark, sf), 6).select("cell", "net_out")
    drains = net.orderBy(F.desc("net_out"), "cell").limit(5).select(F.lit("drains").alias("kind"), "*")
    fills = net.orderBy("net_out", "cell").limit(5).select(F.lit("fills").alias("kind"), "*")
    return drains.unionByName(fills)


def _near_sql(pad_lat: str, pad_lon: str) -> str:
    south, west, north, east = polygon.ring_box(RING)
    return (
        f"{sql_lat('i', 6)} BETWEEN '{south!r}'::DOUBLE - {pad_lat} AND '{north!r}'::DOUBLE + {pad_lat} AND "
        f"{sql_lon('j', 6)} BETWEEN '{west!r}'::DOUBLE - {pad_lon} AND '{east!r}'::DOUBLE + {pad_lon}"
    )


_BOX = polygon.ring_box(RING)


@query(
    "cells_in_window",
    trips_sql(
        f"{ENDS6} SELECT cell, n_departures + n_arrivals AS n_touching FROM summ WHERE "
        + _near_sql("0.8e0 * 1000 / 110540", f"(0.8e0 * 1000 / (111320 * cos(radians(('{_BOX[0]!r}'::DOUBLE + '{_BOX[2]!r}'::DOUBLE) / 2))))")
    ),
)
def cells_in_window(spark, sf):
    summary = cells.with_centre(cells.cell_counts(trips(spark, sf), 6), 6)
    return cells.window_cells(summary, RING, 0.8).select("cell", "n_touching")


@query(
    "cells_active_in_box",
    trips_sql(f"{ENDS6} SELECT cell, n_departures + n_arrivals AS n_touching FROM summ WHERE " + _near_sql("0.004e0", "0.004e0")),
)
def cells_active_in_box(spark, sf):
    summary = cells.with_centre(cells.cell_counts(trips(spark, sf), 6), 6)
    return cells.active_cells(summary, RING, 0.004).select("cell", "n_touching")


# ---- lattice and grids ----------------------------------------------------


@query(
    "geohash_levels",
    trips_sql(
        "SELECT DISTINCT " + ", ".join(
            f"{sql_encode(f'(e_i >> {20 - gh.axis_bits(n)[0]})', f'(e_j >> {20 - gh.axis_bits(n)[1]})', n)} AS cell{n}, "
            f"e_i >> {20 - gh.axis_bits(n)[0]} AS i{n}, e_j >> {20 - gh.axis_bits(n)[1]} AS j{n}"
            for n in (4, 5, 6, 7)
        ) + " FROM trips"
    ),
)
def geohash_levels(spark, sf):
    """Coarser cells by truncation, with the index of every level decoded and encoded again."""
    ends = trips(spark, sf).select(*[gh.truncate(F.col("end_geohash"), n).alias(f"cell{n}") for n in (4, 5, 6, 7)]).distinct()
    for n in (4, 5, 6, 7):
        ends = ends.withColumns({f"i{n}": gh.lat_index(F.col(f"cell{n}"), n), f"j{n}": gh.lon_index(F.col(f"cell{n}"), n)})
        ends = ends.withColumn(f"cell{n}", gh.encode(F.col(f"i{n}"), F.col(f"j{n}"), n))
    return ends


@query(
    "geohash_bounds",
    trips_sql(
        f"""SELECT DISTINCT start_geohash AS cell, round(-90e0 + s_i * 180e0 / 1048576, 9) AS south, round(-180e0 + s_j * 360e0 / 1048576, 9) AS west,
  round(-90e0 + (s_i + 1) * 180e0 / 1048576, 9) AS north, round(-180e0 + (s_j + 1) * 360e0 / 1048576, 9) AS east,
  s_i AS again_i, s_j AS again_j FROM trips"""
    ),
)
def geohash_bounds(spark, sf):
    c = trips(spark, sf).select(F.col("start_geohash").alias("cell")).distinct()
    c = gh.with_index(c, {"c": "cell"})
    again_i, again_j = gh.index_from_centre(gh.centre_lat(F.col("c_i")), gh.centre_lon(F.col("c_j")))
    out = c.select(
        "cell", gh.south(F.col("c_i")).alias("south"), gh.west(F.col("c_j")).alias("west"),
        gh.south(F.col("c_i") + 1).alias("north"), gh.west(F.col("c_j") + 1).alias("east"),
        again_i.alias("again_i"), again_j.alias("again_j"),
    )
    return rounded(out, "south", "west", "north", "east", digits=9)


@query(
    "geohash_alias",
    trips_sql(
        f"SELECT DISTINCT start_geohash AS cell, {sql_encode('(s_i - 1)', '(s_j - 1)')} AS alias, start_geohash AS again FROM trips"
    ),
)
def geohash_alias(spark, sf):
    c = trips(spark, sf).select(F.col("start_geohash").alias("cell")).distinct()
    c = c.withColumn("alias", gh.south_west_alias(F.col("cell")))
    return c.withColumn("again", gh.cell_from_alias(F.col("alias")))


@query(
    "grid_units_3x3",
    trips_sql(
        f"""SELECT {sql_encode('(s_i - s_i % 3)', '(s_j - s_j % 3)')} AS unit, count(*) AS n_departures,
  count(DISTINCT start_geohash) AS cells FROM trips GROUP BY 1"""
    ),
)
def grid_units_3x3(spark, sf):
    """Departures per aligned 3 x 3 unit: cells first, then the few distinct cells are grouped."""
    per_cell = trips(spark, sf).groupBy("start_geohash").agg(F.count("*").alias("n"))
    units = per_cell.withColumn("unit", gh.unit_id(F.col("start_geohash"), 8, 3, 3))
    return units.groupBy("unit").agg(F.sum("n").alias("n_departures"), F.count("*").alias("cells"))


@query(
    "grid_members_aligned",
    trips_sql(
        f"""units AS (SELECT DISTINCT s_i - s_i % 2 AS i, s_j - s_j % 3 AS j FROM trips)
SELECT {sql_encode('i', 'j')} AS unit, {sql_encode('(i + a)', '(j + b)')} AS cell FROM units, range(2) AS ra(a), range(3) AS rb(b)"""
    ),
)
def grid_members_aligned(spark, sf):
    starts = trips(spark, sf).select("start_geohash").distinct()
    units = starts.select(gh.unit_id(F.col("start_geohash"), 8, 2, 3).alias("unit")).distinct()
    return cells.unit_members(units, 8, 2, 3)


@query(
    "grid_overlap_centred",
    trips_sql(
        """units AS (SELECT DISTINCT s_i AS i, s_j AS j FROM trips),
members AS (SELECT i + a AS i, j + b AS j, count(*) AS units FROM units, range(-1, 2) AS ra(a), range(-1, 2) AS rb(b) GROUP BY 1, 2)
SELECT CAST(sum(units) AS BIGINT) AS memberships, count(*) AS cells, max(units) AS max_units, sum(units) = count(*) AS is_partition FROM members"""
    ),
)
def grid_overlap_centred(spark, sf):
    units = trips(spark, sf).select(F.col("start_geohash").alias("unit")).distinct()
    return cells.overlap_report(cells.unit_members(units, 8, 3, 3, aligned=False))


@query(
    "grid_corner_share",
    trips_sql(
        """SELECT count(*) AS ids, round(avg(CAST(s_i % 2 = 0 AND s_j % 2 = 0 AS INT)), 9) AS corner_share
  FROM (SELECT DISTINCT s_i, s_j FROM trips)"""
    ),
)
def grid_corner_share(spark, sf):
    ids = trips(spark, sf).select("start_geohash").distinct()
    return rounded(cells.block_corner_share(ids, 8, 2, 2), "corner_share", digits=9)


# ---- ring -----------------------------------------------------------------


@query("ring_class_counts", trips_sql(f"{CLASS_SQL} SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM classed GROUP BY 1"))
def ring_class_counts(spark, sf):
    return rounded(region.class_counts(classed(spark, sf)), "share_pct")


@query(
    "ring_hourly_balance",
    trips_sql(
        f"""{CLASS_SQL}, across AS (SELECT * FROM classed WHERE class IN ('inflow', 'outflow')),
days AS (SELECT is_weekend, count(DISTINCT date) AS d FROM across GROUP BY 1)
SELECT is_weekend, hour, round(count(*) FILTER (class = 'inflow') / any_value(d), 6) AS inflow,
  round(count(*) FILTER (class = 'outflow') / any_value(d), 6) AS outflow,
  round((count(*) FILTER (class = 'inflow') - count(*) FILTER (class = 'outflow')) / any_value(d), 6) AS net_in
FROM across JOIN days USING (is_weekend) GROUP BY 1, 2"""
    ),
)
def ring_hourly_balance(spark, sf):
    return rounded(region.hourly_balance(classed(spark, sf)), "inflow", "outflow", "net_in")


DAILY_SQL = f"""{CLASS_SQL}, daily AS (
  SELECT date, count(*) FILTER (class = 'inflow') AS inflow, count(*) FILTER (class = 'outflow') AS outflow,
         count(*) FILTER (class = 'inflow') - count(*) FILTER (class = 'outflow') AS net_in
  FROM classed WHERE class IN ('inflow', 'outflow') GROUP BY 1)"""


@query("ring_daily_balance", trips_sql(f"{DAILY_SQL} SELECT * FROM daily"))
def ring_daily_balance(spark, sf):
    return region.daily_balance(classed(spark, sf))


@query(
    "ring_weekly_balance",
    trips_sql(f"{DAILY_SQL} SELECT CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week_ending, CAST(sum(net_in) AS BIGINT) AS net_in FROM daily GROUP BY 1"),
)
def ring_weekly_balance(spark, sf):
    return region.weekly_balance(region.daily_balance(classed(spark, sf)))


@query(
    "ring_net_t_statistic",
    trips_sql(
        f"""{DAILY_SQL} SELECT count(*) AS n, round(avg(net_in), 6) AS mean, round(stddev_samp(net_in), 6) AS sd,
  round(stddev_samp(net_in) / sqrt(count(*)), 6) AS std_error, count(*) - 1 AS df,
  round(avg(net_in) / (stddev_samp(net_in) / sqrt(count(*))), 6) AS t FROM daily"""
    ),
)
def ring_net_t_statistic(spark, sf):
    return rounded(region.one_sample_t(region.daily_balance(classed(spark, sf)), "net_in"), "mean", "sd", "std_error", "t")


@query(
    "ring_gateways",
    trips_sql(
        f"""{CLASS_SQL}, o AS (SELECT class, CASE WHEN class = 'inflow' THEN start_cell6 ELSE end_cell6 END AS cell,
  CASE WHEN class = 'inflow' THEN start_lat ELSE end_lat END AS la, CASE WHEN class = 'inflow' THEN start_lon ELSE end_lon END AS lo
  FROM classed WHERE class IN ('inflow', 'outflow')),
i AS (SELECT cell, count(*) AS n, avg(la) AS la, avg(lo) AS lo FROM o WHERE class = 'inflow' GROUP BY 1),
u AS (SELECT cell, count(*) AS n, avg(la) AS la, avg(lo) AS lo FROM o WHERE class = 'outflow' GROUP BY 1)
SELECT coalesce(i.cell, u.cell) AS cell, coalesce(i.n, 0) AS n_inflow, coalesce(u.n, 0) AS n_outflow,
  coalesce(i.n, 0) - coalesce(u.n, 0) AS net_in, round(coalesce(i.la, u.la), 9) AS lat, round(coalesce(i.lo, u.lo), 9) AS lon
FROM i FULL JOIN u ON i.cell = u.cell"""
    ),
)
def ring_gateways(spark, sf):
    return rounded(region.gateways(classed(spark, sf)), "lat", "lon", digits=9)


_LENGTHS = region.edge_lengths(RING)


def _arc_ids() -> list[int]:
    ids, arc, metres = [], 0, 0.0
    for length in _LENGTHS:
        if metres >= 300.0:
            arc, metres = arc + 1, 0.0
        metres += length
        ids.append(arc)
    return ids


EDGES_SQL = "edges(edge, lat1, lon1, lat2, lon2, length_m, arc) AS (VALUES " + ", ".join(
    f"({k}, '{a[0]!r}'::DOUBLE, '{a[1]!r}'::DOUBLE, '{b[0]!r}'::DOUBLE, '{b[1]!r}'::DOUBLE, '{_LENGTHS[k]!r}'::DOUBLE, {_arc_ids()[k]})"
    for k, (a, b) in enumerate(zip(RING, RING[1:] + RING[:1]))
) + ")"

CROSS_SQL = f"""{CLASS_SQL}, {EDGES_SQL},
met AS (
  SELECT order_id, class, edge, start_lat, start_lon, end_lat, end_lon,
    ((lat1 - start_lat) * (lon2 - lon1) - (lon1 - start_lon) * (lat2 - lat1))
      / ((end_lat - start_lat) * (lon2 - lon1) - (end_lon - start_lon) * (lat2 - lat1)) AS t,
    ((lat1 - start_lat) * (end_lon - start_lon) - (lon1 - start_lon) * (end_lat - start_lat))
      / ((end_lat - start_lat) * (lon2 - lon1) - (end_lon - start_lon) * (lat2 - lat1)) AS u
  FROM classed, edges WHERE class IN ('inflow', 'outflow')
    AND abs((end_lat - start_lat) * (lon2 - lon1) - (end_lon - start_lon) * (lat2 - lat1)) > 1e-15),
hits AS (
  SELECT * FROM met WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY t, edge) = 1)"""


@query(
    "ring_crossing_points",
    trips_sql(
        f"""{CROSS_SQL} SELECT order_id, class, edge, round(start_lat + t * (end_lat - start_lat), 9) AS x_lat,
  round(start_lon + t * (end_lon - start_lon), 9) AS x_lon FROM hits"""
    ),
)
def ring_crossing_points(spark, sf):
    found = region.crossings(classed(spark, sf), RING).select("order_id", "class", "edge", "x_lat", "x_lon")
    return rounded(found, "x_lat", "x_lon", digits=9)


@query(
    "ring_crossings_per_edge",
    trips_sql(
        f"""{CROSS_SQL} SELECT edge, round((lat1 + lat2) / 2, 9) AS lat, round((lon1 + lon2) / 2, 9) AS lon, round(length_m, 6) AS length_m,
  count(*) AS n, count(*) FILTER (class = 'inflow') AS n_in, count(*) FILTER (class = 'outflow') AS n_out,
  round(count(*) / (length_m / 1000), 6) AS per_km FROM hits JOIN edges USING (edge) GROUP BY edge, lat1, lat2, lon1, lon2, length_m"""
    ),
)
def ring_crossings_per_edge(spark, sf):
    crossed = region.crossings(classed(spark, sf), RING)
    out = region.crossings_per_edge(crossed, region.edge_table(spark, RING))
    return rounded(rounded(out, "lat", "lon", digits=9), "length_m", "per_km")


ARCS_SQL = f"""{CROSS_SQL}, extent AS (
  SELECT arc, sum(length_m) AS length_m, (min(edge) + max(edge)) // 2 AS mid, least(min(lat1), min(lat2)) AS south,
         greatest(max(lat1), max(lat2)) AS north, least(min(lon1), min(lon2)) AS west FROM edges GROUP BY 1),
tally AS (SELECT arc, count(*) AS n, count(*) FILTER (class = 'inflow') AS n_in, count(*) FILTER (class = 'outflow') AS n_out
  FROM hits JOIN edges USING (edge) GROUP BY 1),
arcs AS (SELECT x.arc, x.length_m, south, north, west, (lat1 + lat2) / 2 AS lat, (lon1 + lon2) / 2 AS lon,
  coalesce(n, 0) AS n, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out
  FROM extent x JOIN edges e ON e.edge = x.mid LEFT JOIN tally t ON t.arc = x.arc)"""


@query(
    "ring_crossings_per_arc",
    trips_sql(
        f"""{ARCS_SQL} SELECT arc, round(lat, 9) AS lat, round(lon, 9) AS lon, round(length_m, 6) AS length_m, n, n_in, n_out,
  round(n / (length_m / 1000), 6) AS per_km, round(100.0 * n / sum(n) OVER (), 6) AS share_pct FROM arcs"""
    ),
)
def ring_crossings_per_arc(spark, sf):
    arcs = region.crossings_per_arc(region.crossings(classed(spark, sf), RING), region.edge_table(spark, RING))
    arcs = arcs.select("arc", "lat", "lon", "length_m", "n", "n_in", "n_out", "per_km", "share_pct")
    return rounded(rounded(arcs, "lat", "lon", digits=9), "length_m", "per_km", "share_pct")


# Sides of the L: mostly above or below these lines.
NORTH_OF, SOUTH_OF, EAST_OF = _corner(65, 0)[0], _corner(40, 0)[0], _corner(0, 60)[1]


@query(
    "ring_crossings_per_side",
    trips_sql(
        f"""{ARCS_SQL}, sided AS (SELECT CASE WHEN south > '{NORTH_OF!r}'::DOUBLE THEN 'north' WHEN north < '{SOUTH_OF!r}'::DOUBLE THEN 'south'
  WHEN west > '{EAST_OF!r}'::DOUBLE THEN 'east' ELSE 'west' END AS side, CAST(sum(n) AS BIGINT) AS crossings, sum(length_m) AS length_m FROM arcs GROUP BY 1)
SELECT side, crossings, round(length_m, 6) AS length_m, round(100.0 * crossings / sum(crossings) OVER (), 6) AS share_pct,
  round(100.0 * length_m / sum(length_m) OVER (), 6) AS length_pct FROM sided"""
    ),
)
def ring_crossings_per_side(spark, sf):
    arcs = region.crossings_per_arc(region.crossings(classed(spark, sf), RING), region.edge_table(spark, RING))
    sides = region.crossings_per_side(arcs, NORTH_OF, SOUTH_OF, EAST_OF)
    return rounded(sides, "length_m", "share_pct", "length_pct")


@query(
    "ring_trip_shape",
    trips_sql(
        f"""{CLASS_SQL} SELECT class, count(*) AS n, round(avg(duration_min), 6) AS mean_duration_min, round(avg(km), 6) AS mean_crowfly_km,
  round(quantile_cont(duration_min, 0.5), 6) AS median_duration_min, round(quantile_cont(km, 0.5), 6) AS median_crowfly_km
FROM (SELECT *, {sql_haversine('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS km FROM classed WHERE class <> 'external') GROUP BY 1"""
    ),
)
def ring_trip_shape(spark, sf):
    moved = region.classify(add_movement(placed(spark, sf)), RING)
    out = region.trip_shape(moved, ["duration_min", "crowfly_km"])
    return rounded(out, "mean_duration_min", "mean_crowfly_km", "median_duration_min", "median_crowfly_km")


# ---- a boundary traced from the data: extent of the starts in the first column of blocks per row ----

SCAN_LON = """by_lon AS (SELECT round(lon, 3) AS lon, min(round(lat, 3)) AS min_lat, max(round(lat, 3)) AS max_lat
  FROM (SELECT start_lat AS lat, start_lon AS lon FROM trips) GROUP BY 1)"""
SCAN_LAT = """by_lat AS (SELECT round(lat, 3) AS lat, min(round(lon, 3)) AS min_lon, max(round(lon, 3)) AS max_lon
  FROM (SELECT start_lat AS lat, start_lon AS lon FROM trips) GROUP BY 1)"""


def scanlines(spark, sf):
    starts = placed(spark, sf).select(F.round("start_lat", 3).alias("lat"), F.round("start_lon", 3).alias("lon"))
    by_lon = starts.groupBy("lon").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))
    by_lat = starts.groupBy("lat").agg(F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return by_lon, by_lat


@query(
    "ring_area_from_scanlines",
    trips_sql(
        f"""{SCAN_LON}, v AS (SELECT 0 AS part, lon AS along, min_lat AS lat, lon FROM by_lon UNION ALL SELECT 1, -lon, max_lat, lon FROM by_lon),
p AS (SELECT row_number() OVER (ORDER BY part, along) AS position, lat, lon FROM v),
e AS (SELECT a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM p a JOIN p b ON b.position = a.position % (SELECT count(*) FROM p) + 1)
SELECT count(*) AS vertices, round(abs(sum((radians(x2) - radians(x1)) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6371.0088 * 6371.0088 / 2, 6) AS area_km2 FROM e"""
    ),
)
def ring_area_from_scanlines(spark, sf):
    by_lon, _ = scanlines(spark, sf)
    return rounded(region.ring_area_km2(region.scanline_ring(by_lon)), "area_km2")


@query(
    "ring_scanline_agreement",
    trips_sql(
        f"""{SCAN_LON}, {SCAN_LAT},
a AS (SELECT DISTINCT round(min_lat + n * 0.001e0, 6) AS lat, round(lon, 6) AS lon FROM by_lon, range(2000) AS r(n) WHERE n <= round((max_lat - min_lat) / 0.001e0)),
b AS (SELECT DISTINCT round(lat, 6) AS lat, round(min_lon + n * 0.001e0, 6) AS lon FROM by_lat, range(2000) AS r(n) WHERE n <= round((max_lon - min_lon) / 0.001e0))
SELECT (SELECT count(*) FROM a) AS from_lon, (SELECT count(*) FROM b) AS from_lat,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_lon,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_lat"""
    ),
)
def ring_scanline_agreement(spark, sf):
    by_lon, by_lat = scanlines(spark, sf)
    totals = region.compare_scanlines(by_lon, by_lat, 0.001)
    return totals.withColumns({c: F.col(c).cast("long") for c in totals.columns})
