"""Queries over peak-hour hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.catalog.base import query, raw_trips, rounded, sql_encode, sql_lat, sql_lon, trips_sql
from tripweave.catalog.cleaning import raw_sql
from tripweave.catalog.exploration import timed
from tripweave.catalog.geometry import RING, sql_inside
from tripweave.operators import hotspots
from tripweave.operators.annotate import add_times
from tripweave.operators.qc import parse
from tripweave.session import write_through

N = 10

PEAK_SQL = f"""wk AS (SELECT * FROM trips WHERE NOT is_weekend), nd AS (SELECT count(DISTINCT date) AS weekdays FROM wk),
pe AS (SELECT s_i AS i, s_j AS j, hour, 1 AS d FROM wk UNION ALL SELECT e_i, e_j, hour, 0 FROM wk),
pc AS (SELECT i, j, {sql_encode('i', 'j')} AS cell, any_value(weekdays) AS weekdays, {sql_inside('i', 'j')} AS in_region,
  count(*) FILTER (d = 1 AND hour IN (7, 8, 9)) AS dep_am, count(*) FILTER (d = 0 AND hour IN (7, 8, 9)) AS arr_am,
  count(*) FILTER (d = 1 AND hour IN (17, 18, 19)) AS dep_pm, count(*) FILTER (d = 0 AND hour IN (17, 18, 19)) AS arr_pm
  FROM pe, nd GROUP BY i, j),
pr AS (SELECT 'am' AS peak, cell, i, j, in_region, weekdays, dep_am AS dep, arr_am AS arr, arr_am - dep_am AS net FROM pc
  UNION ALL SELECT 'pm', cell, i, j, in_region, weekdays, dep_pm, arr_pm, arr_pm - dep_pm FROM pc),
inr AS (SELECT * FROM pr WHERE in_region),
bl AS (SELECT c.peak, c.cell, c.i, c.j, any_value(c.weekdays) AS weekdays, any_value(c.net) AS centre_net, CAST(sum(m.dep) AS BIGINT) AS block_dep,
  CAST(sum(m.arr) AS BIGINT) AS block_arr, CAST(sum(m.net) AS BIGINT) AS block_net, count(*) AS n_active_cells,
  arg_min(m.cell, (m.net, m.cell)) AS most_draining, min(m.net) AS most_draining_net,
  arg_min(m.cell, (-m.net, m.cell)) AS most_filling, max(m.net) AS most_filling_net
  FROM inr c JOIN inr m ON m.peak = c.peak AND abs(m.i - c.i) <= 1 AND abs(m.j - c.j) <= 1 GROUP BY 1, 2, 3, 4)"""


def peak_cells(spark, sf):
    return write_through(hotspots.peak_cells(timed(spark, sf), RING))


@query(
    "peak_cells",
    trips_sql(
        f"""{PEAK_SQL} SELECT cell, weekdays, in_region, round({sql_lat('i')}, 9) AS lat, round({sql_lon('j')}, 9) AS lon, dep_am, arr_am, dep_pm, arr_pm,
  dep_am + arr_am AS gross_am, dep_pm + arr_pm AS gross_pm, arr_am - dep_am AS net_am, arr_pm - dep_pm AS net_pm,
  round(dep_am / weekdays, 6) AS dep_am_day, round(arr_am / weekdays, 6) AS arr_am_day, round((arr_am - dep_am) / weekdays, 6) AS net_am_day,
  round(dep_pm / weekdays, 6) AS dep_pm_day, round(arr_pm / weekdays, 6) AS arr_pm_day, round((arr_pm - dep_pm) / weekdays, 6) AS net_pm_day FROM pc"""
    ),
)
def q_peak_cells(spark, sf):
    cells = rounded(peak_cells(spark, sf).drop("i", "j"), "lat", "lon", digits=9)
    return rounded(cells, *[f"{m}_{p}_day" for m in ("dep", "arr", "net") for p in ("am", "pm")])


@query(
    "peak_input_violations",
    raw_sql("SELECT count(*) FILTER (broken0) AS bad_start, count(*) FILTER (broken1) AS bad_end, count(*) FILTER (t0 IS NULL) AS no_time FROM raw"),
)
def peak_input_violations(spark, sf):
    return hotspots.input_violations(add_times(parse(raw_trips(spark, sf))))


@query(
    "peak_blocks_3x3",
    trips_sql(
        f"{PEAK_SQL} SELECT peak, cell, centre_net, block_dep, block_arr, block_net, n_active_cells, most_draining, most_draining_net, most_filling, most_filling_net FROM bl"
    ),
)
def peak_blocks_3x3(spark, sf):
    blocks = hotspots.block_sums(hotspots.peak_rows(peak_cells(spark, sf).where("in_region")))
    return blocks.select(
        "peak", "cell", "centre_net", "block_dep", "block_arr", "block_net", "n_active_cells",
        "most_draining", "most_draining_net", "most_filling", "most_filling_net",
    )


@query(
    "peak_service_totals",
    trips_sql(
        f"""{PEAK_SQL} SELECT peak, round(sum(greatest(net, 0)) / any_value(weekdays), 6) AS net_in_day,
  round(sum(greatest(-net, 0)) / any_value(weekdays), 6) AS net_out_day, round(sum(dep + arr) / any_value(weekdays), 6) AS gross_day,
  count(*) FILTER (net > 0) AS filling, count(*) FILTER (net < 0) AS draining, count(*) FILTER (net = 0) AS balanced FROM inr GROUP BY 1"""
    ),
)
def peak_service_totals(spark, sf):
    totals = hotspots.service_totals(hotspots.peak_rows(peak_cells(spark, sf).where("in_region")))
    return rounded(totals, "net_in_day", "net_out_day", "gross_day")


def _greedy_sql(source: str, value: str, n: int = N) -> str:
    """Walk the ranked candidates one by one, keeping the disjoint ones."""
    return f"""cand AS (SELECT peak, 'inflow' AS direction, cell, i, j, CAST({value} AS DOUBLE) AS score FROM {source}
  UNION ALL SELECT peak, 'outflow', cell, i, j, CAST(-{value} AS DOUBLE) FROM {source}),
placed AS (SELECT *, row_number() OVER (PARTITION BY peak, direction ORDER BY score DESC, cell) AS place FROM cand),
walk AS (SELECT peak, direction, place, [{{'i': i, 'j': j, 'cell': cell, 'score': score}}] AS picked FROM placed WHERE place = 1
  UNION ALL SELECT p.peak, p.direction, p.place, CASE WHEN len(list_filter(w.picked, lambda x: abs(x.i - p.i) <= 2 AND abs(x.j - p.j) <= 2)) = 0
    THEN list_append(w.picked, {{'i': p.i, 'j': p.j, 'cell': p.cell, 'score': p.score}}) ELSE w.picked END
  FROM walk w JOIN placed p ON p.peak = w.peak AND p.direction = w.direction AND p.place = w.place + 1 WHERE len(w.picked) < {n}),
done AS (SELECT peak, direction, arg_max(picked, place) AS picked FROM walk GROUP BY 1, 2),
picks AS (SELECT peak, direction, CAST(r AS INT) AS rank, picked[r].cell AS cell, picked[r].score AS score
  FROM (SELECT peak, direction, picked, unnest(range(1, len(picked) + 1)) AS r FROM done))"""


def recursive_sql(body: str) -> str:
    return trips_sql(body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("top_disjoint_cells", recursive_sql(f"{PEAK_SQL}, {_greedy_sql('pr', 'net')} SELECT peak, direction, rank, cell, score FROM picks"))
def top_disjoint_cells(spark, sf):
    rows = hotspots.ranked_directions(hotspots.peak_rows(peak_cells(spark, sf)), "net")
    return hotspots.disjoint_top(rows, N)


@query(
    "top_overlapping_cells",
    trips_sql(
        f"""{PEAK_SQL}, cand AS (SELECT peak, 'inflow' AS direction, cell, net AS score FROM pr UNION ALL SELECT peak, 'outflow', cell, -net FROM pr)
SELECT peak, direction, row_number() OVER (PARTITION BY peak, direction ORDER BY score DESC, cell) AS rank, cell, score FROM cand QUALIFY rank <= {N}"""
    ),
)
def top_overlapping_cells(spark, sf):
    from pyspark.sql import Window as W

    rows = hotspots.ranked_directions(hotspots.peak_rows(peak_cells(spark, sf)), "net")
    order = W.partitionBy("peak", "direction").orderBy(F.desc("score"), "cell")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= N)
    return ranked.select("peak", "direction", F.col("rank").cast("long").alias("rank"), "cell", "score")


@query("top_disjoint_blocks", recursive_sql(f"{PEAK_SQL}, {_greedy_sql('bl', 'block_net')} SELECT peak, direction, rank, cell, score FROM picks"))
def top_disjoint_blocks(spark, sf):
    blocks = hotspots.block_sums(hotspots.peak_rows(peak_cells(spark, sf).where("in_region")))
    return hotspots.require_full(hotspots.disjoint_top(hotspots.ranked_directions(blocks, "block_net"), N), N)


def _spots_sql(value: str) -> str:
    return f"""{PEAK_SQL}, {_greedy_sql('bl', value)},
tot AS (SELECT peak, sum(greatest(net, 0)) AS net_in, sum(greatest(-net, 0)) AS net_out, sum(dep + arr) AS gross FROM inr GROUP BY 1),
own AS (SELECT peak, direction, cell, row_number() OVER (PARTITION BY peak, direction ORDER BY s DESC, cell) AS single_rank
  FROM (SELECT peak, 'inflow' AS direction, cell, net AS s FROM inr UNION ALL SELECT peak, 'outflow', cell, -net FROM inr)),
spots AS (SELECT p.peak, p.direction, p.cell, single_rank, n_active_cells, weekdays, {sql_lat('i')} AS lat, {sql_lon('j')} AS lon,
  CASE WHEN p.direction = 'inflow' THEN most_filling ELSE most_draining END AS dominant_cell,
  CASE WHEN p.direction = 'inflow' THEN most_filling_net ELSE most_draining_net END AS dom, centre_net, block_dep, block_arr, block_net,
  CASE WHEN p.direction = 'inflow' THEN 100.0 * block_net / net_in ELSE -100.0 * block_net / net_out END AS share_net,
  100.0 * abs(block_net) / gross AS share_gross,
  row_number() OVER (PARTITION BY p.peak, p.direction ORDER BY CASE WHEN p.direction = 'inflow' THEN block_net ELSE -block_net END DESC, p.cell) AS rank
  FROM picks p JOIN bl ON bl.peak = p.peak AND bl.cell = p.cell JOIN own o ON o.peak = p.peak AND o.direction = p.direction AND o.cell = p.cell
  JOIN tot ON tot.peak = p.peak)"""


_SPOT_COLUMNS = """peak, direction, cell, round(lat, 9) AS lat, round(lon, 9) AS lon, single_rank, n_active_cells, dominant_cell,
  round(dom / weekdays, 6) AS dominant_net_day, round(centre_net / weekdays, 6) AS centre_net_day, round(block_dep / weekdays, 6) AS block_dep_day,
  round(block_arr / weekdays, 6) AS block_arr_day, round(block_net / weekdays, 6) AS block_net_day, block_net AS block_net_total,
  round(share_net, 6) AS share_net_pct, round(share_gross, 6) AS share_gross_pct, CAST(rank AS INT) AS rank"""


def _spots(spark, sf, rank_by):
    spots = rounded(hotspots.hotspots(peak_cells(spark, sf), N, rank_by), "lat", "lon", digits=9)
    return rounded(
        spots, "dominant_net_day", "centre_net_day", "block_dep_day", "block_arr_day", "block_net_day", "share_net_pct", "share_gross_pct"
    )


@query("hotspots_by_block", recursive_sql(f"{_spots_sql('block_net')} SELECT {_SPOT_COLUMNS} FROM spots"))
def hotspots_by_block(spark, sf):
    return _spots(spark, sf, "block")


@query("hotspots_by_cell", recursive_sql(f"{_spots_sql('centre_net')} SELECT {_SPOT_COLUMNS} FROM spots"))
def hotspots_by_cell(spark, sf):
    return _spots(spark, sf, "single")


@query(
    "hotspot_concentration",
    recursive_sql(
        f"""{_spots_sql('block_net')}, run AS (SELECT peak, direction, CAST(rank AS INT) AS rank, cell, block_net / weekdays AS block_net_day, abs(share_net) AS share_pct,
  sum(abs(share_net)) OVER (PARTITION BY peak, direction ORDER BY rank) AS cumulative_pct FROM spots)
SELECT peak, direction, rank, cell, round(block_net_day, 6) AS block_net_day, round(share_pct, 6) AS share_pct, round(cumulative_pct, 6) AS cumulative_pct,
  cumulative_pct > 10 AS exceeds, min(rank) FILTER (cumulative_pct > 10) OVER (PARTITION BY peak, direction) AS min_n_over FROM run"""
    ),
)
def hotspot_concentration(spark, sf):
    spots = hotspots.hotspots(peak_cells(spark, sf), N, "block")
    return rounded(hotspots.concentration(spots, 10.0), "block_net_day", "share_pct", "cumulative_pct")
