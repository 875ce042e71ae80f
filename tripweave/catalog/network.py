"""Queries over groups, arcs, rollups and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.catalog.base import I0, J0, query, rounded, sql_workday, trips_sql
from tripweave.catalog.flows import OWN_SQL, ownership
from tripweave.catalog.panels import morning_panel, panel_sql
from tripweave.operators import flows, network, scoring
from tripweave.session import write_through
from tripweave.sources import network as network_source

PANEL = panel_sql(sql_workday("date"))

# Groups named G<row>_<column>; an arc joins horizontal neighbours and serves the cells of both.
NET_SQL = f"""{OWN_SQL}, gpc AS (SELECT gp AS gp_id, geohash AS cell FROM own WHERE gp <> 'UNASSIGNED'),
ids AS (SELECT DISTINCT gp_id, CAST(substr(gp_id, 2, 1) AS BIGINT) AS r, CAST(substr(gp_id, 4, 1) AS BIGINT) AS c FROM gpc),
arc AS (SELECT a.r * 10 + a.c AS arc_id, a.gp_id AS from_gp, b.gp_id AS to_gp FROM ids a JOIN ids b ON b.r = a.r AND b.c = a.c + 1),
arcc AS (SELECT arc_id, cell FROM arc JOIN gpc ON gp_id = from_gp UNION SELECT arc_id, cell FROM arc JOIN gpc ON gp_id = to_gp),
mem AS (SELECT 'gp' AS kind, gp_id AS id, cell FROM gpc UNION ALL SELECT 'arc', CAST(arc_id AS VARCHAR), cell FROM arcc)"""


def nested_network(spark, sf):
    """The network as one nested document per group and one per arc, as a file would hold them."""
    cells = flows.assigned(ownership(spark, sf)).select(F.col("gp").alias("gp_id"), F.col("geohash").alias("cell"))
    gps = cells.groupBy("gp_id").agg(F.collect_set("cell").alias("cells"))
    ids = gps.withColumns({"r": F.substring("gp_id", 2, 1).cast("long"), "c": F.substring("gp_id", 4, 1).cast("long")})
    right = ids.select(F.col("r"), (F.col("c") - 1).alias("c"), F.col("gp_id").alias("to_gp"), F.col("cells").alias("to_cells"))
    arcs = ids.join(right, ["r", "c"]).select(
        (F.col("r") * 10 + F.col("c")).alias("arc_id"), F.col("gp_id").alias("from_gp"), "to_gp", F.lit(0.0).alias("length_m"),
        F.array_union("cells", "to_cells").alias("service_cells"),
    )
    none_gp, none_arc = F.lit(None).cast(network_source.GP), F.lit(None).cast(network_source.ARC)
    left = gps.select(F.array(F.struct("gp_id", "cells")).alias("gps"), none_arc.alias("arcs"))
    return left.unionByName(arcs.select(none_gp.alias("gps"), F.array(F.struct(*arcs.columns)).alias("arcs")))


def members(spark, sf):
    gp_cells, _, arc_cells = network_source.explode_network(nested_network(spark, sf))
    return write_through(network.membership(gp_cells, arc_cells))


@query("network_membership", trips_sql(f"{NET_SQL} SELECT kind, id, cell, CASE kind WHEN 'gp' THEN cell ELSE 'arc' || id || ':' || cell END AS row_id FROM mem"))
def network_membership(spark, sf):
    return network.membership_rows(members(spark, sf))


@query(
    "network_ids_from_json",
    trips_sql(f"{OWN_SQL} SELECT DISTINCT geohash AS id FROM own"),
)
def network_ids_from_json(spark, sf):
    """Every accepted document shape, written from the ownership table and read back to ids."""
    own = ownership(spark, sf).withColumn("shape", F.pmod(F.xxhash64("geohash"), F.lit(4)))
    lists = own.groupBy("shape", "gp").agg(F.collect_list("geohash").alias("cells"))
    def doc(value):
        return F.to_json(value)

    group = F.array(F.struct(F.col("cells").alias("members")))
    value = (
        F.when(F.col("shape") == 0, doc(F.col("cells")))
        .when(F.col("shape") == 1, doc(group))
        .when(F.col("shape") == 2, doc(F.struct(F.array(F.struct(F.col("cells").alias("cells"))).alias("gps"))))
        .otherwise(doc(F.struct(F.col("cells").alias("cells"))))
    )
    return network_source.ids_from_json(lists.select(value.alias("value")))


@query(
    "network_describe",
    trips_sql(
        f"""{NET_SQL}, g AS (SELECT DISTINCT cell FROM gpc), a AS (SELECT DISTINCT cell FROM arcc)
SELECT (SELECT count(DISTINCT cell) FROM mem) AS n_cells, (SELECT count(*) FROM mem) AS n_rows, (SELECT count(*) FROM g) AS n_gp_cells, (SELECT count(*) FROM a) AS n_arc_cells,
  (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM a)) AS n_gp_only_cells, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM g)) AS n_arc_only_cells,
  (SELECT count(*) FROM (SELECT cell FROM mem GROUP BY 1 HAVING count(*) > 1)) AS n_cells_multi_row, round((SELECT count(*) FROM arcc) / (SELECT count(*) FROM a), 6) AS arc_multiplicity,
  (SELECT count(DISTINCT gp_id) FROM gpc) AS n_gps, (SELECT count(*) FROM arc) AS n_arcs"""
    ),
)
def network_describe(spark, sf):
    return rounded(network.describe_network(members(spark, sf)), "arc_multiplicity")


@query("network_universe", trips_sql(f"{NET_SQL} SELECT cell, bool_or(kind = 'gp') AS in_gp, count(*) AS rows FROM mem GROUP BY 1"))
def network_universe(spark, sf):
    return network.cell_universe(members(spark, sf))


@query(
    "network_panel_members",
    trips_sql(f"{PANEL}, {NET_SQL} SELECT DISTINCT cell AS id FROM mem WHERE kind = 'gp' AND cell IN (SELECT block_id FROM panel)"),
)
def network_panel_members(spark, sf):
    ids = members(spark, sf).where("kind = 'gp'").select(F.col("cell").alias("id")).distinct()
    return network_source.resolve_members(ids, morning_panel(spark, sf))


@query(
    "network_containment",
    trips_sql(
        f"""{PANEL}, {NET_SQL}, g AS (SELECT DISTINCT cell FROM gpc)
SELECT count(*) AS cells, count(*) FILTER (cell IN (SELECT block_id FROM panel)) AS inside, count(*) FILTER (cell NOT IN (SELECT block_id FROM panel)) AS outside FROM g"""
    ),
)
def network_containment(spark, sf):
    """Group cells against the units of the morning panel."""
    units = morning_panel(spark, sf).select(F.col("block_id").alias("cell"))
    return network.containment(members(spark, sf).where("kind = 'gp'"), units)


# Predictions: the mean of the same unit and slot over the days before the cut.
PRED_SQL = f"""{PANEL}, {NET_SQL}, pm AS (SELECT block_id, slot, avg(arrivals) AS pred FROM panel WHERE date < DATE '2024-01-22' GROUP BY 1, 2),
pp AS (SELECT p.block_id, p.date, p.slot, pred, CAST(arrivals AS DOUBLE) AS actual FROM panel p JOIN pm USING (block_id, slot) WHERE date >= DATE '2024-01-22'),
cov AS (SELECT kind, id, count(b) AS n_cells, count(*) - count(b) AS missing_cells FROM mem LEFT JOIN (SELECT DISTINCT block_id AS b FROM pp) ON b = cell GROUP BY 1, 2),
roll AS (SELECT kind, id, date, slot, sum(pred) AS pred_total, sum(actual) AS actual_total, any_value(n_cells) AS n_cells, any_value(missing_cells) AS missing_cells
  FROM pp JOIN mem ON cell = block_id JOIN cov USING (kind, id) GROUP BY 1, 2, 3, 4)"""


def predictions(spark, sf):
    df = write_through(morning_panel(spark, sf))
    means = df.where("date < date'2024-01-22'").groupBy("block_id", "slot").agg(F.avg("arrivals").alias("pred"))
    later = df.where("date >= date'2024-01-22'").join(means, ["block_id", "slot"])
    return write_through(later.select("block_id", "date", "slot", "pred", F.col("arrivals").cast("double").alias("actual")))


@query(
    "network_rollup",
    trips_sql(f"{PRED_SQL} SELECT kind, id, date, slot, from_gp, to_gp, round(pred_total, 6) AS pred_total, n_cells, missing_cells, round(pred_total / greatest(n_cells, 1), 6) AS pred_per_cell FROM roll LEFT JOIN arc ON kind = 'arc' AND id = CAST(arc_id AS VARCHAR)"),
)
def network_rollup(spark, sf):
    gp_cells, arcs, arc_cells = network_source.explode_network(nested_network(spark, sf))
    both = write_through(network.membership(gp_cells, arc_cells))
    out = network.rollup(predictions(spark, sf), both, ["pred"], arcs)
    return rounded(out, "pred_total", "pred_per_cell")


@query(
    "network_rollup_actuals",
    trips_sql(f"{PRED_SQL} SELECT kind, id, date, slot, round(pred_total, 6) AS pred_total, actual_total FROM roll"),
)
def network_rollup_actuals(spark, sf):
    preds, both = predictions(spark, sf), members(spark, sf)
    rolled = network.rollup(preds.drop("actual"), both, ["pred"])
    out = network.with_actuals(rolled, preds, both, "actual")
    return rounded(out.select("kind", "id", "date", "slot", "pred_total", "actual_total"), "pred_total")


@query(
    "network_multiplicity",
    trips_sql(
        f"""{PRED_SQL}, cp AS (SELECT kind, cell AS block_id, count(*) AS copies FROM mem GROUP BY 1, 2), v AS (SELECT block_id, sum(pred) AS v FROM pp GROUP BY 1)
SELECT kind, round(sum(v), 6) AS cell_total, round(sum(v * copies), 6) AS entity_total, round(sum(v * copies) / sum(v), 6) AS multiplicity FROM v JOIN cp USING (block_id) GROUP BY 1"""
    ),
)
def network_multiplicity(spark, sf):
    out = network.effective_multiplicity(predictions(spark, sf), members(spark, sf), "pred")
    return rounded(out, "cell_total", "entity_total", "multiplicity")


ENTITY_SQL = f"""{PRED_SQL}, ent AS (SELECT kind, id, date, sum(pred_total) AS pred, sum(actual_total) AS actual FROM roll GROUP BY 1, 2, 3),
em AS (SELECT kind, id, avg(s) AS m FROM (SELECT kind, id, date, sum(arrivals) AS s FROM panel JOIN mem ON cell = block_id WHERE date < DATE '2024-01-15' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_D = "2 * (CASE WHEN actual > 0 THEN actual * ln(actual / greatest({p}, 1e-9)) ELSE 0 END - (actual - greatest({p}, 1e-9)))"


@query(
    "entity_against_own_mean",
    trips_sql(
        f"""{ENTITY_SQL}, j AS (SELECT ent.*, m FROM ent JOIN em USING (kind, id))
SELECT kind, count(*) AS n, round(avg({_D.format(p='pred')}), 6) AS deviance, round(avg({_D.format(p='m')}), 6) AS deviance_mean,
  round(quantile_cont(CASE WHEN actual > 0 THEN abs(pred - actual) / actual END, 0.5), 6) AS median_ape,
  round(100 * (avg({_D.format(p='m')}) - avg({_D.format(p='pred')})) / avg({_D.format(p='m')}), 6) AS improvement_pct FROM j GROUP BY 1"""
    ),
)
def entity_against_own_mean(spark, sf):
    """Entity-days against the mean of the same entity's earlier days."""
    both = members(spark, sf)
    rolled = network.rollup(predictions(spark, sf), both, ["pred", "actual"])
    days = rolled.groupBy("kind", "id", "date").agg(F.sum("pred_total").alias("pred"), F.sum("actual_total").alias("actual"))
    past = morning_panel(spark, sf).where("date < date'2024-01-15'")
    totals = network.rollup(past, both, ["arrivals"]).groupBy("kind", "id", "date").agg(F.sum("arrivals_total").alias("s"))
    means = totals.groupBy("kind", "id").agg(F.avg("s").alias("mean"))
    out = scoring.against_entity_mean(days, means, ["kind", "id"])
    return rounded(out, "deviance", "deviance_mean", "median_ape", "improvement_pct")


@query(
    "entity_gap_shares",
    trips_sql(f"{ENTITY_SQL}, x AS (SELECT kind, id, sum(abs(pred - actual)) AS gap FROM ent GROUP BY 1, 2) SELECT kind, id, round(gap, 6) AS gap, round(100 * gap / sum(gap) OVER (), 6) AS share_pct FROM x"),
)
def entity_gap_shares(spark, sf):
    rolled = network.rollup(predictions(spark, sf), members(spark, sf), ["pred", "actual"])
    days = rolled.groupBy("kind", "id", "date").agg(F.sum("pred_total").alias("pred"), F.sum("actual_total").alias("actual"))
    return rounded(scoring.gap_shares(days, ["kind", "id"]), "gap", "share_pct")


# ---- reconciling a second network -------------------------------------------

# Other groups tile the lattice by 40; every fifth diagonal is a patch of size 16 instead.
OTHER_SQL = f"""{OWN_SQL}, oc AS (SELECT geohash AS cell, i, j, (i - {I0}) // 40 * 100 + (j - {J0}) // 40 AS region, (i - {I0}) // 16 * 1000 + (j - {J0}) // 16 AS patch_id,
  (i + 2 * j) % 5 = 0 AS is_patch FROM own),
og AS (SELECT region AS gp_id, cell FROM oc WHERE NOT is_patch), vt AS (SELECT gp_id, gp, count(*) AS votes FROM og JOIN own ON own.geohash = og.cell AND gp <> 'UNASSIGNED' GROUP BY 1, 2),
best AS (SELECT *, votes / sum(votes) OVER (PARTITION BY gp_id) AS purity, row_number() OVER (PARTITION BY gp_id ORDER BY votes DESC, gp) AS place FROM vt),
mp AS (SELECT o.gp_id, coalesce(gp, 'R' || CAST(o.gp_id AS VARCHAR)) AS canonical, gp IS NULL AS standalone, coalesce(votes, 0) AS votes, purity
  FROM (SELECT DISTINCT gp_id FROM og) o LEFT JOIN best b ON b.gp_id = o.gp_id AND place = 1),
oarc AS (SELECT DISTINCT region * 10 + 1 AS arc_id, region AS from_gp, region + 1 AS to_gp FROM oc WHERE is_patch),
opatch AS (SELECT DISTINCT region * 10 + 1 AS arc_id, patch_id FROM oc WHERE is_patch),
fate AS (SELECT a.*, f.canonical AS from_canonical, t.canonical AS to_canonical, CASE WHEN f.canonical IS NULL OR t.canonical IS NULL THEN 'unmapped' WHEN f.canonical = t.canonical THEN 'self_loop' ELSE 'kept' END AS fate
  FROM oarc a LEFT JOIN mp f ON f.gp_id = from_gp LEFT JOIN mp t ON t.gp_id = to_gp)"""


def other_cells(spark, sf):
    from tripweave.functions import geohash as gh

    c = gh.with_index(ownership(spark, sf).select("geohash"), {"c": "geohash"})
    c = c.withColumn("cell_id", F.col("c_i") * 2**20 + F.col("c_j"))
    di, dj = F.col("c_i") - I0, F.col("c_j") - J0
    patch = (F.col("c_i") + 2 * F.col("c_j")) % 5 == 0
    mapping = c.select(
        "cell_id",
        F.when(patch, "patch").otherwise("GP").alias("type"),
        (F.floor(di / 40) * 100 + F.floor(dj / 40)).alias("gp_id"),
        (F.floor(di / 16) * 1000 + F.floor(dj / 16)).alias("patch_id"),
    )
    joined = network.attach_mapping(c.select("cell_id", "geohash"), mapping)
    return joined.select(
        F.col("geohash").alias("cell"), F.col("gp_id").alias("region"), "patch_id", (F.col("type") == "patch").alias("is_patch")
    )


def other_mapping(spark, sf):
    other = other_cells(spark, sf).where(~F.col("is_patch")).select(F.col("region").alias("gp_id"), "cell")
    own = flows.assigned(ownership(spark, sf)).select(F.col("geohash").alias("cell"), "gp")
    return network.match_groups(other, own)


def other_arcs(spark, sf):
    patches = other_cells(spark, sf).where("is_patch")
    return patches.groupBy("region").agg(F.collect_set("patch_id").alias("patch_ids")).select(
        (F.col("region") * 10 + 1).alias("arc_id"), F.col("region").alias("from_gp"), (F.col("region") + 1).alias("to_gp"), "patch_ids"
    )


@query("reconcile_groups", trips_sql(f"{OTHER_SQL} SELECT gp_id, canonical, standalone, votes, round(purity, 6) AS purity FROM mp"))
def reconcile_groups(spark, sf):
    return rounded(other_mapping(spark, sf), "purity")


@query("reconcile_arcs", trips_sql(f"{OTHER_SQL} SELECT arc_id, from_gp, to_gp, from_canonical, to_canonical, fate FROM fate"))
def reconcile_arcs(spark, sf):
    return network.remap_arcs(other_arcs(spark, sf).drop("patch_ids"), other_mapping(spark, sf))


@query("reconcile_fates", trips_sql(f"{OTHER_SQL} SELECT fate, count(*) AS n FROM fate GROUP BY 1"))
def reconcile_fates(spark, sf):
    arcs = network.remap_arcs(other_arcs(spark, sf).drop("patch_ids"), other_mapping(spark, sf))
    return arcs.groupBy("fate").agg(F.count("*").alias("n"))


@query(
    "reconcile_service_cells",
    trips_sql(f"{OTHER_SQL} SELECT DISTINCT f.arc_id, cell FROM fate f JOIN opatch o USING (arc_id) JOIN oc ON oc.patch_id = o.patch_id AND is_patch WHERE fate = 'kept'"),
)
def reconcile_service_cells(spark, sf):
    arcs = network.remap_arcs(other_arcs(spark, sf), other_mapping(spark, sf)).where("fate = 'kept'")
    patches = other_cells(spark, sf).where("is_patch").select("patch_id", "cell")
    return network.arc_service_cells(arcs, patches)
