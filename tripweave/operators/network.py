"""Groups and arcs as membership tables: reconciliation, rollups, descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.operators.joins import is_small


def membership(gp_cells: DataFrame, arc_cells: DataFrame) -> DataFrame:
    """One (kind, id, cell) row per member cell of every group and arc."""
    gp = gp_cells.select(F.lit("gp").alias("kind"), F.col("gp_id").cast("string").alias("id"), "cell")
    arc = arc_cells.select(F.lit("arc").alias("kind"), F.col("arc_id").cast("string").alias("id"), "cell")
    return gp.unionByName(arc).distinct()


def rollup(cells: DataFrame, members: DataFrame, values: list[str], arcs: DataFrame | None = None) -> DataFrame:
    """Sum cell values per entity, date and slot, with present and missing member cells.

    Presence is over the whole table, not per slot. A cell may serve several arcs, so arc totals
    overlap on purpose. The members are broadcast only after their size is checked. With `arcs`
    (arc_id, from_gp, to_gp) the rows of arcs say which groups they join; both are NULL for groups.
    Cells of which none is a member are refused: ids of another grid or network would sum to nothing.
    """
    known = members.select(F.col("cell").alias("block_id")).distinct()
    if not cells.select("block_id").join(known, "block_id", "left_semi").take(1):
        raise ValueError("no cell of the table is a member of any entity")
    members = F.broadcast(members) if is_small(members) else members
    present = cells.select(F.col("block_id").alias("cell")).distinct().withColumn("_here", F.lit(1))
    coverage = members.join(present, "cell", "left").groupBy("kind", "id").agg(
        F.count("_here").alias("n_cells"), F.count_if(F.col("_here").isNull()).alias("missing_cells")
    )
    joined = cells.withColumnRenamed("block_id", "cell").join(members, "cell")
    totals = joined.groupBy("kind", "id", "date", "slot").agg(*[F.sum(v).alias(f"{v}_total") for v in values])
    out = totals.join(coverage, ["kind", "id"])
    out = out.withColumns({f"{v}_per_cell": F.col(f"{v}_total") / F.greatest("n_cells", F.lit(1)) for v in values})
    if arcs is None:
        return out
    ends = arcs.select(F.lit("arc").alias("kind"), F.col("arc_id").cast("string").alias("id"), "from_gp", "to_gp").distinct()
    return out.join(F.broadcast(ends) if is_small(ends) else ends, ["kind", "id"], "left")


def with_actuals(rolled: DataFrame, panel: DataFrame, members: DataFrame, target: str) -> DataFrame:
    """Attach observed totals, built from the members of each row's own kind."""
    observed = rollup(panel, members, [target]).select("kind", "id", "date", "slot", F.col(f"{target}_total").alias("actual_total"))
    return rolled.join(observed, ["kind", "id", "date", "slot"], "left")


def describe_network(members: DataFrame) -> DataFrame:
    """Cells by kind, cells of one kind only, and how many arcs serve a cell on average.

    Every cell is reduced to its counts per kind once.
    """
    per_cell = members.groupBy("cell").agg(
        F.count_if(F.col("kind") == "gp").alias("gp"), F.count_if(F.col("kind") == "arc").alias("arc")
    )
    cells = per_cell.agg(
        F.count("*").alias("n_cells"),
        F.sum(F.col("gp") + F.col("arc")).alias("n_rows"),
        F.count_if(F.col("gp") > 0).alias("n_gp_cells"),
        F.count_if(F.col("arc") > 0).alias("n_arc_cells"),
        F.count_if(F.col("arc") == 0).alias("n_gp_only_cells"),
        F.count_if(F.col("gp") == 0).alias("n_arc_only_cells"),
        F.count_if(F.col("gp") + F.col("arc") > 1).alias("n_cells_multi_row"),
        F.try_divide(F.sum("arc"), F.count_if(F.col("arc") > 0)).alias("arc_multiplicity"),
    )
    ids = members.select("kind", "id").distinct()
    n_gps = ids.agg(F.count_if(F.col("kind") == "gp")).scalar()
    n_arcs = ids.agg(F.count_if(F.col("kind") == "arc")).scalar()
    return cells.withColumns({"n_gps": n_gps, "n_arcs": n_arcs})


def effective_multiplicity(cells: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """Entity totals against cell totals: how often a unit of volume is counted, per kind."""
    copies = members.groupBy("kind", F.col("cell").alias("block_id")).agg(F.count("*").alias("copies"))
    volume = cells.groupBy("block_id").agg(F.sum(value).alias("v"))
    return volume.join(copies, "block_id").groupBy("kind").agg(
        F.sum("v").alias("cell_total"),
        F.sum(F.col("v") * F.col("copies")).alias("entity_total"),
        F.try_divide(F.sum(F.col("v") * F.col("copies")), F.sum("v")).alias("multiplicity"),
    )


def attach_mapping(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells with their network role: (cell_id, geohash, ...) joined to (cell_id, type, gp_id, patch_id)."""
    return cells.join(mapping.select("cell_id", "type", "gp_id", "patch_id"), "cell_id")


def match_groups(other: DataFrame, own: DataFrame) -> DataFrame:
    """Map groups of another network onto ours by majority of shared cells.

    `other` has (gp_id, cell), `own` has (cell, gp). Equal votes go to the smaller name. A group that
    shares no cell stays itself as R<id>.
    """
    votes = other.join(own, "cell").groupBy("gp_id", "gp").agg(F.count("*").alias("votes"))
    # Few candidate groups per group: every window partition is the length of one ballot.
    ballot = W.partitionBy("gp_id")
    best = votes.withColumns(
        {
            "place": F.row_number().over(ballot.orderBy(F.desc("votes"), "gp")),
            "purity": F.col("votes") / F.sum("votes").over(ballot),
        }
    ).where("place = 1")
    everyone = other.select("gp_id").distinct()
    mapped = everyone.join(best.select("gp_id", "gp", "votes", "purity"), "gp_id", "left")
    return mapped.select(
        "gp_id",
        F.coalesce("gp", F.concat(F.lit("R"), F.col("gp_id").cast("string"))).alias("canonical"),
        F.col("gp").isNull().alias("standalone"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        "purity",
    )


def remap_arcs(arcs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Arcs between canonical groups, with what happens to each: kept, unmapped or self-loop."""
    names = mapping.select("gp_id", "canonical")
    out = arcs
    for side in ("from", "to"):
        renamed = names.select(F.col("gp_id").alias(f"{side}_gp"), F.col("canonical").alias(f"{side}_canonical"))
        out = out.join(renamed, f"{side}_gp", "left")
    fate = (
        F.when(F.col("from_canonical").isNull() | F.col("to_canonical").isNull(), "unmapped")
        .when(F.col("from_canonical") == F.col("to_canonical"), "self_loop")
        .otherwise("kept")
    )
    return out.withColumn("fate", fate)


def arc_service_cells(arcs: DataFrame, patches: DataFrame) -> DataFrame:
    """Distinct cells of every patch an arc lists: (arc_id, cell)."""
    listed = arcs.select("arc_id", F.explode("patch_ids").alias("patch_id"))
    return listed.join(patches, "patch_id").select("arc_id", "cell").distinct()


def membership_rows(members: DataFrame) -> DataFrame:
    """Row ids of the network file: the cell for a group, arc<id>:<cell> for an arc."""
    row_id = F.when(F.col("kind") == "gp", F.col("cell")).otherwise(F.concat(F.lit("arc"), F.col("id"), F.lit(":"), F.col("cell")))
    return members.withColumn("row_id", row_id)


def cell_universe(members: DataFrame) -> DataFrame:
    """Each cell once, with whether a group owns it and how many rows it has."""
    return members.groupBy("cell").agg(
        F.bool_or(F.col("kind") == "gp").alias("in_gp"), F.count("*").alias("rows")
    )


def containment(part: DataFrame, whole: DataFrame, key: str = "cell") -> DataFrame:
    """How many cells of `part` the universe holds, and how many it lacks."""
    known = whole.select(key).distinct().withColumn("_in", F.lit(True))
    tagged = part.select(key).distinct().join(known, key, "left")
    return tagged.agg(
        F.count("*").alias("cells"), F.count_if(F.col("_in")).alias("inside"), F.count_if(F.col("_in").isNull()).alias("outside")
    )


def check_contained(part: DataFrame, whole: DataFrame, key: str = "cell") -> None:
    """Refuse cells of `part` that `whole` lacks."""
    stray = part.select(key).join(whole.select(key), key, "left_anti").take(3)
    if stray:
        raise ValueError(f"cells outside the universe: {[r[key] for r in stray]}")
