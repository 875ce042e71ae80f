"""Peak-hour cells, 3 x 3 neighbourhoods and rankings of places that do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.functions import geohash as gh
from tripweave.functions import polygon
from tripweave.operators.cells import with_centre
from tripweave.operators.ranking import places
from tripweave.session import write_through

# Parts a group is cut into before its best candidates are brought together.
SLICES = 256

# Three-hour peaks.
PEAKS = {"am": (7, 8, 9), "pm": (17, 18, 19)}


def input_violations(trips: DataFrame) -> DataFrame:
    """Trips with a malformed cell at either end or without a time; one aggregation over the table."""
    return trips.agg(
        F.count_if(~gh.is_cell8(F.col("start_geohash"))).alias("bad_start"),
        F.count_if(~gh.is_cell8(F.col("end_geohash"))).alias("bad_end"),
        F.count_if(F.col("hour").isNull() | F.col("is_weekend").isNull()).alias("no_time"),
    )


def check_weekday_input(trips: DataFrame) -> None:
    """Refuse malformed cells or unknown hours."""
    found = {k: v for k, v in input_violations(trips).first().asDict().items() if v}
    if found:
        raise ValueError(f"trips that cannot be placed: {found}")


def peak_cells(trips: DataFrame, ring: polygon.Ring, peaks: dict[str, tuple[int, ...]] = PEAKS) -> DataFrame:
    """One row per cell active on any weekday hour, with departures, arrivals, gross and net per peak.

    net is arrivals minus departures (positive fills). Both ends go through one aggregation.
    """
    weekdays = trips.where(~F.col("is_weekend"))
    ends = F.array(
        F.struct(F.col("start_geohash").alias("cell"), F.lit(True).alias("dep")),
        F.struct(F.col("end_geohash").alias("cell"), F.lit(False).alias("dep")),
    )
    both = weekdays.select("hour", F.explode(ends).alias("e")).select("hour", "e.*")
    sums = []
    for peak, hours in peaks.items():
        at = F.col("hour").isin(*hours)
        sums += [F.count_if(at & F.col("dep")).alias(f"dep_{peak}"), F.count_if(at & ~F.col("dep")).alias(f"arr_{peak}")]
    days = weekdays.agg(F.count_distinct("date")).scalar()
    cells = both.groupBy("cell").agg(*sums).withColumn("weekdays", days)
    cells = gh.with_index(with_centre(cells, 8), {"c": "cell"}).withColumnsRenamed({"c_i": "i", "c_j": "j"})
    cells = cells.withColumn("in_region", polygon.inside(F.col("lat"), F.col("lon"), ring))
    for peak in peaks:
        dep, arr = F.col(f"dep_{peak}"), F.col(f"arr_{peak}")
        cells = cells.withColumns({f"gross_{peak}": dep + arr, f"net_{peak}": arr - dep})
        cells = cells.withColumns(
            {
                f"dep_{peak}_day": dep / F.col("weekdays"),
                f"arr_{peak}_day": arr / F.col("weekdays"),
                f"net_{peak}_day": (arr - dep) / F.col("weekdays"),
            }
        )
    return cells


def peak_rows(cells: DataFrame, peaks=PEAKS) -> DataFrame:
    """The same table with one row per (cell, peak)."""
    stacked = F.array(
        *[
            F.struct(
                F.lit(p).alias("peak"), F.col(f"dep_{p}").alias("dep"), F.col(f"arr_{p}").alias("arr"),
                F.col(f"gross_{p}").alias("gross"), F.col(f"net_{p}").alias("net"),
            )
            for p in peaks
        ]
    )
    return cells.select("cell", "i", "j", "lat", "lon", "in_region", "weekdays", F.inline(stacked))


def block_sums(rows: DataFrame) -> DataFrame:
    """3 x 3 sums around every active cell, per peak.

    Each cell is sent to the nine centres it belongs to and grouped there; centres that are not
    active cells are dropped. The spread is nine rows per cell, whatever the data.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = rows.select("peak", "cell", "i", "j", "lat", "lon", "weekdays", "dep", "arr", "net", F.explode(offsets).alias("o"))
    own = (F.col("o.a") == 0) & (F.col("o.b") == 0)
    member = F.struct("net", "cell")
    sums = sent.groupBy("peak", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j")).agg(
        F.max(F.when(own, F.col("cell"))).alias("cell"),
        F.max(F.when(own, F.col("net"))).alias("centre_net"),
        F.max(F.when(own, F.col("lat"))).alias("lat"),
        F.max(F.when(own, F.col("lon"))).alias("lon"),
        F.max("weekdays").alias("weekdays"),
        F.sum("dep").alias("block_dep"),
        F.sum("arr").alias("block_arr"),
        F.sum("net").alias("block_net"),
        F.count("*").alias("n_active_cells"),
        F.min(member).alias("_least"),
        # The largest net; among equals the lowest cell, which min() finds on the negated net.
        F.min(F.struct((-F.col("net")).alias("neg"), F.col("cell").alias("cell"))).alias("_most"),
    )
    return sums.where("cell is not null").select(
        "*", F.col("_least.cell").alias("most_draining"), F.col("_least.net").alias("most_draining_net"),
        F.col("_most.cell").alias("most_filling"), (-F.col("_most.neg")).alias("most_filling_net"),
    ).drop("_least", "_most")


def ranked_directions(rows: DataFrame, value: str) -> DataFrame:
    """Every row twice: as an inflow candidate and as an outflow candidate, score rising with rank."""
    both = F.array(
        F.struct(F.lit("inflow").alias("direction"), F.col(value).alias("score")),
        F.struct(F.lit("outflow").alias("direction"), (-F.col(value)).alias("score")),
    )
    return rows.select("*", F.inline(both))


def disjoint_top(candidates: DataFrame, n: int, reach: int = 2, groups=("peak", "direction")) -> DataFrame:
    """Greedy top n per group such that any two picks are more than `reach` rows or columns apart.

    A pick rules out only the (2 reach + 1)^2 lattice positions around it, so the n-th pick is among
    the first (n - 1)(2 reach + 1)^2 + 1 candidates. Only that many are kept, first per slice of a
    group (a group may hold most of the table), then per group; the greedy choice is one fold over
    this short array: no rounds, and exact.
    """
    enough = (n - 1) * (2 * reach + 1) ** 2 + 1

    def best(df: DataFrame, *parts) -> DataFrame:
        order = W.partitionBy(*parts).orderBy(F.desc("score"), "cell")
        return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= enough)

    slices = F.pmod(F.xxhash64("cell"), F.lit(SLICES))
    short = best(best(candidates.withColumn("_slice", slices), *groups, "_slice"), *groups)
    item = F.struct("_place", "score", "cell", "i", "j")
    lists = short.groupBy(*groups).agg(F.sort_array(F.collect_list(item)).alias("_list"))
    empty = F.array().cast("array<struct<_place:int,score:double,cell:string,i:bigint,j:bigint>>")

    def choose(picked: Column, c: Column) -> Column:
        clash = F.exists(picked, lambda p: (F.abs(p["i"] - c["i"]) <= reach) & (F.abs(p["j"] - c["j"]) <= reach))
        one = F.struct(
            c["_place"].alias("_place"), c["score"].cast("double").alias("score"), c["cell"].alias("cell"),
            c["i"].cast("long").alias("i"), c["j"].cast("long").alias("j"),
        )
        return F.when((F.size(picked) < n) & ~clash, F.array_append(picked, one)).otherwise(picked)

    picks = lists.select(*groups, F.posexplode(F.aggregate("_list", empty, choose)).alias("_p", "_c"))
    return picks.select(
        *groups, (F.col("_p") + 1).alias("rank"), F.col("_c.cell").alias("cell"), F.col("_c.score").alias("score")
    )


def require_full(picks: DataFrame, n: int, groups=("peak", "direction")) -> DataFrame:
    """Refuse a ranking in which a group found fewer than n disjoint places."""
    short = picks.groupBy(*groups).count().where(F.col("count") < n).take(1)
    if short:
        raise ValueError(f"fewer than {n} disjoint places for {short[0].asDict()}")
    return picks


def service_totals(rows: DataFrame) -> DataFrame:
    """Per peak: positive net, negative net, gross, and how many cells fill, drain or balance."""
    net, days = F.col("net"), F.max("weekdays")
    return rows.groupBy("peak").agg(
        (F.sum(F.greatest(net, F.lit(0))) / days).alias("net_in_day"),
        (F.sum(F.greatest(-net, F.lit(0))) / days).alias("net_out_day"),
        (F.sum("gross") / days).alias("gross_day"),
        F.count_if(net > 0).alias("filling"),
        F.count_if(net < 0).alias("draining"),
        F.count_if(net == 0).alias("balanced"),
    )


def hotspots(cells: DataFrame, n: int = 10, rank_by: str = "block") -> DataFrame:
    """Top disjoint places per peak and direction with their 3 x 3 sums and service-wide shares.

    rank_by="block" ranks the 3 x 3 net of every active cell, "single" the cell's own net. Only cells
    in the region take part; the final rank is by block net.
    """
    if rank_by not in ("single", "block"):
        raise ValueError(f"rank_by is single or block, not {rank_by!r}")
    rows = peak_rows(cells.where("in_region"))
    blocks = write_through(block_sums(rows))
    score = "block_net" if rank_by == "block" else "centre_net"
    picks = disjoint_top(ranked_directions(blocks, score), n).select("peak", "direction", "cell")
    # The picks are at most n rows per peak and direction.
    found = write_through(blocks.join(F.broadcast(picks), ["peak", "cell"]))
    signed_net = F.when(F.col("direction") == "inflow", -F.col("net")).otherwise(F.col("net"))
    table = places(
        ranked_directions(rows, "net"), found.withColumnRenamed("centre_net", "net"), F.struct(signed_net.alias("net"), F.col("cell").alias("cell")),
        "single_rank", n, ["peak", "direction"],
    ).withColumnRenamed("net", "centre_net")
    table = table.join(F.broadcast(service_totals(rows)), "peak")
    filling = F.col("direction") == "inflow"
    per_day = F.col("block_net") / F.col("weekdays")
    signed = F.when(filling, per_day).otherwise(-per_day)
    toward = F.when(filling, F.col("net_in_day")).otherwise(F.col("net_out_day"))
    ranked = table.select(
        "peak", "direction", "cell", "lat", "lon", "single_rank", "n_active_cells",
        F.when(filling, F.col("most_filling")).otherwise(F.col("most_draining")).alias("dominant_cell"),
        (F.when(filling, F.col("most_filling_net")).otherwise(F.col("most_draining_net")) / F.col("weekdays")).alias("dominant_net_day"),
        (F.col("centre_net") / F.col("weekdays")).alias("centre_net_day"),
        (F.col("block_dep") / F.col("weekdays")).alias("block_dep_day"),
        (F.col("block_arr") / F.col("weekdays")).alias("block_arr_day"),
        per_day.alias("block_net_day"),
        F.col("block_net").alias("block_net_total"),
        (100.0 * F.try_divide(signed, toward)).alias("share_net_pct"),
        (100.0 * F.try_divide(F.abs(per_day), F.col("gross_day"))).alias("share_gross_pct"),
        signed.alias("_signed"),
    )
    order = W.partitionBy("peak", "direction").orderBy(F.desc("_signed"), "cell")
    return ranked.withColumn("rank", F.row_number().over(order)).drop("_signed")


def concentration(spots: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Running share of the ranked places and the first rank above the threshold; n rows per group."""
    order = W.partitionBy("peak", "direction").orderBy("rank")
    share = F.abs("share_net_pct")
    running = spots.select(
        "peak", "direction", "rank", "cell", "block_net_day", F.abs("share_net_pct").alias("share_pct"),
        F.sum(share).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_pct"),
    )
    first = F.min(F.when(F.col("cumulative_pct") > threshold, F.col("rank")))
    return running.withColumns(
        {
            "exceeds": F.col("cumulative_pct") > threshold,
            "min_n_over": first.over(W.partitionBy("peak", "direction")),
        }
    )
