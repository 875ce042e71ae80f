"""Global order without a single-task window: ranks, running shares, exact quantiles, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.operators.joins import lookup
from tripweave.session import materialise


def running_totals(
    df: DataFrame, order: list[Column], totals: dict[str, Column], within: list[str] | None = None
) -> DataFrame:
    """Add inclusive running sums in a global order, optionally restarted per `within` group.

    The rows are range-partitioned on the order, written once (so that every use sees the same
    ranges), summed per range, and each range adds what precedes it. `order` must be a total order;
    then no value, however frequent, can fill one range.
    """
    within = within or []
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group_order = [F.col(c).asc() for c in within]
    ranged = df.repartitionByRange(partitions, *group_order, *order)
    ranged = ranged.select("*", *[v.cast("double" if _is_double(df, v) else "long").alias(f"_add_{n}") for n, v in totals.items()])
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()))

    per_range = ranged.groupBy(*within, "_range").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in totals])
    before = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *within, "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals]
    )
    # One row per range and group that touches it.
    joined = ranged.join(offsets if within else F.broadcast(offsets), [*within, "_range"])
    inside = W.partitionBy(*within, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = joined
    for n in totals:
        out = out.withColumn(n, F.col(f"_off_{n}") + F.sum(f"_add_{n}").over(inside))
    drop = ["_range"] + [f"{p}_{n}" for n in totals for p in ("_add", "_off")]
    return out.drop(*drop)


def _is_double(df: DataFrame, value: Column) -> bool:
    return df.select(value.alias("v")).schema["v"].dataType.typeName() in ("double", "float", "decimal")


def global_rank(df: DataFrame, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """Row number (from 1) in a global total order."""
    return running_totals(df, order, {name: F.lit(1)}, within)


def places(rows: DataFrame, picks: DataFrame, key: Column, name: str, most: int, within: list[str]) -> DataFrame:
    """Place (from 1) that each of a few picks takes among all rows of its group when they are ordered by `key`.

    Nothing is sorted and no row is shuffled: the keys of a group's picks, at most `most`, travel to the rows as one sorted
    array, a row adds one to the bucket between two picks that a binary search finds, and the running sums of the buckets are
    the places. `key` is an orderable expression over either frame, without equal values inside a group of rows. Rows whose
    group holds no pick are passed over. `picks` is read twice and must be a written table.
    """
    lists = picks.groupBy(*within).agg(F.sort_array(F.collect_set(key)).alias("_keys"))
    steps = F.array(*[F.lit(2**b) for b in reversed(range(most.bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        reached = (found + step <= F.size("_keys")) & (F.get("_keys", found + step - 1) <= F.col("_key"))
        return F.when(reached, found + step).otherwise(found)

    # At most `most` keys per group and one group per row of the result's groups.
    met = rows.select(*within, key.alias("_key")).join(F.broadcast(lists), within)
    bucket = F.aggregate(steps, F.lit(0), halve)
    counts = met.groupBy(*within, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    order = W.partitionBy(*within).orderBy(key)
    numbered = picks.withColumn("_index", F.row_number().over(order) - 1)
    before = F.broadcast(counts.groupBy(*within).agg(F.collect_list(F.struct("_bucket", "_n")).alias("_counts")))
    ahead = F.aggregate(F.filter("_counts", lambda c: c["_bucket"] <= F.col("_index")), F.lit(0).cast("long"), lambda total, c: total + c["_n"])
    joined = numbered.join(before, within, "left")
    return joined.withColumn(name, F.coalesce(ahead, F.lit(0)) + 1).drop("_index", "_counts")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], within: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of a column with any number of distinct values.

    Equal values are counted first, so a frequent value is one row; the counts are then ranked over
    ranges. For many small groups use the built-in `percentile` instead.
    """
    within = within or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, [F.col(value).asc()], {"_to": F.col("_n")}, within)
    # The last running total of a group is its size.
    sizes = ranked.groupBy(*within).agg(F.max("_to").alias("_size"))
    ranked = ranked.join(sizes, within) if within else ranked.withColumn("_size", sizes.scalar())
    first = F.col("_to") - F.col("_n")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < F.col("_to")), F.col(value)))

    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_size") - 1)
        picks += [
            at(F.floor(position)).cast("double").alias(f"_lo_{name}"),
            at(F.ceil(position)).cast("double").alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_f_{name}"),
        ]
    picked = ranked.groupBy(*within).agg(*picks)
    return picked.select(
        *within,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )


def count_values(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """Distinct values with the number of holders of each.

    For integer event counts the distinct values cannot exceed the square root of twice the number
    of events, so ordering them in one task stays small at any scale.
    """
    return df.groupBy(*(within or []), value).agg(F.count("*").alias("holders"))


def gini(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """Gini coefficient of non-negative holdings, whole numbers or not, with the holder count and the total.

    Holders with equal values share a run of ranks, so the rank sum of a run is closed-form. Integer counts have few distinct values,
    see count_values; other values may all differ, so their ranks come from sums over ranges and no task orders them all.
    """
    within = within or []
    values = count_values(df.where(F.col(value).isNotNull()), value, within)
    if _is_double(df, F.col(value)):
        runs = running_totals(values, [F.col(value).asc()], {"_to": F.col("holders")}, within)
    else:
        upto = F.sum("holders").over(W.partitionBy(*within).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
        runs = values.withColumn("_to", upto)
    rank_sum = F.col("holders") * (2 * F.col("_to") - F.col("holders") + 1) / 2.0
    sums = runs.groupBy(*within).agg(
        F.sum("holders").alias("holders"),
        F.sum(F.col(value) * F.col("holders")).alias("total"),
        F.sum(rank_sum * F.col(value)).alias("_weighted"),
    )
    n, total = F.col("holders"), F.col("total")
    return sums.select(
        *within,
        "holders",
        "total",
        F.try_divide(2.0 * F.col("_weighted") - (n + 1) * total, n * total).alias("gini"),
    )


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """Lorenz curve at its corners: cumulative share of holders and of the total, ascending.

    Between two corners all holders are equal, so the curve is a straight line there.
    """
    values = count_values(df, value)
    order = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    return values.select(
        value,
        "holders",
        (F.sum("holders").over(order) / F.sum("holders").over(everything)).alias("holder_share"),
        (F.sum(F.col(value) * F.col("holders")).over(order) / F.sum(F.col(value) * F.col("holders")).over(everything)).alias("total_share"),
    )


def holders_to_cover(df: DataFrame, value: str, target: float = 0.8) -> DataFrame:
    """How many of the largest holders reach `target` of the total.

    Inside a run of equal values the first holder that reaches the target is found by division.
    """
    values = count_values(df, value)
    order = W.orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    runs = values.select(
        value,
        "holders",
        F.coalesce(F.sum("holders").over(order), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.col(value) * F.col("holders")).over(order), F.lit(0)).alias("_sum_before"),
        F.sum(F.col(value) * F.col("holders")).over(W.partitionBy()).alias("_total"),
        F.sum("holders").over(W.partitionBy()).alias("_all"),
    )
    need = F.greatest(F.ceil((F.lit(target) * F.col("_total") - F.col("_sum_before")) / F.col(value)), F.lit(1))
    reached = F.when(need <= F.col("holders"), F.col("_before") + need)
    return runs.where(F.col(value) > 0).agg(F.min(reached).cast("long").alias("n_holders"), F.max("_all").alias("n_all"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of a total order; each task keeps n rows, never a full sort."""
    return df.orderBy(*order).limit(n)


def average_rank_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Spearman correlation with average ranks for ties.

    Each column is ranked through its own value counts, so ties are one row while they are ranked.
    """
    ranked = df.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    for column in (left, right):
        values = ranked.groupBy(column).agg(F.count("*").alias("_n"))
        places = running_totals(values, [F.col(column).asc()], {"_to": F.col("_n")})
        places = places.select(column, (F.col("_to") - (F.col("_n") - 1) / 2.0).alias(f"_rank_{column}"))
        # A common value may be most of the rows.
        ranked = lookup(ranked, places, [column], "inner")
    return ranked.agg(F.count("*").alias("n"), F.corr(f"_rank_{left}", f"_rank_{right}").alias("rho"))
