"""Joins of a large table to a dimension whose size is checked before it is broadcast."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.session import write_through

# A dimension of at most so many bytes is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with at least this share of the large side is hot; at most 1/share keys can be.
HOT_SHARE = 0.001
# Hot rows are dealt out by the partition they come from, to at most so many shuffle keys for each hot key.
SPREAD = 997


def byte_size(dim: DataFrame) -> int:
    """Rows times width: eight bytes a column and eight a row, and the length of texts; one distributed pass."""
    texts = [f.name for f in dim.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    length = reduce(lambda x, y: x + y, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], F.lit(0))
    found = dim.agg(F.count("*").alias("rows"), F.sum(length).alias("text")).first()
    return found["rows"] * 8 * (1 + len(dim.columns)) + (found["text"] or 0)


def is_small(dim: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the dimension has at most `limit` bytes."""
    return byte_size(dim) <= limit


def lookup(
    large: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_BYTES, small: bool | None = None
) -> DataFrame:
    """Join a large table to a dimension that is unique on `keys`, "left" or "inner".

    A dimension within `limit` bytes is broadcast and the large side is not shuffled. A bigger one is shuffled, see
    split_hot_join. `small` passes on the answer of an earlier check of the same dimension.
    """
    if is_small(dim, limit) if small is None else small:
        return large.join(F.broadcast(dim), keys, how)
    return split_hot_join(large, dim, keys, how)


def hot_keys(large: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least `share` of the rows: never more than 1/share of them. The table is read once."""
    counts = write_through(large.groupBy(*keys).count())
    return counts.where(F.col("count") >= share * counts.agg(F.sum("count")).scalar()).select(*keys)


def split_hot_join(
    large: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", share: float = HOT_SHARE
) -> DataFrame:
    """Join by shuffle, but for hot keys, whose few dimension rows are broadcast.

    The large side is read twice: to count its keys and to be joined. Rows with a hot or a NULL key have nothing to find in
    the shuffle; they get a second key there that spreads them over the tasks.
    """
    hot = F.broadcast(hot_keys(large, keys, share))
    values = [c for c in dim.columns if c not in keys]
    row = F.struct(F.lit(True).alias("_hit"), *values)
    few = F.broadcast(dim.join(hot, keys, "left_semi").select(*keys, row.alias("_few")))
    tagged = large.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left").join(few, keys, "left")
    apart = F.col("_hot").isNotNull() | reduce(or_, [F.col(k).isNull() for k in keys])
    tagged = tagged.withColumn("_apart", F.when(apart, 1 + F.spark_partition_id() % SPREAD).otherwise(0))
    rest = dim.select(*keys, F.lit(0).alias("_apart"), row.alias("_rest"))
    joined = tagged.join(rest, [*keys, "_apart"], "left").withColumn("_found", F.coalesce("_few", "_rest"))
    if how == "inner":
        joined = joined.where("_found IS NOT NULL")
    return joined.select(*large.columns, *[F.col(f"_found.{c}").alias(c) for c in values])


def member_of(large: DataFrame, column: str, members: DataFrame, flag: str) -> DataFrame:
    """Add a boolean: is `column` one of the ids in the one-column frame `members`?"""
    key = members.columns[0]
    ids = members.select(F.col(key).alias(column)).distinct().withColumn(flag, F.lit(True))
    return lookup(large, ids, [column]).withColumn(flag, F.coalesce(flag, F.lit(False)))
