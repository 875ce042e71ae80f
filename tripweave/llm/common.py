"""Joins by checked size and connected components, shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.session import write_through

#: A written side of a few fixed-width columns is broadcast up to this size, with so many bytes for each row of Spark's hash table.
#: Beyond it both sides are shuffled, and adaptive execution splits skewed keys.
BROADCAST_BYTES, ROW_BYTES = 96 << 20, 96
#: Bits of the filter that keeps rows from being shuffled for keys that cannot meet: 4 MB, whatever the number of keys.
FILTER_BITS = 25


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table of fixed-width columns for broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() * ROW_BYTES <= limit else table


def meeting(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows join keys on a column of 64-bit hashes; keys is a written table with one row a key. Where keys is too large to be broadcast, rows
    first pass a bit table of the keys, so that of those that meet nothing few are shuffled."""
    marked = sized(keys)
    if marked is not keys:
        return rows.join(marked, key)
    words = 1 << (FILTER_BITS - 6)
    places = [F.shiftright(F.col(key), shift) for shift in (0, 20, 40)]  # three bits a key, from different parts of it
    bits = keys.select(F.explode(F.array(*[F.pmod(p, F.lit(1 << FILTER_BITS)) for p in places])).alias("slot"))
    bits = bits.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "word").join(F.broadcast(bits), "word", "left")
    table = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("words"))
    table = write_through(table.select(F.col("words.bits").alias("words")))
    passed = F.lit(True)
    for place in places:
        at = (F.pmod(F.shiftright(place, 6), F.lit(words)) + 1).cast("int")
        passed &= F.getbit(F.element_at(table.scalar(), at), F.pmod(place, F.lit(64)).cast("int")) == 1
    return rows.where(passed).join(keys, key)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage now: Spark's cleaner deletes the shuffle files of frames that are gone only after
    that, and a large reduction's files would lie beside those of the next one until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give freed memory of a worker back to the system: workers outlive their tasks, and idle ones would keep it from the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function over batches that gives memory back at its end."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given by two columns of longs, by alternating stars.

    Every round hangs each node's larger neighbours, then its smaller ones, on its smallest neighbour, until only stars
    are left. Minima are partial aggregates, and their join back is a join of two shuffled inputs whose hot nodes adaptive
    execution can split. Returns (node, root), one row for each node that is not its own root; the root is the smallest
    node. Self-loops and nulls are ignored; no edges give no rows.
    """
    a, b = edges.columns
    links = write_through(
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_through(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")))
        large = write_through(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        )
        roots = write_through(large.groupBy("u").agg(F.min("v").alias("least")))
        moved = large.join(roots, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = write_through(moved.unionByName(roots.withColumnRenamed("least", "v")).distinct())
        last, mark = mark, _mark(links)
        if mark == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """What changes whenever the set of links changes (but for collisions of 64-bit sums)."""
    found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(found)
