"""Prefix trie of conversations, built by the recursion of van Emde Boas layouts, as rounds of joins and aggregations.

A trie of height 2**m is cut at half its depth: an upper trie of height 2**(m-1), and below each of its deepest nodes a forest
of the same height. Every round halves all tries at once, so a trie of height h takes log2(h) rounds and not h.

* Blocks: turn codes (128 bits of role and text) are combined in pairs to codes of runs of 2, 4, 8, ... turns.
* Cut: a conversation that reaches a cut is at the cut prefix given by the node its forest hangs on and its code of the run from there to the cut. Prefixes are
  named by their smallest conversation; with the depth that name is the node. The upper part stays in its forest, the lower part
  goes to the forest of the cut node.
* Graft: rounds upwards. The total of a lower forest is the sum over its top nodes; each forest's total is added to all nodes above it in the upper
  trie, up to the top of that trie, so that a node has the sum over its part of the next larger trie.

No step holds a conversation or the members of a node in one row or task; turns are numbered by ranges, with offsets for conversations
that lie in several. Only the digest of the conversations that end at one node is a stream in one task, since SHA-256 is one chain; it gets them as
joined runs and holds one at a time.

Defined results: rows with a null conversation id belong to no conversation and are left out; a null turn comes first; equal turns of one conversation are
ordered by role, the text's first 64 characters and a hash of the text; null roles and texts are empty; repeated rows are turns of their own. No conversations, no
nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tripweave.session import write_through


def ordered(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), code (of role and text) and chars (code points of the text) of each row, written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    code = F.unhex(F.md5(F.concat(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.length(text).cast("bigint").alias("chars"), code.alias("code"),
        F.substring(text, 1, 64).alias("head"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "head", "code"]
    count = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id())
    ranged = write_through(ranged.select("conv", "turn", "role", "head", "code", "chars", "part"))
    # A range's turns of one conversation, and how many turns it has in the ranges before.
    pieces = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("own"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("conv", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "code")
    placed = ranged.withColumn("place", F.row_number().over(inside)).join(pieces, ["conv", "part"])
    return write_through(placed.select("conv", (F.col("place") + F.col("before")).cast("bigint").alias("pos"), "code", "chars"))


def spliced(turns: DataFrame, donor: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation c of ordered() rows rebuilt: the first `taken` turns (at most `most`) of conversation `donor` (all if it has
    fewer, none if there is none), then c's own turns after its first `taken`. donor and taken are expressions of the column conv.
    Returns rows (conv, pos, code, chars) and (conv, length), which has conversations without turns too."""
    lengths = write_through(turns.groupBy("conv").agg(F.max("pos").alias("own")))
    plan = lengths.select("conv", "own", donor.alias("donor"), taken.cast("bigint").alias("taken"))
    given = lengths.select(F.col("conv").alias("donor"), F.col("own").alias("has"))
    plan = plan.join(given, "donor", "left").withColumn("got", F.least("taken", F.coalesce("has", F.lit(0))))
    plan = write_through(plan.select("conv", "own", "donor", "taken", "got"))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv").alias("donor"), "pos", "code", "chars")
    front = plan.join(heads, "donor").where("pos <= got").select("conv", "pos", "code", "chars")
    back = turns.join(plan.select("conv", "taken", "got"), "conv").where("pos > taken").select("conv", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "code", "chars")
    lengths = plan.select("conv", (F.col("got") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("length"))
    return write_through(front.unionByName(back)), write_through(lengths)


def _runs(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """For i = 0, 1, ...: codes of whole runs of 2**i turns, (conv, start, code) with the number of turns before the run."""
    runs = [turns.select("conv", (F.col("pos") - 1).alias("start"), "code")]
    for i in range(rounds - 1):
        whole = F.col("start") - F.col("start") % (2 << i)
        left = F.when(F.col("start") == F.col("whole"), F.col("code"))
        right = F.when(F.col("start") != F.col("whole"), F.col("code"))
        halves = runs[-1].withColumn("whole", whole).groupBy("conv", "whole").agg(F.max(left).alias("left"), F.max(right).alias("right"))
        joined = halves.where("left IS NOT NULL AND right IS NOT NULL").select("conv", F.col("whole").alias("start"), F.unhex(F.md5(F.concat("left", "right"))).alias("code"))
        runs.append(write_through(joined))
    return runs


def _paths(turns: DataFrame, lengths: DataFrame, rounds: int, root: int) -> DataFrame:
    """(conv, depth, name) for each depth of each conversation from 0: its node there."""
    named = lengths.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("name"))
    runs = _runs(turns, rounds)
    for i in reversed(range(rounds)):
        # All depths that are named are multiples of twice the step: the tops of the tries that are cut now.
        cut = named.join(runs[i].withColumnRenamed("start", "depth"), ["conv", "depth"])
        cut = write_through(cut.select("conv", (F.col("depth") + (1 << i)).alias("depth"), F.col("name").alias("forest"), "code"))
        # Written, so that its size is known and a prefix of very many conversations does not share a shuffle with the join.
        prefixes = write_through(cut.groupBy("depth", "forest", "code").agg(F.min("conv").alias("name")))
        named = named.unionByName(write_through(cut.join(prefixes, ["depth", "forest", "code"]).select("conv", "depth", "name")))
    return named


def _grafted(nodes: DataFrame, path: DataFrame, rounds: int) -> DataFrame:
    """depth, name, parent and the sums of leaves and saved over each node's subtree."""
    for i in range(rounds):
        step = 1 << i
        tops = nodes.where((F.col("depth") - 1) % (2 * step) == step)
        forests = tops.groupBy((F.col("depth") - 1).alias("cut"), F.col("parent").alias("conv")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        forests = forests.withColumn("upper", F.expr(f"(cut - 1) div {step}"))
        # The nodes above a cut node, itself included: the path of the conversation that names it, within the upper trie.
        above = path.where((F.col("depth") > 0) & ((F.col("depth") - 1) % (2 * step) < step)).withColumn("upper", F.expr(f"(depth - 1) div {step}"))
        added = above.join(forests, ["conv", "upper"]).select("depth", "name", F.lit(None).cast("bigint").alias("parent"), "leaves", "saved")
        nodes = write_through(nodes.unionByName(added).groupBy("depth", "name").agg(F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    return nodes


def _joined(batches):
    """Sorted rows (depth, name, conv) to runs (depth, name, first, ids): the ids of one node within a batch, joined by commas."""
    for batch in batches:
        depth, name, conv = (c.to_numpy() for c in batch.columns)
        change = [0, *[int(i) + 1 for i in ((depth[1:] != depth[:-1]) | (name[1:] != name[:-1])).nonzero()[0]], len(conv)]
        begin = change[:-1] if len(conv) else []
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(begin, change[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin, pa.int64())), batch.column(1).take(pa.array(begin, pa.int64())), batch.column(2).take(pa.array(begin, pa.int64())), pa.array(ids, pa.string())], names=["depth", "name", "first", "ids"])


def _hashed(batches):
    """Sorted runs to one digest for each node."""
    node, digest = None, None
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            own = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
            if own == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = own, hashlib.sha256()
            digest.update(batch.column(3)[row].as_py().encode())
        yield _digests(out)
    if node is not None:
        yield _digests([(*node, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("depth", "name", "ends_sha256"), r)) for r in rows], schema=pa.schema([("depth", pa.int64()), ("name", pa.int64()), ("ends_sha256", pa.string())]))


def ends(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, name and ends_sha256 of the nodes at which a conversation ends: SHA-256 of those conversations' ids in decimal, ascending, joined by commas."""
    count = int(path.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = lengths.select("conv", F.col("length").alias("depth")).join(path, ["conv", "depth"]).select("depth", "name", "conv")
    runs = last.repartitionByRange(count, "depth", "name", "conv").sortWithinPartitions("depth", "name", "conv").mapInArrow(_joined, "depth bigint, name bigint, first bigint, ids string")
    return runs.repartition(count, "depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(_hashed, "depth bigint, name bigint, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns has (conv, pos, code, chars) with pos from 1 without gaps, lengths (conv, length) for all conversations, turnless ones
    included; both written tables.
    """
    most, root, count = lengths.agg(F.max("length"), F.min("conv"), F.count(F.lit(1))).first()
    rounds = (most or 0).bit_length()
    path = _paths(turns, lengths, rounds, root) if count else lengths.select("conv", F.col("length").alias("depth"), F.col("conv").alias("name"))
    members = path.where("depth > 0").groupBy("depth", "name").agg(F.count(F.lit(1)).alias("n_convs"))
    own = path.where("depth > 0 AND conv = name")
    own = own.join(turns.select("conv", F.col("pos").alias("depth"), "chars"), ["conv", "depth"]).join(path.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent")), ["conv", "depth"])
    known = write_through(own.select("depth", "name", "chars", "parent").join(members, ["depth", "name"]))
    children = known.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = write_through(known.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = nodes.select("depth", "name", "parent", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = _grafted(values, path, rounds).select("depth", "name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    below = nodes.select("depth", "name", "parent", "n_convs", "n_children").join(totals, ["depth", "name"])
    if not count:
        top = below.limit(0)
    else:
        first = below.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
        top = first.select(F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("name"), F.lit(None).cast("bigint").alias("parent"), F.lit(count).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    found = below.unionByName(top).join(ends(path, lengths), ["depth", "name"], "left")
    return found.select(F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
