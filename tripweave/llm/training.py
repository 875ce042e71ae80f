"""Bounded training samples taken by the executors, and scoring of whole tables with a broadcast model.

A sample holds at most so many rows of each label: those with the least hashes of id and text. Rows with the same id, text and
label count once, null texts not at all, so a label with any text has rows in it, and neither one id nor one text with very many rows
can fill it or come to the driver. It does not depend on the order or the partitions of the table; docs must give the same rows in the same
partitions whenever it is read, as a stored table does. Rows come to the driver as features (binary), never as texts, sorted so
that equal samples train equal models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tripweave.session import write_through

from .common import release


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def least(rows: DataFrame, per_label: int) -> DataFrame:
    """For each label the row numbers of its per_label least hashes, one a hash: rows has the columns label, hash (64 bits) and row."""
    order = W.partitionBy("label").orderBy("hash")
    once = rows.groupBy("label", "hash").agg(F.min("row").alias("row"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label).select("label", "hash", "row")


def sampled(rows: DataFrame, per_label: int) -> DataFrame:
    """least(rows, per_label). Few rows are shuffled for it: first only those below a share of the hashes that should hold four times the
    sample; labels for which that was too little are taken from all their rows. The counts are one row a label."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    place = F.col("hash").cast("double") / 2.0**64 + 0.5  # of all hashes, in ascending order
    share = {label: min(1.0, 4 * per_label / n) for label, n in counts.items()}

    def of(labels: list, below: bool) -> DataFrame:
        kept = F.lit(False)
        for label in labels:
            kept = kept | (F.col("label").eqNullSafe(F.lit(label)) & (place < share[label] if below and share[label] < 1 else F.lit(True)))
        return least(rows.where(kept), per_label)

    first = write_through(of(list(counts), True))
    found = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    short = [x for x in counts if share[x] < 1 and found.get(x, 0) < per_label]
    if not short:
        return first
    return write_through(first.where(~F.col("label").isin(short)).unionByName(of(short, False)))


def _with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in columns.items()], F.monotonically_increasing_id().alias("row"))


def given_rows(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, hold: tuple[int, int], per_label: int) -> DataFrame:
    """Columns label and text of a sample of the rows with a label and a text whose id is not held out."""
    rows = _with_row(docs, id=F.col(id_col), text=F.col(text_col), label=F.col(label_col))
    usable = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"), *hold))
    chosen = sampled(usable.select("label", F.xxhash64("id", "text").alias("hash"), "row"), per_label)
    return rows.drop("label").join(F.broadcast(chosen.select("row", "label")), "row").select("label", "text")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, hold: tuple[int, int], per_label: int) -> DataFrame:
    """Columns label and text of a sample of the pairs of a text and a label of its id, where the label is 0 or 1 and the id not held out. Ids
    are first drawn from the label table and broadcast (8 * per_label at most), so that texts are only looked up, not shuffled; if
    too few of them have a text, hashes of all texts meet all labels."""
    given = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    given = given.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"), *hold)).distinct()
    rows = _with_row(docs, id=F.col(id_col), text=F.col(text_col))
    texts = rows.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.xxhash64("id", "text").alias("hash"), "row")
    ids = given.select("label", F.xxhash64("id").alias("hash"), F.lit(0).cast("bigint").alias("row"), "id")
    drawn = least_ids(ids, 4 * per_label)
    chosen = write_through(least(texts.join(F.broadcast(drawn), "id").select("label", "hash", "row"), per_label))
    total = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    found = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if any(found.get(x, 0) < per_label and n > 4 * per_label for x, n in total.items()):
        once = texts.groupBy("id", "hash").agg(F.min("row").alias("row"))
        chosen = write_through(least(once.join(given, "id").select("label", "hash", "row"), per_label))
    return rows.join(F.broadcast(chosen.select("row", "label")), "row").select("label", "text")


def least_ids(ids: DataFrame, per_label: int) -> DataFrame:
    """The ids with the per_label least hashes of each of two labels."""
    order = W.partitionBy("label").orderBy("hash", "id")
    return ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label).select("id", "label")


def collect_counts(rows: DataFrame, features: Callable) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """Labels and (buckets, counts) of rows with the columns label and text."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = list(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
                names=["label", "buckets", "counts"],
            )

    got = sorted(rows.select("label", "text").mapInArrow(run, f"label {kind}, buckets binary, counts binary").collect(), key=lambda r: (r.label, bytes(r.buckets), bytes(r.counts)))
    return [r.label for r in got], [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in got]


def collect_terms(rows: DataFrame, features: Callable) -> tuple[list, list[np.ndarray]]:
    """Labels and terms (32 bits) of rows with the columns label and text."""
    labels, pairs = collect_counts(rows, lambda column: ((t.view(np.int32), t[:0].view(np.int32)) for t in features(column)))
    return labels, [b.view(np.uint32) for b, _ in pairs]


def score_texts(docs: DataFrame, score: Callable[[pa.Array], Iterable[tuple]], columns: dict[str, pa.DataType], ddl: str, *, id_col: str, text_col: str) -> DataFrame:
    """id_col and the columns that score returns for each text, one tuple a row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = list(zip(*score(batch.column(1)))) or [[] for _ in columns]
            arrays = [pa.array(list(x), t) for x, t in zip(found, columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *columns])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {ddl}")


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], *, text_col: str) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the predicate keeps. Only texts go to the workers, and one bit a row comes back. What
    becomes of a null or empty text is the predicate's to say; repeated rows go or stay together."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        try:
            parts = [keep(texts.slice(at, 1000)) for at in range(0, len(texts), 1000)]
            return pa.array(np.concatenate([np.zeros(0, bool), *parts]), pa.bool_())
        finally:
            release()

    return docs.where(kept(F.col(text_col)))
