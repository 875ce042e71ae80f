"""Document fingerprints by consistent weighted sampling.

A text's terms are its runs of five consecutive words (all words where there are fewer), weighted by how often they occur.
For each of SAMPLES samples every term has a Gamma(2, 1) step r, a Gamma(2, 1) cost c and a uniform offset b. With weight
w the term's level is t = floor(ln w / r + b), its cost there c / exp(r (t - b) + r), and the sample is the term and level
of the least cost. Two texts agree in a sample with a probability equal to the generalised Jaccard similarity of their
weights, sum of minima over sum of maxima; the share of equal samples estimates it with a standard error of at most
0.5 / sqrt(SAMPLES).

Steps, costs and offsets are drawn once, in a table of 65,536 rows; a multiplicative hash of the term for each sample picks
its row, and terms on the same row are told apart by their own hash. So a sample costs one multiplication, one look-up and
one minimum for each term of weight 1, over whole slices of texts.

Defined results: equal texts have equal fingerprints; a null or wordless text has the empty fingerprint, whose likeness is
1 to another empty one and 0 to any other. A-Z is lowered, words are what white space of ASCII separates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from .arrow_text import SPACED, hashed_words, mix, numbered, shingles

SAMPLES = 128
SHINGLE = 5
_ROWS = 1 << 16
#: At most so many ranges of ids; more data makes the ranges longer (they are sorted with spilling).
RANGES = 4096


def _uniform(seed: int) -> np.ndarray:
    return (numbered(_ROWS, seed) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


_STEP = -np.log(_uniform(11) * _uniform(12))
_COST = -np.log(_uniform(13) * _uniform(14))
_OFFSET = _uniform(15)
_FACTOR = numbered(SAMPLES, 16) | np.uint64(1)


def _ordered(cost: np.ndarray) -> np.ndarray:
    """Positive floats as integers of the same order, in the upper half of 64 bits."""
    return cost.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)


_ONCE = _ordered(_COST * np.exp(_STEP * _OFFSET - _STEP))
_LOW = np.uint64(0xFFFFFFFF)


def sample_terms(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples (one row for each start) of groups of distinct terms; group i begins at starts[i] and none is empty."""
    out = np.empty((len(starts), SAMPLES), np.uint32)
    name = mix(terms) & _LOW
    heavy = np.flatnonzero(weights > 1)
    logs = np.log(weights[heavy])
    for k in range(SAMPLES):
        row = ((terms * _FACTOR[k]) >> np.uint64(48)).astype(np.int64)
        key = _ONCE[row] | name
        if len(heavy):
            at = row[heavy]
            level = np.floor(logs / _STEP[at] + _OFFSET[at])
            cost = _COST[at] * np.exp(-_STEP[at] * (level - _OFFSET[at]) - _STEP[at])
            own = (name[heavy] + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & _LOW
            key[heavy] = _ordered(cost) | own
        out[:, k] = np.minimum.reduceat(key, starts) & _LOW
    return out


def fingerprints(column: pa.Array) -> list[np.ndarray | None]:
    """The samples of each text, None for an empty set of terms."""
    out: list[np.ndarray | None] = []
    for first, last, words, bounds, _, _ in hashed_words(column, SPACED):
        terms, weights, starts, rows, size = [], [], [], [], 0
        out += [None] * (last - first)
        for i in range(last - first):
            if bounds[i + 1] > bounds[i]:
                distinct, count = np.unique(shingles(words[bounds[i] : bounds[i + 1]], SHINGLE), return_counts=True)
                rows.append(first + i)
                starts.append(size)
                terms.append(distinct)
                weights.append(count)
                size += len(distinct)
        if rows:
            for row, samples in zip(rows, sample_terms(np.concatenate(terms), np.concatenate(weights), np.array(starts))):
                out[row] = samples
    return out


def text_of(samples: np.ndarray | None) -> str:
    return "" if samples is None else samples.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and fingerprint (8 hexadecimal digits a sample), one row for each row of docs, without a shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(text_of, fingerprints(batch.column(1))), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in ranges of ascending id: part, id, text and tail, sorted within partitions so that each row's next row of
    the part is the next document. A part ends with the first document of the next part (tail true; of the first part,
    after the last). Ids are whole numbers; nulls come first, equal ids in the order of their texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    place = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    wanted = min(RANGES, max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.select(F.col("id").cast("double").alias("place")).approxQuantile("place", [k / wanted for k in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    bucketed = Bucketizer(splits=splits, inputCol="place", outputCol="part").transform(rows.withColumn("place", place))
    bucketed = bucketed.select(F.col("part").cast("int").alias("part"), "id", "text")
    # The first id of every part that has rows: one row a part.
    firsts = bucketed.groupBy("part").agg(F.min("id").alias("id"), F.bool_or(F.col("id").isNull()).alias("null_id")).orderBy("part").collect()
    ends = [(r.id if not r.null_id else None, firsts[k - 1].part) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(ends, "head bigint, end int")
    tails = bucketed.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).select(F.col("end").alias("part"), "id", "text", F.lit(True).alias("tail"))
    both = bucketed.select("part", "id", "text", F.lit(False).alias("tail")).unionByName(tails)
    return both.repartitionById(wanted, F.col("part")).sortWithinPartitions("part", "tail", F.col("id").asc_nulls_first(), "text")


def with_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half (rounded down) is replaced by as many characters
    from the start of the next document by id; after the last comes the first. A document alone is its own next."""
    schema = f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next row is still to come
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = fingerprints(part.column(2))
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), found))
                pairs = []
                for row in rows:
                    if held is not None and held[0] == row[0] and not held[3]:
                        pairs.append((held, row))
                    held = row
                if pairs:
                    yield _edited(pairs, id_col)

    return with_successor(docs, id_col, text_col).select("part", "id", "text", "tail").mapInArrow(run, schema)


def _edited(pairs: list[tuple], id_col: str) -> pa.RecordBatch:
    edited = [own[2][: len(own[2]) - len(own[2]) // 2] + after[2][: len(own[2]) // 2] for own, after in pairs]
    new = fingerprints(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_pydict(
        {
            id_col: pa.array([own[1] for own, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(own[2]) for own, _ in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
            "fingerprint": [text_of(own[4]) for own, _ in pairs],
            "edited_fingerprint": [text_of(x) for x in new],
            "near_edited": [likeness(own[4], x) for (own, _), x in zip(pairs, new)],
            "near_next": [likeness(own[4], after[4]) for own, after in pairs],
        }
    )
