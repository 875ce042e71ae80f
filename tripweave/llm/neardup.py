"""Links between embeddings of one label whose cosine reaches a threshold, found with randomised-rotation binary codes.

* Codes: a unit vector (filled up with zeros to a power of two) is turned by several pseudo-random rotations (signs and
  Hadamard transforms, three rounds). The signs of the turned coordinates are its code; beside each rotation's part of the code stands its
  correction factor, the inner product of the turned vector with its own sign vector.
* Meeting: the code bits are cut into bands; vectors of one label that agree on all bits of a band share a key. A band has three bits more
  than the logarithm of the largest label's number of vectors, so a key is shared by chance an eighth of a time, and
  there are so many bands that a pair right at the threshold misses all of them with a probability of MISS.
* Bounds: the inner product of one vector's signs with the other, turned, divided by the correction factor, is an unbiased
  estimate of their cosine, and its error is known. The mean over the rotations, with CONFIDENCE standard errors as it would have at the threshold, decides
  which pairs go on. In a key shared by more than CROWD vectors each hangs on the smallest instead, so that no crowd is written out as pairs.
* Components of these hints are clusters: pairs that go on are in one. In a cluster the code of one rotation decides in the same way for
  each pair whether its cosine is computed from the vectors in double precision; that cosine alone makes a link. Large clusters
  are dealt out as pairs of chunks; a task returns the number of links of each vector and a spanning forest, never pairs.

Equal vectors of a label (a 128-bit hash of the components) are one class from the start, so copies cost one row each.

Links are always right; one in 1 / MISS of those right at the threshold may be missed, fewer above it. Defined results: a null label, a
null or empty vector, a vector of zeros or with a null or non-finite component links with nothing and is its own component; vectors of different lengths do not link. Rows with
equal or null ids are rows of their own; a null id is never the smallest unless a component has no other, and is kept if it is its component's.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tripweave.session import write_through

from .arrow_text import mix, numbered
from .common import connected, meeting as meet, sized

MISS = 1e-5
CONFIDENCE = 5.0
CROWD = 64
_SALT = numbered(4, 13)
_MATRICES: dict[tuple[int, int], np.ndarray] = {}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; rows have a power of two of columns."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def _spun(x: np.ndarray, number: int) -> np.ndarray:
    for turn in range(3):
        odd = numbered(x.shape[1], 100 + 3 * number + turn) >> np.uint64(63)
        x = hadamard(x * (1.0 - 2.0 * odd.astype(np.float64)))
    return x


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """The rows of x turned by rotation `number`: always the same one for a width."""
    width = x.shape[1]
    if width > 256:
        return _spun(x, number)
    if (width, number) not in _MATRICES:
        _MATRICES[width, number] = _spun(np.eye(width), number)
    return x @ _MATRICES[width, number]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in double precision; no row is all zeros."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def padded(vectors: np.ndarray) -> np.ndarray:
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def bands(vectors: int, threshold: float) -> tuple[int, int]:
    """Bits of a band, and the number of bands, for so many vectors of a label."""
    bits = min(60, max(8, math.ceil(math.log2(max(1, vectors))) + 3))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if agree == 1 else math.ceil(math.log(MISS) / math.log1p(-agree))


def codes(vectors: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """For unit rows: signs (True where the turned coordinate is not negative), rotations side by side, and the correction factors."""
    x = padded(vectors)
    turned = [rotated(x, r) for r in range(rotations)]
    return np.concatenate([t >= 0 for t in turned], axis=1), np.stack([np.abs(t).sum(axis=1) for t in turned], axis=1) / math.sqrt(x.shape[1])


def slack(factors: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """How far below the threshold the mean estimate of a pair at the threshold may be: CONFIDENCE standard errors. Pairs above it
    have smaller errors."""
    each = (1 - factors**2).clip(0) / factors**2 / max(1, width - 1)
    return CONFIDENCE * np.sqrt((1 - threshold**2) * each.sum(axis=1)) / factors.shape[1] + 1e-6


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of a list column and its rows, at most 2,048 at a time."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        for low in range(0, len(rows), 2048):
            yield int(width), rows[low : low + 2048]


def _codes(bits: int, count: int):
    def run(batches):
        for batch in batches:
            for width, rows in by_width(batch.column(2)):
                part = batch.take(pa.array(rows))
                whole = 1 << (width - 1).bit_length()
                signs, factors = codes(unit(_lists(part.column(2), width)), -(-bits * count // whole))
                cut = signs[:, : bits * count].reshape(len(rows), count, bits)
                with np.errstate(over="ignore"):
                    packed = (cut.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                    place = mix(part.column(1).to_numpy().view(np.uint64)[:, None] + numbered(count, 7)[None, :])
                    keys = mix(packed * _SALT[0] ^ place).view(np.int64)
                ends = pa.array(np.arange(len(rows) + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
                     pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary()), pa.array([x.tobytes() for x in factors.astype(np.float32)], pa.binary())],
                    names=["class", "group", "keys", "code", "factors"],
                )

    return run


def _possible(threshold: float):
    def run(batches):
        for batch in batches:
            for width, rows in by_width(batch.column(4)):
                part = batch.take(pa.array(rows))
                other = padded(unit(_lists(part.column(4), width)))
                factors = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in part.column(3)]).astype(np.float64)
                signs = np.unpackbits(np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(2)]), axis=1)
                total = np.zeros(len(rows))
                for r in range(factors.shape[1]):
                    own = signs[:, r * other.shape[1] : (r + 1) * other.shape[1]] * 2.0 - 1.0
                    total += np.einsum("ij,ij->i", own, rotated(other, r)) / (factors[:, r] * math.sqrt(other.shape[1]))
                good = total / factors.shape[1] >= threshold - slack(factors, other.shape[1], threshold)
                yield part.select([0, 1]).filter(pa.array(good))

    return run


def links(vectors: np.ndarray, threshold: float, left: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit row the later ones whose cosine reaches the threshold. With left, only pairs of one of the first left rows and one of the others.
    The code of one rotation decides which cosines are computed."""
    signs, factors = codes(vectors, 1)
    turned = rotated(padded(vectors), 0).astype(np.float32)
    least = threshold - slack(factors, turned.shape[1], threshold)
    scaled = ((signs * 2.0 - 1.0) / (factors * math.sqrt(turned.shape[1]))).astype(np.float32)
    until = len(vectors) if left is None else left
    step = max(1, (1 << 22) // max(1, len(vectors)))
    for low in range(0, until, step):
        begin = low + 1 if left is None else left
        estimates = scaled[low : min(until, low + step)] @ turned[begin:].T
        for i in range(low, min(until, low + step)):
            near = begin + np.flatnonzero(estimates[i - low] >= least[i])
            near = near[near > i]
            found = near[vectors[near] @ vectors[i] >= threshold]
            if len(found):
                yield i, found


def _compare(threshold: float):
    schema = pa.schema([("class", pa.int64()), ("n_links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """Rows (class, n_links, null) with the rows linked to, and (class, null, other) for a forest of the links."""
        table = table.sort_by([("side", "ascending"), ("class", "ascending")]).combine_chunks()
        names, copies, groups = (table[c].to_numpy() for c in ("class", "copies", "group"))
        side, lengths = table["side"].to_numpy(), pa.compute.list_value_length(table["vec"]).to_numpy()
        count, piece, forest = np.zeros(len(names), np.int64), np.arange(len(names)), []
        # One group and length, but where 64-bit keys of different labels collide.
        for group, length in set(zip(groups.tolist(), lengths.tolist())):
            own = np.flatnonzero((groups == group) & (lengths == length))
            vectors = unit(_lists(table["vec"].combine_chunks().take(pa.array(own)), length))
            left = int((side[own] == 0).sum()) if side[-1] else None
            for i, found in links(vectors, threshold, left):
                i, found = own[i], own[found]
                count[i] += copies[found].sum()
                count[found] += copies[i]
                for root in np.unique(piece[found]):
                    if root != piece[i]:
                        forest.append((i, found[np.flatnonzero(piece[found] == root)[0]]))
                        piece[piece == root] = piece[i]
        linked = np.flatnonzero(count)
        tree = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table(
            [
                pa.array(np.concatenate([names[linked], names[tree[:, 0]]])),
                pa.array([*count[linked].tolist(), *[None] * len(tree)], pa.int64()),
                pa.array([*[None] * len(linked), *names[tree[:, 1]].tolist()], pa.int64()),
            ],
            schema=schema,
        )

    return run


def components(vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of vectors: id, n_links (rows it links to), component_id (smallest id reachable by links, its own included)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    valid = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite & F.exists(vec_col, lambda x: x != 0)
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(valid, F.lit(False)).alias("valid"),
        F.xxhash64(label_col, F.size(vec_col)).alias("group"), F.xxhash64(F.lit(1), vec).alias("hash"), F.xxhash64(F.lit(2), vec).alias("again"), vec.alias("vec"))
    classes = write_through(
        rows.where("valid").groupBy("group", "hash", "again").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.first("vec").alias("vec"))
    )
    largest = classes.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    signed = write_through(
        classes.select("class", "group", "vec").mapInArrow(_codes(*bands(largest, threshold)), "class bigint, group bigint, keys array<bigint>, code binary, factors binary")
    )
    keyed = signed.select("class", F.explode("keys").alias("key"))
    shared = write_through(keyed.groupBy("key").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    meeting = write_through(meet(keyed, shared, "key"))
    few = meeting.where(F.col("members") <= CROWD).select("key", "class")
    pairs = few.join(few.select("key", F.col("class").alias("other")), "key").where("class < other").select("class", "other").distinct()
    coded = pairs.join(signed.select("class", "group", "code", "factors"), "class")
    known = classes.select(F.col("class").alias("other"), F.col("group").alias("other_group"), "vec")
    ready = coded.join(known, "other").where("group = other_group").select("class", "other", "code", "factors", "vec")
    near = ready.mapInArrow(_possible(threshold), "class bigint, other bigint")
    crowded = meeting.where((F.col("members") > CROWD) & (F.col("class") != F.col("least"))).select("class", F.col("least").alias("other")).distinct()
    clusters = connected(near.unionByName(crowded))
    members = clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    members = write_through(members.unionByName(members.select(F.col("cluster").alias("class"), "cluster").distinct()))

    # Chunks of a cluster of c classes: sqrt(c) / 8, so that pairs of chunks repeat a class that many times at most.
    chunks = members.groupBy("cluster").agg(F.ceil(F.sqrt(F.count(F.lit(1))) / 8).alias("chunks"))
    dealt = members.join(chunks, "cluster").withColumn("own", F.pmod(F.xxhash64("class"), "chunks"))
    dealt = dealt.withColumn("another", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    dealt = dealt.select("class", "cluster", F.least("own", "another").alias("a"), F.greatest("own", "another").alias("b"), (F.col("own") > F.col("another")).cast("int").alias("side"))
    full = dealt.join(classes.select("class", "group", "copies", "vec"), "class")
    compared = write_through(full.groupBy("cluster", "a", "b").applyInArrow(_compare(threshold), "class bigint, n_links bigint, other bigint"))

    roots = connected(compared.where("other IS NOT NULL").select("class", "other"))
    counts = compared.where("n_links IS NOT NULL").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    found = classes.select("group", "hash", "again", "class", "copies", "first_id").join(sized(write_through(counts)), "class", "left")
    found = found.join(sized(roots.select(F.col("node").alias("class"), "root")), "class", "left")
    found = write_through(found.withColumn("component", F.coalesce("root", "class")).drop("root"))
    several = write_through(found.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("together")).where("together > 1").drop("together"))
    # Classes of one row that link to nothing need no look-up: such rows are their own component.
    named = write_through(found.join(sized(several), "component").select("group", "hash", "again", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    flat = rows.select("id", "valid", "group", "hash", "again")
    met = flat.join(named.withColumn("valid", F.lit(True)).withColumn("met", F.lit(True)), ["valid", "group", "hash", "again"], "left")
    return met.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """components with id under its own name, and kept: whether the row has the smallest id of its component (null equals null)."""
    found = components(vectors, threshold, id_col=id_col, vec_col=vec_col, label_col=label_col)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
