"""N-gram Jaccard join by parity sketches.

A document's set holds the distinct hashes (64 bits) of its runs of n consecutive words; two documents link when
q * |A & B| >= p * |A | B|. The join is exact up to collisions of 64-bit hashes.

* Parity sketch: a token's hash picks a block, and the token flips its bits there, so a block holds the XOR of its
  tokens. A token on which two sets differ touches one block only: the number of blocks that differ is a lower bound of
  the symmetric difference, which for linked sets is at most (|A| + |B|) (q - p) / (q + p).
* Pigeonhole for each size band: sets whose smaller one lies in a band use the same blocks. A set bounds its difference from
  any set it links to there by its own d: what the largest partner allows in its own band, what its size and the band's last
  size allow in a lower one. At most d of its non-empty blocks differ from those of the other set, so of x non-empty blocks it
  shares x - d keys (band, block, XOR). It gives only the first d + slack of them, with one slack for all sets of the band: of
  two sets the one whose blocks end earlier shares all but d of them with the other, so that still holds with x counted up to
  there. A set with d non-empty blocks or fewer gives one key more, for the rest of its band, which any two such sets share.
* Keys meet in one shuffle, into which they go from the texts without being written before. A class that meets others in fewer keys of a band than it would share with one it links to
  leaves that band, so that a passage which very many documents share brings nothing together by itself; the slack of short
  sets is so large that a line in common does not reach it. Classes that share a key with at most CROWD classes are paired, if their sizes
    allow a link. A pair is dropped when it shares too few keys (unless one of them is crowded), and when the Hamming distance of its bit sketches (each token flips one bit; about a bit
  for each token), which is a lower bound of the symmetric difference too, is too large. In a crowded key, each class
  hangs on the smallest one instead, so that no crowd is written out as pairs.
* Components of these hints are independent clusters: no link leaves a cluster. In a cluster, finer sketches are compared
  and what passes is verified on the sets. Large clusters are dealt out as pairs of chunks, so no task holds more than two
  chunks. A task returns, for each class, the number of documents it links to and a spanning forest of the links: rows in
  proportion to its input, never pairs.

Equal sets are one class from the start (named by a 64-bit hash of the set), so copies cost one row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tripweave.session import write_through

from .arrow_text import SPACED, hashed_words, mix, numbered, shingles
from .common import connected, drop_shuffles, released, sized

#: A size band ends at so many times its start. Wider bands repeat fewer sets in two bands, but leave fewer tokens in a block.
BAND = 2
#: A task gives the keys of equal sets once, as far as it remembers so many classes.
SEEN = 1 << 16
#: Keys that a task holds before it hands them on.
KEYS_HELD = 1 << 17
#: Keys shared by more classes than this are not written out as pairs.
CROWD = 64
_SALT = numbered(4, 2)


def band_starts(upto: int) -> list[int]:
    """First sizes of the bands until one is beyond upto."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return starts


def blocks(d: int) -> int:
    """Blocks of a band whose linked sets differ in at most d tokens: so many more than d + 1 that sets with no more than d
    non-empty blocks are rare (three standard deviations for the smallest sets of a band at a similarity of 0.8)."""
    if d == 0:
        return 1
    if d < 4:
        return 64
    if d < 16:
        return 4 * (d + 1)
    return math.ceil((1.5 if d < 64 else 1.2 if d < 256 else 1.15 if d < 1024 else 1.12) * (d + 1))


def slack(d: int) -> int:
    """Keys that a set gives beyond its own d in a band whose linked sets differ in at most d tokens. Linked sets share as many,
    so more of them keep unlike sets apart; short sets need them most and give few keys."""
    return 2 + max(min(d, 8), d // 16)


def block_keys(tokens: np.ndarray, p: int, q: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, keys) for each band in which a set (sorted distinct 64-bit hashes) can meet a set it links to. Linked
    sets share at least the need of either in the band of the smaller one."""
    size = len(tokens)
    if not size:
        return []
    starts = band_starts(size)
    own = len(starts) - 2
    smallest = -(-size * p // q)  # of a set that links to this one
    out = []
    for band in range(own, -1, -1):
        top = starts[band + 1] - 1
        if top < smallest:
            break
        widest = top * (q - p) // p
        k = blocks(widest)
        d = size * (q - p) // p if band == own else min(widest, (top + size) * (q - p) // (q + p))
        block = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # rises with the token
        first = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
        parity = np.bitwise_xor.reduceat(tokens * _SALT[0], first)
        place = mix(block[first] + np.uint64(band << 40))
        # Of the two sets the one whose first `most` blocks end earlier shares all but its d of them with the other, within these.
        most = d + slack(widest)
        keys = mix(parity ^ place)[:most]
        if len(first) <= d:
            keys = np.append(keys, mix(np.array([band], np.uint64) + _SALT[1]))
        out.append((band, max(1, min(len(first), most) - d), keys))
    return out


def packed(size: int, band: int, need: int) -> int:
    """What goes with a key, as one long: 33 bits of size, 24 of need (a smaller need only keeps more), 6 of band."""
    return size << 30 | min(need, (1 << 24) - 1) << 6 | band


#: The columns of a packed long.
UNPACKED = ("shiftright(info, 30) AS size", "CAST(info & 63 AS int) AS band", "CAST(shiftright(info, 6) & 16777215 AS int) AS need")


def class_id(tokens: np.ndarray) -> int:
    total = np.array([np.add.reduce(mix(tokens ^ _SALT[2])), np.uint64(len(tokens))], np.uint64)
    return int(mix(mix(total[:1]) + total[1:]).view(np.int64)[0])


def token_sets(column, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, words, bounds, _, _ in hashed_words(column, SPACED):
        for i in range(last - first):
            yield np.unique(shingles(words[bounds[i] : bounds[i + 1]], n))


def _signatures(n: int):
    def run(batches):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            sizes, names, sketches = [], [], []
            for tokens in token_sets(batch.column(2), n):
                sizes.append(len(tokens))
                names.append(class_id(tokens) if len(tokens) else None)
                sketches.append(bit_sketches([tokens], 1)[0].tobytes() if len(tokens) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())],
                names=["row", "id", "size", "class", "sketch"],
            )

    return run


def _keys(n: int, p: int, q: int):
    """Rows (class, key, info) of the texts in the first column. A text gives hundreds of keys, so batches are cut by their number."""

    def batched(names, keys, infos):
        counts = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(names, np.int64), counts)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(infos, np.int64), counts))],
            names=["class", "key", "info"],
        )

    def run(batches):
        seen, names, keys, infos, held = set(), [], [], [], 0
        for batch in batches:
            for tokens in token_sets(batch.column(0), n):
                name = class_id(tokens) if len(tokens) else None
                if name is None or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                for band, need, found in block_keys(tokens, p, q):
                    names.append(name)
                    keys.append(found)
                    infos.append(packed(len(tokens), band, need))
                    held += len(found)
                if held >= KEYS_HELD:
                    yield batched(names, keys, infos)
                    names, keys, infos, held = [], [], [], 0
        if held:
            yield batched(names, keys, infos)

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            names, sets = [], []
            for tokens in token_sets(batch.column(0), n):
                names.append(class_id(tokens) if len(tokens) else None)
                sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["class", "tokens"])

    return run


def bit_sketches(sets: list[np.ndarray], per_token: int) -> np.ndarray:
    """One row of 64-bit words a set: every token flips one bit. Rows have the next power of two of bits from per_token for
    each token of the largest set, 64 at least."""
    bits = 64
    while bits < per_token * max(map(len, sets)):
        bits *= 2
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, tokens in zip(out, sets):
        at = mix(tokens ^ _SALT[3]) & np.uint64(bits - 1)
        odd = np.flatnonzero(np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint64)
        np.bitwise_or.at(row, (odd >> np.uint64(6)).astype(np.int64), np.uint64(1) << (odd & np.uint64(63)))
    return out


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the size of the other: bits that fall together are XORed,
    as if it had been made at that size."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near(p: int, q: int):
    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            far = np.array([distance(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column(3), batch.column(4))], np.int64)
            yield batch.select([0, 1]).filter(pa.array(far * (q + p) <= sizes * (q - p)))

    return run


def verified_links(sets: list[np.ndarray], p: int, q: int, left: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later ones it links to. With left, only links between the first left sets and the others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sketch = bit_sketches(sets, 2)
    step = max(1, (1 << 22) // sketch.shape[1])
    for i in range(len(sets) if left is None else left):
        begin, found = (i + 1 if left is None else left), []
        for low in range(begin, len(sets), step):
            other = sizes[low : low + step]
            far = np.bitwise_count(sketch[low : low + step] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            fits = (far * (q + p) <= (other + sizes[i]) * (q - p)) & (q * np.minimum(other, sizes[i]) >= p * np.maximum(other, sizes[i]))
            found.append(np.flatnonzero(fits) + low)
        near = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        for low in range(0, len(near), 256):
            some = near[low : low + 256]
            tokens = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], tokens), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][at] == tokens).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            linked = some[q * both >= p * (sizes[some] + sizes[i] - both)]
            if len(linked):
                yield i, linked


def _compare(p: int, q: int):
    schema = pa.schema([("class", pa.int64()), ("n_links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """Rows (class, n_links, null) with the documents linked to, and (class, null, other) for a forest of the links."""
        table = table.sort_by([("side", "ascending"), ("class", "ascending")])
        names, copies = table["class"].to_numpy(), table["copies"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["tokens"]]
        side = table["side"].to_numpy()
        left = int((side == 0).sum()) if side[-1] else None
        root, links, forest = np.arange(len(names)), np.zeros(len(names), np.int64), []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, others in verified_links(sets, p, q, left):
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for j in others:
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    forest.append((i, j))
        linked = np.flatnonzero(links)
        tree = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table(
            [
                pa.array(np.concatenate([names[linked], names[tree[:, 0]]])),
                pa.array([*links[linked].tolist(), *[None] * len(tree)], pa.int64()),
                pa.array([*[None] * len(linked), *names[tree[:, 1]].tolist()], pa.int64()),
            ],
            schema=schema,
        )

    return run


def shared_keys(few: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of classes whose sizes allow a link, with the keys they share in each band; `few` (key, class, size, band, need) is a written table.

    Equal keys are of one band. Both sides have the same columns under the same names, so that they are one shuffle, read twice.
    """
    fits = f"a.class < b.class AND {q} * least(a.size, b.size) >= {p} * greatest(a.size, b.size)"
    met = few.alias("a").join(few.alias("b"), F.expr(f"a.key = b.key AND a.band = b.band AND {fits}"))
    return met.groupBy(F.col("a.class").alias("class"), F.col("b.class").alias("other"), "a.band").agg(
        F.count(F.lit(1)).alias("shared"), F.max(F.greatest("a.need", "b.need")).alias("need"), F.max(F.col("a.size") + F.col("b.size")).alias("sizes")
    )


def met_keys(keyed: DataFrame) -> DataFrame:
    """key, class, size, band and need of the rows (class, key, info) whose key another class holds too, each once. One shuffle by
    key serves the search for such keys, the choice of their rows and the removal of repeats."""
    alike = W.partitionBy("key")
    held = keyed.withColumns({"least": F.min("class").over(alike), "most": F.max("class").over(alike)}).where("least < most")
    return held.groupBy("key", "class").agg(F.max("info").alias("info")).selectExpr("key", "class", *UNPACKED)


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """One row for each row of docs: row (its number in docs), id, n_shingles, n_links (rows it links to), component_id
    (smallest id reachable by links) and first_row (smallest row number of the component).

    docs must give the same rows in the same partitions whenever it is read, as a stored table does. A null or wordless
    text has an empty set, no links and its own id. Rows with equal or null ids are rows of their own; a null id is
    never the smallest unless a component has no other. Repeated rows are linked like other equal texts. Words are what
    white space of ASCII separates, with A-Z lowered; other columns are not read.
    """
    p, q = similarity
    if not 0 < p <= q:
        raise ValueError("similarity must be a fraction p / q, 0 < p <= q")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = write_through(rows.mapInArrow(released(_signatures(n)), f"row bigint, id {kind}, size bigint, class bigint, sketch binary"))

    # Keys go from the texts into their shuffle: written with the rows they would take as much room again.
    keyed = rows.select("text").mapInArrow(released(_keys(n, p, q)), "class bigint, key bigint, info bigint")
    meeting = write_through(met_keys(keyed))
    drop_shuffles(docs.sparkSession)
    own = W.partitionBy("class", "band")  # at most the keys that a set gives in a band
    enough = meeting.withColumns({"met": F.count(F.lit(1)).over(own), "needed": F.max("need").over(own)}).where("met >= needed")
    meeting = write_through(enough.drop("met", "needed"))
    crowds = write_through(meeting.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("smallest")).where(F.col("members") > CROWD).select("key", "smallest"))
    candidates = write_through(meeting.select("class").distinct())
    classes = write_through(
        signed.join(sized(candidates), "class").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.first("sketch").alias("sketch"))
    )
    few = meeting.join(sized(crowds), "key", "left_anti").select("key", "class", "size", "band", "need")
    shares = shared_keys(few, p, q)
    # Two classes that share a crowded key hang together anyway; of all others every shared key is counted here.
    pairs = shares.where("shared >= need").select("class", "other", "sizes").distinct()
    sketched = pairs.join(classes.select("class", "sketch"), "class").join(
        classes.select(F.col("class").alias("other"), F.col("sketch").alias("other_sketch")), "other"
    )
    near = sketched.select("class", "other", "sizes", "sketch", "other_sketch").mapInArrow(_near(p, q), "class bigint, other bigint")
    crowded = meeting.join(sized(crowds), "key").where("class != smallest").select("class", F.col("smallest").alias("other")).distinct()
    clusters = connected(near.unionByName(crowded))
    members = write_through(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).unionByName(
        clusters.select(F.col("root").alias("class"), F.col("root").alias("cluster")).distinct()))
    classes = write_through(classes.drop("sketch").join(members, "class"))
    texts = rows.join(sized(classes.select("row")), "row").select("text")
    drop_shuffles(docs.sparkSession)
    sets = texts.mapInArrow(released(_sets(n)), "class bigint, tokens binary")
    # Chunks of a cluster of c classes: sqrt(c) / 8, so that pairs of chunks repeat a class that many times at most.
    chunks = classes.groupBy("cluster").agg(F.ceil(F.sqrt(F.count(F.lit(1))) / 8).alias("chunks"))
    dealt = classes.join(chunks, "cluster").select("class", "cluster", "copies", "chunks", F.pmod(F.xxhash64("class"), F.col("chunks")).alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    dealt = dealt.select("class", "cluster", "copies", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    compared = write_through(
        dealt.join(sets, "class").groupBy("cluster", "a", "b").applyInArrow(_compare(p, q), "class bigint, n_links bigint, other bigint")
    )
    roots = connected(compared.where("other IS NOT NULL").select("class", "other"))
    counts = write_through(compared.where("n_links IS NOT NULL").groupBy("class").agg(F.sum("n_links").alias("n_links")))

    named = signed.select("row", "id", "size", "class")
    named = named.join(sized(classes.select("class", "copies")), "class", "left").join(sized(counts), "class", "left")
    named = named.join(sized(roots.select(F.col("node").alias("class"), "root")), "class", "left")
    named = write_through(named.select("row", "id", "size", "copies", "n_links", F.coalesce("root", "class").alias("component")))
    firsts = write_through(
        named.where("component IS NOT NULL").groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.min("row").alias("first_row")).where("rows > 1")
    )
    same = F.coalesce("copies", "rows", F.lit(1))  # a class outside the clusters is a component by itself
    return named.join(sized(firsts), "component", "left").select(
        "row",
        "id",
        F.col("size").alias("n_shingles"),
        (F.coalesce("n_links", F.lit(0)) + same - 1).alias("n_links"),
        F.when(F.col("rows") > 1, F.col("first_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("first_row", "row").alias("first_row"),
    )


def one_of_each(docs: DataFrame, *, text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of docs, all columns, without those whose component holds an earlier row."""
    found = components(docs.select(text_col).withColumn("id", F.lit(None).cast("bigint")), id_col="id", text_col=text_col, n=n, similarity=similarity)
    later = write_through(found.where("first_row < row").select(F.col("row").alias("later_row")))
    name = "row_"
    while name in docs.columns:
        name += "_"
    numbered_rows = docs.withColumn(name, F.monotonically_increasing_id())
    return numbered_rows.join(sized(later), numbered_rows[name] == later["later_row"], "left_anti").drop(name)
