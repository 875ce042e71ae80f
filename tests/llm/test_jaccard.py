"""Links and components against all pairs, the parts' guarantees, and large groups."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tripweave.llm import jaccard
from tripweave.session import write_through


def by_hand(texts, n, p, q):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), k, find(i)) for i, (s, k) in enumerate(zip(sets, links))]


def found(spark, tmp_path, texts, n, p, q, **rest):
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, class string, row int").write.parquet(f"{tmp_path}/d")
    out = jaccard.components(spark.read.parquet(f"{tmp_path}/d"), n=n, similarity=(p, q), **rest).collect()
    return [(r.n_shingles, r.n_links, r.component_id) for r in sorted(out, key=lambda r: r.id)]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [rng.choice("ab") + str(rng.randrange(10**6))]
    return words


@pytest.mark.parametrize("n, p, q", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_groups_of_edited_copies(spark, tmp_path, n, p, q):
    rng = random.Random(n)
    texts = [None, "", " \t", "one", "one", "two words", "Two Words", "a b c d", "A b c d e"]
    for size in (6, 12, 25, 60, 150, 400):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        texts += [" ".join(edited(rng, base, rng.randrange(0, 1 + size // 12))) for _ in range(30)]
        texts += [" ".join(base)] * 3
    rng.shuffle(texts)
    assert found(spark, tmp_path, texts, n, p, q) == by_hand(texts, n, p, q)


def test_crowds_and_chunks(spark, tmp_path, monkeypatch):
    """A large family goes through crowded keys and through chunks."""
    monkeypatch.setattr(jaccard, "CROWD", 5)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(350)]
    assert found(spark, tmp_path, texts, 3, 90, 100) == by_hand(texts, 3, 90, 100)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for p, q in ((9, 10), (8, 10), (1, 2)):
        for _ in range(400):
            size = int(rng.integers(1, 300))
            a = rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64)
            drop, add = int(rng.integers(0, max(1, size // 5) + 1)), int(rng.integers(0, max(1, size // 8) + 1))
            b = np.concatenate([a[drop:], rng.integers(1, 2**63, add, dtype=np.int64).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and q * both >= p * (len(a) + len(b) - both):
                left, right = ({band: (need, keys) for band, need, keys in jaccard.block_keys(x, p, q)} for x in (a, b))
                band = min(max(left), max(right))  # of the smaller set
                (x, ours), (y, theirs) = left[band], right[band]
                assert len(np.intersect1d(ours, theirs)) >= max(x, y) >= 1


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(1, 2**40, int(rng.integers(1, 600))).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a))) :], rng.integers(1, 2**40, int(rng.integers(0, 900))).astype(np.uint64), a[:1]]))
        far = jaccard.distance(*(jaccard.bit_sketches([x], 1)[0].tobytes() for x in (a, b)))
        assert far <= len(np.setxor1d(a, b))


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "x y z"), (3, "a b c d"), (None, "q r s t"), (None, "q r s t")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = sorted((r.row, r.id, r.n_links, r.component_id) for r in jaccard.components(docs, n=3).collect())
    assert [g[1:] for g in got] == [(None, 3, 3), (None, 3, 3), (7, 3, 3), (7, 0, 7), (3, 3, 3), (None, 1, None), (None, 1, None)]
    assert jaccard.components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.components(docs, similarity=(3, 2))


def test_pairs_of_classes_take_one_shuffle_of_the_keys(spark, tmp_path):
    """Keys shared in each band as plain loops find them, with both sides of the join read from one exchange."""
    generator = random.Random(4)
    sizes = {c: generator.randint(8, 14) for c in range(60)}
    held = {(k, c): (k, c, sizes[c], k % 2, 1 + c % 3) for k in range(40) for c in generator.sample(range(60), 6)}
    schema = "key bigint, class bigint, size bigint, band int, need int"
    spark.createDataFrame(list(held.values()), schema).write.parquet(f"{tmp_path}/few")
    want = {}
    for k, a in held:
        for b in range(a + 1, 60):
            if (k, b) in held and 10 * min(sizes[a], sizes[b]) >= 8 * max(sizes[a], sizes[b]):
                want[a, b, k % 2] = want.get((a, b, k % 2), 0) + 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shares = jaccard.shared_keys(spark.read.parquet(f"{tmp_path}/few"), 8, 10)
        rows = shares.collect()
        plan = shares._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["class"], r.other, r.band): r.shared for r in rows} == want
    assert all(r.need == 1 + max(r["class"] % 3, r.other % 3) and r.sizes == sizes[r["class"]] + sizes[r.other] for r in rows)
    assert "ReusedExchange" in plan


def test_keys_go_into_one_shuffle_and_are_written_nowhere_else(spark, tmp_path, monkeypatch):
    """Of the keys, which are the largest part of the work, only those that classes share are written; the rows carry none."""
    written = []

    def kept(df):
        written.append(df)
        return write_through(df)

    monkeypatch.setattr(jaccard, "write_through", kept)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", *texts[2:4]]
    assert found(spark, tmp_path, texts, 5, 8, 10) == by_hand(texts, 5, 8, 10)
    assert [f.dataType.typeName() for df in written for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")] == []
    keys = next(df for df in written if {"key", "class"} <= set(df.columns))
    assert {r["class"] for r in keys.collect()} == {jaccard.class_id(t) for t in jaccard.token_sets(pa.array([texts[1], texts[1] + " more"]), 5)}
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.rindex("Initial Plan") :].count("Exchange") == 1 if "Initial Plan" in plan else plan.count("Exchange") == 1


def test_a_task_gives_the_keys_of_equal_sets_once():
    texts = ["a b c d e f g h", None, "A b c d e f  g h", "", "x y z", "a b c d e f g h"]
    once = [b for text in ("a b c d e f g h", "x y z") for b in jaccard._keys(3, 9, 10)([pa.record_batch([pa.array([text])], names=["text"])])]
    several = list(jaccard._keys(3, 9, 10)([pa.record_batch([pa.array(texts[:3])], names=["text"]), pa.record_batch([pa.array(texts[3:])], names=["text"])]))
    assert pa.Table.from_batches(several).to_pylist() == pa.Table.from_batches(once).to_pylist()


def test_a_line_in_common_brings_short_texts_together_in_no_band():
    """Two texts of 30 words with 10 of them in common share fewer keys than either would share with a text it links to."""
    rng = random.Random(8)
    line = [f"c{k}" for k in range(10)]
    together = 0
    for _ in range(200):
        pair = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(20)] + line) for _ in range(2)]
        left, right = ({band: (need, keys) for band, need, keys in jaccard.block_keys(t, 8, 10)} for t in jaccard.token_sets(pa.array(pair), 5))
        together += any(len(np.intersect1d(left[b][1], right[b][1])) >= max(left[b][0], right[b][0]) for b in left.keys() & right.keys())
    assert together == 0
