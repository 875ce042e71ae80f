"""Embedding links against all pairs in double precision."""

import numpy as np
import pytest

from tripweave.llm import neardup


def plain(rows, threshold):
    """(id, vector, label) rows to (id, n_links, component_id, kept), pair by pair."""
    usable = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    near = [[] for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            if usable[i] and usable[j] and label == rows[j][2] and len(v) == len(rows[j][1]):
                x, y = np.array(v, float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def compared(spark, rows, threshold):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, class int, group int").repartition(4)
    exact = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]  # as float32 holds them
    assert sorted(map(key, map(tuple, neardup.keep_one(docs, threshold).collect()))) == sorted(map(key, plain(exact, threshold)))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1),
        (9, [1.0, inf], 1), (10, [nan, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, None, None), (2, [-1.0, 0.0], 1),
        (12, [1.0], 3), (13, [5.0], 3), (14, [-1.0], 3), (12, [1.0], 3), (0, [-0.0, 1.0], 1), (15, [0.0, 1.0], 1), (16, [1e30, 0.0], 1), (17, [1e-30, 0.0], 1),
    ]
    compared(spark, rows, 0.93)


@pytest.mark.parametrize("width", [3, 48, 64, 300])
def test_families_copies_and_a_crowd(spark, width):
    """Pairs of every cosine around the threshold, chains, exact copies and a family of more vectors than a crowd."""
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(size=width), i % 3) for i in range(200)]
    for i in range(60):
        base = rows[i][1]
        for _ in range(3):
            rows.append((1000 + len(rows), base + rng.normal(size=width) * np.linalg.norm(base) / np.sqrt(width) * rng.uniform(0, 0.6), i % 3))
    family = rng.normal(size=width)
    rows += [(5000 + i, family + rng.normal(size=width) * 0.3, 1) for i in range(150)]
    rows += [(8000 + i, rows[3][1], 0) for i in range(90)]
    compared(spark, [(i, v.astype(np.float32).tolist(), label) for i, v, label in rows], 0.93)


def test_empty_table(spark):
    assert neardup.keep_one(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), 0.93).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x = neardup.unit(rng.normal(size=(4000, 64)))
    y = neardup.unit(0.93 * x + np.sqrt(1 - 0.93**2) * neardup.unit(rng.normal(size=x.shape)))
    exact = (x * y).sum(axis=1)
    signs, factors = neardup.codes(x, 4)
    found = np.stack([((signs[:, 64 * r : 64 * r + 64] * 2.0 - 1) * neardup.rotated(y, r)).sum(axis=1) / (8 * factors[:, r]) for r in range(4)], axis=1)
    error = found.mean(axis=1) - exact
    assert abs(error.mean()) < 0.002
    bound = neardup.slack(factors, 64, 0.93)
    assert 0.7 < error.std() / (bound.mean() / neardup.CONFIDENCE) < 1.4 and (error > -bound).all()


def test_recall_at_the_threshold():
    """Pairs right at the threshold share a band as often as reckoned."""
    rng = np.random.default_rng(6)
    bits, count = neardup.bands(5000, 0.93)
    x = neardup.unit(rng.normal(size=(3000, 64)))
    off = rng.normal(size=x.shape)
    off = neardup.unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * off
    width = -(-bits * count // 64)
    same = (neardup.codes(x, width)[0] == neardup.codes(y, width)[0])[:, : bits * count].reshape(-1, count, bits).all(axis=2).any(axis=1)
    assert same.mean() >= 0.999
