"""Fingerprints against generalised Jaccard similarity, and edited texts against the definition."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tripweave.llm import sampling


def weights(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for k in range(120):
        base = [f"w{rng.integers(50)}" for _ in range(int(rng.integers(40, 400)))]
        other = base[: int(len(base) * rng.uniform(0.2, 1))] + [f"v{rng.integers(50)}" for _ in range(int(rng.integers(1, 200)))]
        a, b = " ".join(base * (1 + k % 4)), " ".join(other * (1 + k % 3))
        x, y = sampling.fingerprints(pa.array([a, b]))
        errors.append(sampling.likeness(x, y) - similarity(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06 and np.abs(errors).max() < 0.17


def test_weights_count():
    x, y = sampling.fingerprints(pa.array(["a b c d e " * 1 + "f g h i j " * 9, "a b c d e " * 9 + "f g h i j " * 1]))
    assert sampling.likeness(x, y) == pytest.approx(similarity("a b c d e " + "f g h i j " * 9, "a b c d e " * 9 + "f g h i j "), abs=0.13)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (name, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sampling.fingerprints(pa.array([text, edited, after]))
        out.append((name, len(text), hashlib.sha256(edited.encode()).hexdigest(), sampling.text_of(a), sampling.text_of(b), sampling.likeness(a, b), sampling.likeness(a, c)))
    return sorted(out, key=repr)


def test_whole_table(spark, sf):
    from tripweave.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(r) for r in QUERIES["op7_weighted_sampling"](spark, sf).collect()]
    assert sorted(found, key=repr) == expected(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [(5, "b a"), (None, "null id"), (5, "b a"), (5, "b b é\U0001f600 x"), (3, None), (-4, ""), (9, "lo " * 50_000), (10, "  \n")],
        [(None, "x"), (None, None)],
        [(1, "only one here")],
        [],
    ],
)
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(a, b, 1, "t") for a, b in rows], "doc_id bigint, text string, part int, fingerprint string")
    found = [tuple(r) for r in sampling.with_edited(docs).collect()]
    assert sorted(found, key=repr) == expected(rows)
    plain = sampling.fingerprint(docs).collect()
    assert Counter(r.fingerprint for r in plain) == Counter(sampling.text_of(x) for x in sampling.fingerprints(pa.array([t for _, t in rows], pa.string())))
