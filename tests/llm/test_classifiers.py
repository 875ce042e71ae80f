"""Held-out accuracy of the three classifiers, their parts against plain sums, and odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tripweave.llm import arrow_text, language, quality, toxicity, training
from tripweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(frame, name, label):
    rows = [(r[name], r[label]) for r in frame.where(f"held_out AND {label} IS NOT NULL").collect()]
    return np.array([a for a, _ in rows]), np.array([b for _, b in rows])


def area(scores, labels):
    """Chance that a row with label 1 scores higher than one with label 0."""
    ones, zeros = scores[labels == 1], scores[labels == 0]
    return np.mean([(a > zeros).mean() + 0.5 * (a == zeros).mean() for a in ones])


@pytest.mark.parametrize("name, label, floor", [("op8_toxicity", "toxic", 0.85), ("op9_quality", "quality", 0.85)])
def test_held_out_labels(spark, name, label, floor):
    found = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == docs.count()
    scores, labels = held(found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id"), "score", label)
    assert len(labels) > 50 and ((scores >= 0) & (scores <= 1)).all()
    assert area(scores, labels) > floor


def test_held_out_language(spark):
    found = QUERIES["op3_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    predicted, given = held(found, "lang_pred", "lang")
    assert len(given) > 200 and (predicted == given).mean() > 0.98


def test_held_out_marks_follow_the_id(spark):
    for name, folds, fold in (("op3_language", 4, 2), ("op8_toxicity", 5, 0)):
        for row in QUERIES[name](spark, "/root/testdata/sf0.001").collect():
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % folds == fold)


def test_machine_scores_all_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(10, 30, dtype=np.uint32), -0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    terms = np.array([3, 11, 12, 17, 29, 40], np.uint32)
    at = [1, 2, 7, 19]
    s = -0.3 + machine.weights[at].sum() + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(at, 2))
    assert machine.score([terms, terms[:0]]) == pytest.approx([1 / (1 + np.exp(-s)), 1 / (1 + np.exp(0.3))])


def test_pairs_of_terms_are_learned():
    """Either term alone is harmless, both together are not: additive weights cannot say this for rates of one half."""
    rng = np.random.default_rng(2)
    found, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = rng.integers(100, 140, 6)
        found.append(np.unique(np.array([*noise, *([1] if a else []), *([2] if b else [])], np.uint32)))
        labels.append(int(a and b))
    scores = toxicity.fit(found, np.array(labels)).score(found)
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.99


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {-1, 1}
    assert all((a != b).sum() >= (1 if n < 4 else code.shape[1] // 4) for a, b in itertools.combinations(code, 2))


def test_gram_counts_by_hand(monkeypatch):
    text = "Abab abab  ab é"
    whole = list(arrow_text.gram_counts(pa.array([text, None, ""]), (2, 3), 14, lower=True))
    assert [len(b) for b, _ in whole[1:]] == [0, 0]
    raw = text.lower().encode()
    assert whole[0][1].sum() == len(raw) - 1 + len(raw) - 2 + 4 + 1  # n-grams, words, one repeated word
    monkeypatch.setattr(arrow_text, "SLICE_BYTES", 5)
    cut = list(arrow_text.gram_counts(pa.array([text]), (2, 3), 14, lower=True))
    assert (cut[0][0] == whole[0][0]).all() and (cut[0][1] == whole[0][1]).all()


ROWS = [(1, None, "x"), (2, "", "x"), (None, "ein kurzer Text", "de"), (4, "12 34 !", None), (4, "same id", "en"), (4, "same id", "en"), (5, "the " * 60_000, "en")]


def odd(spark, rows):
    return spark.createDataFrame([(a, b, c, 0.5, "y") for a, b, c in rows], "doc_id bigint, text string, lang string, score double, label string")


def test_odd_rows(spark):
    docs, labels = odd(spark, ROWS), spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (77, 1, 1), (5, 0, 0)], "doc_id bigint, toxic int, quality int")
    for module, scores in ((toxicity, toxicity.score(docs, toxicity.train(docs, labels))), (quality, quality.score(docs, quality.train(docs, labels)))):
        got = scores.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(a) for a, _, _ in ROWS)
        assert all(0 <= r.score <= 1 for r in got)
        alone = module.score(docs, module.train(docs, labels.limit(0))).collect()
        assert len({r.score for r in alone}) == 1 and alone[0].score < 0.01
        assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels), threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_odd_languages(spark):
    docs = odd(spark, ROWS)
    got = {(r.doc_id, r.lang_pred, r.ambiguous) for r in language.predict(docs, language.train(docs)).collect()}
    assert {(1, "und", True), (2, "und", True)} <= got and all(p in ("de", "en", "x", "und") for _, p, _ in got)
    assert (4, "und", True) in got and len([g for g in got if g[0] == 4]) == 2
    none = language.predict(docs, language.train(docs.withColumn("lang", language.F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = language.predict(docs, language.train(docs.where("lang = 'en'"), hold=(1, 1))).collect()
    assert {r.lang_pred for r in one} == {"en", "und"} and max(r.score for r in one) == 1
    assert language.drop_unclear(docs, language.train(docs.where("lang = 'en'"), hold=(1, 1))).columns == docs.columns
    assert language.predict(docs.limit(0), None).count() == 0


def test_sample_is_the_least_hashes_of_each_label(spark):
    rows = spark.range(200_000).selectExpr("IF(id < 199900, 'big', 'small') AS label", "xxhash64(id div 3) AS hash", "id AS row")
    plain = {}
    for r in rows.collect():
        plain.setdefault(r.label, {}).setdefault(r.hash, r.row)
    for per_label in (1, 50, 2000):
        wanted = [(label, found[h]) for label, found in plain.items() for h in sorted(found)[:per_label]]
        assert sorted(wanted) == sorted((r.label, r.row) for r in training.sampled(rows, per_label).collect())


def counted(frame):
    return {r["label"]: r["count"] for r in frame.groupBy("label").count().collect()}


OPTIONS = {"id_col": "doc_id", "text_col": "text", "hold": (4, 2)}


@pytest.mark.parametrize("hot", [None, 1, 2, 3, 5])
def test_thousands_of_rows_of_one_id(spark, hot):
    docs = spark.range(5000).selectExpr("CAST(NULL AS bigint) AS doc_id" if hot is None else f"{hot}L AS doc_id", "concat('ein text ', id) AS text", "'de' AS lang")
    docs = docs.unionByName(spark.range(3000).selectExpr("1000 + id AS doc_id", "concat('a text ', id) AS text", "'en' AS lang"))
    got = counted(training.given_rows(docs, label_col="lang", per_label=500, **OPTIONS))
    held = hot is not None and zlib.crc32(str(hot).encode()) % 4 == 2
    assert got == ({"en": 500} if held else {"en": 500, "de": 500})


def test_equal_rows_of_one_id_count_once(spark):
    docs = spark.range(9000).selectExpr("1L AS doc_id", "'ein text' AS text", "'de' AS lang").unionByName(spark.range(90).selectExpr("2 + id AS doc_id", "'ein text' AS text", "'de' AS lang"))
    got = training.given_rows(docs, label_col="lang", per_label=500, **OPTIONS)
    ids = [i for i in range(1, 92) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert counted(got) == {"de": len(ids)}


def test_rare_texts_among_null_ones_are_found(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 1000 = 7, concat('ein text ', id), NULL) AS text", "'de' AS lang")
    ids = [i for i in range(7, 20_000, 1000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert counted(training.given_rows(docs, label_col="lang", per_label=500, **OPTIONS)) == {"de": len(ids)}


@pytest.mark.parametrize("hot", [None, 1, 2, 3, 7])
def test_thousands_of_labels_of_one_id(spark, hot):
    docs = spark.range(4000).selectExpr("IF(id < 2000, 7L, id) AS doc_id", "concat('text ', id % 900) AS text")
    labels = spark.range(6000).selectExpr("CAST(NULL AS bigint) AS doc_id" if hot is None else f"{hot}L AS doc_id", "1 AS toxic")
    labels = labels.unionByName(spark.range(3000).selectExpr("id AS doc_id", "0 AS toxic"))
    got = training.labelled_rows(docs, labels, "toxic", id_col="doc_id", text_col="text", hold=(5, 0), per_label=300).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in got}
    assert counts[0] == 300 and counts.get(1, 0) == (300 if hot == 7 and zlib.crc32(b"7") % 5 else 0)


def test_labels_of_ids_without_text(spark):
    """Nearly all labelled ids have a null text or no row: the few others are found."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 5000 = 3, concat('text ', id), NULL) AS text")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    ids = [i for i in range(3, 30_000, 5000) if zlib.crc32(str(i).encode()) % 5]
    got = counted(training.labelled_rows(docs, labels, "toxic", id_col="doc_id", text_col="text", hold=(5, 0), per_label=100))
    assert sum(got.values()) == len(ids)


def test_plain_decoding(spark):
    """op3: each bit's margin, the loss of each codeword and the share of the nearest one, summed one by one."""
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for row in rows[:60]:
        if not any(c.isalpha() for c in row.text or ""):
            assert found[row.doc_id].lang_pred == "und"
            continue
        ((buckets, counts),) = arrow_text.gram_counts(pa.array([row.text]), language.SIZES, language.BITS, lower=True)
        values = [(c / sum(counts.tolist())) ** 0.5 for c in counts.tolist()]
        margins = [sum(v * model.vectors[b, k] for b, v in zip(buckets.tolist(), values)) + model.bias[k] for k in range(model.code.shape[1])]
        losses = [sum(w * np.log1p(np.exp(-np.clip(m * c, -30, 30))) for w, m, c in zip(model.weights, margins, word)) for word in model.code]
        near = [np.exp(min(losses) - x) for x in losses]
        assert found[row.doc_id].lang_pred == model.names[int(np.argmin(losses))]
        assert found[row.doc_id].score == pytest.approx(max(near) / sum(near), rel=1e-6)


def test_plain_average_and_softmax(spark):
    """op9: the mean of all vectors of a text's n-grams and words, and the softmax over it, summed one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    found = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for row in rows:
        ((buckets, counts),) = arrow_text.gram_counts(pa.array([row.text or ""]), quality.SIZES, quality.BITS, lower=False)
        total = sum(counts.tolist())
        mean = [sum(c * model.vectors[b, k] for b, c in zip(buckets.tolist(), counts.tolist())) / total if total else 0.0 for k in range(model.vectors.shape[1])]
        out = [sum(m * model.layer[k, j] for k, m in enumerate(mean)) + model.bias[j] for j in range(2)]
        high = max(out)
        share = np.exp(out[1] - high) / (np.exp(out[0] - high) + np.exp(out[1] - high))
        assert found[row.doc_id] == pytest.approx(share, rel=1e-6, abs=1e-12)  # odds are cut at exp(-30)
