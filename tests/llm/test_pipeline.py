"""Every stage of the pipeline against a plain version over its own input, and stages on odd rows."""

import hashlib
import itertools
import re

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tripweave.llm import language, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(texts):
    """Places of texts that are the first of their component, by comparing all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def contaminated(text, items):
    line = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))) + " "
    for item in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(item))
        if words and any(f" {' '.join(words[i : i + 10])} " in line for i in range(max(1, len(words) - 9))):
            return True
    return False


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(rows_of(after), key=repr)
        if name == "bpe":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert len(got) == len(before)
            texts = {r.doc_id: r.text for r in before}
            for row in after.collect():
                ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
                assert list(row.ids) == ids and row.n_tokens == len(ids)
                assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
            break
        assert after.columns == columns
        column = pa.array([r.text for r in before])
        if name == "toxicity":
            scores = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")).score(toxicity.text_terms(column))
            kept = [r for r, s in zip(before, scores) if s < 0.5]
        elif name == "language":
            judged = language._judge(language.train(docs), column)
            kept = [r for r, (_, _, unclear) in zip(before, judged) if not unclear]
        elif name == "near_duplicates":
            kept = [before[i] for i in first_of_groups([r.text for r in before])]
        else:
            kept = [r for r in before if not contaminated(r.text, items)]
        assert got == sorted(map(tuple, kept), key=repr)
        sizes.append(len(got))
        docs = after
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4]  # these stages had something to drop
    assert sorted(rows_of(corpus_pipeline.run(spark, SF)), key=repr) == got


ODD = [
    (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, " \n ", "en", None, 3), (None, "one two three four five six", "en", "s", None),
    (None, "One two  THREE four five six", "en", "s", None), (5, "same id", "en", "s", 1), (5, "same id", "en", "s", 1), (6, "x " * 30_000, "en", "s", 2),
]


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, tmp_path, extra):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows, name = ODD, "plain"
    if extra:
        rows, name = [(*r, "a", 1, "c") for r in ODD], "extra"
        schema += ", row_ string, class bigint, score string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = rows_of(STAGES["near_duplicates"](spark, docs, SF))
    order = rows_of(docs)
    assert sorted(kept, key=repr) == sorted((order[i] for i in first_of_groups([r[1] for r in order])), key=repr)
    assert rows_of(STAGES["near_duplicates"](spark, docs.limit(0), SF)) == []
    assert sorted(rows_of(STAGES["decontamination"](spark, docs, SF)), key=repr) == sorted(rows, key=repr)
    assert len(rows_of(STAGES["toxicity"](spark, docs, SF))) >= len(rows) - 2
    clear = rows_of(STAGES["language"](spark, docs, SF))
    assert {r[0] for r in clear} == {None, 5, 6} and len(clear) == 5
    assert len(rows_of(STAGES["bpe"](spark, docs, SF))) == len(rows)
