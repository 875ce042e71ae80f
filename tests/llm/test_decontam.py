"""Decontamination against plain search, offsets, and benchmarks of several slices."""

import random
import re

import pytest

from tripweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(text, items, size):
    words, hit, names = WORD.findall(lowered(text)), set(), set()
    for name, item in items:
        own = WORD.findall(lowered(item))
        for i in range(max(1, len(own) - size + 1)) if own else ():
            window = own[i : i + size]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    if name is not None:
                        names.add(str(name))
    return len(words), len(hit), sorted(names), hit


@pytest.mark.parametrize("slice_chars", [100_000, 40])
def test_small_alphabet(spark, slice_chars):
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice(["a", "b", "É", "Ab", "9"]) + rng.choice([" ", "  ", "-", "\n", "ß "]) for _ in range(n))
    items = [(k, line(rng.randrange(0, 9))) for k in range(12)] + [(None, line(6)), (13, None), (3, line(4))]
    texts = [line(rng.randrange(0, 60)) for _ in range(60)] + [None, "", "?!", "a " * 2000]
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(texts)], "doc_id bigint, text string, n_hit int, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.hits(docs, bench, window=4, slice_chars=slice_chars).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        n_words, n_hit, names, hit = by_hand(text, items, 4)
        assert (got[k].n_words, got[k].n_hit, list(got[k]["items"])) == (n_words, n_hit, names)
        inside = [w for s in got[k].spans for w in WORD.findall(lowered(text[s.start : s.end]))]
        words = WORD.findall(lowered(text))
        assert inside == [words[i] for i in sorted(hit)]
    clean = decontam.drop_contaminated(docs, bench, window=4, slice_chars=slice_chars)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r.n_hit}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a b"), (1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in decontam.hits(docs, none).collect()] == [(2, 0, [])] * 3
    assert decontam.hits(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_many_slices_are_built_once_a_block(spark):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(50)] + [(50 + k, "one shared passage of five words") for k in range(50)]
    docs = [(k, f"before {text} after") for k, text in items] + [(200, "nothing here"), (None, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(4)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    folder, count = decontam.write_slices(bench, "item_id", "text", 10, 30)
    assert count >= 30
    pairs = [pair for k in range(count) for pair in decontam.read_slice(folder, k)]
    assert len(pairs) == len(set(pairs)) == 50 * 3 + 50  # distinct pairs of item and window, each in one slice
    built = []
    original = decontam.automaton
    try:
        decontam.automaton = lambda rows: built.append(1) or original(rows)
        batches = [b for part in (table.toArrow(),) for b in part.to_batches(max_chunksize=10)]
        for block in decontam.blocks(iter(batches)):
            for machine in decontam.machines(folder, count):
                pass
        assert len(batches) > 5 and len(built) == count
        list(decontam.machines(folder, count))
        assert len(built) == 2 * count - decontam.KEPT_MACHINES
    finally:
        decontam.automaton = original
    got = {r.doc_id: r for r in decontam.hits(table, bench, slice_chars=30).collect()}
    assert [list(got[k]["items"]) for k in range(50)] == [[str(k)] for k in range(50)]
    assert all(list(got[50 + k]["items"]) == sorted(str(50 + j) for j in range(50)) and got[50 + k].n_hit == 6 for k in range(50))
    assert got[200].n_hit == got[None].n_hit == 0


def test_words_cross_pieces(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_BYTES", 5)
    text = "  Ab cdefghij--k  l é, mnopqrstu v  ".encode()
    assert decontam.normal_line(text) == " ab cdefghij k l é mnopqrstu v ".encode()
    assert decontam.normal_line(b" .. ") == decontam.normal_line(b"") == b""
