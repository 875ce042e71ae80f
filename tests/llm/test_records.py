"""Token files against the tokenizers library, and damage to them."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tripweave.llm import bpe, records

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = records.ChunkEncoder(bpe.read_definition(PATH))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aB' ÉßÀçİŉſΣσ́12!\n\x0b\x1c\x85\xa0", max_size=40), st.sampled_from(["<|endoftext|>", "<|startoftext|> ", "don't", "WE'LL"])), max_size=6).map("".join))
def test_any_text(text):
    assert np.frombuffer(ENCODER.encode(text.encode()), ENCODER.dtype).tolist() == library(text)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, other = records.ChunkEncoder(bpe.read_definition(path)), Tokenizer.from_file(path)
    assert not encoder.by_chunk
    assert np.frombuffer(encoder.encode(b"Two words"), encoder.dtype).tolist() == other.encode("Two words").ids


def test_pieces_and_a_full_table(monkeypatch):
    text = "Ein kurzer Satz, und noch einer: l'été.\n" * 200
    monkeypatch.setattr(records, "PIECE_BYTES", 61)
    monkeypatch.setattr(records, "KEPT_CHUNKS", 3)
    encoder = records.ChunkEncoder(bpe.read_definition(PATH))
    assert np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist() == library(text)


def expected(rows):
    start, out = 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library(text or ""), 2]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    from tripweave.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in QUERIES["op1_token_records"](spark, sf).collect())
    assert found == expected(rows)


def test_odd_rows_and_positions(spark, tmp_path):
    rows = [(5, "b a", "x"), (None, "null id", "x"), (5, "b a", "x"), (3, None, "y"), (-4, "", "y"), (9, "lo " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, path string")
    files = records.write(docs, f"file://{tmp_path}", PATH, end_id=2)
    found = [tuple(r)[:4] for r in sorted(records.read(spark, files).collect(), key=lambda r: (r.start))]
    assert found == expected([r[:2] for r in rows])
    for file in files.collect():
        all_records = list(records.read_file(file.path))
        order = list(reversed(range(file.n_records)))
        for (a, x), (b, y) in zip(reversed(all_records), records.read_file(file.path, order)):
            assert a == b and x.tolist() == y.tolist()
    empty = records.write(docs.limit(0), f"file://{tmp_path}", PATH, end_id=2)
    assert empty.count() == 0 and records.read(spark, empty).count() == 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id bigint, text string").coalesce(1)
    (file,) = records.write(docs, f"file://{tmp_path}", PATH, end_id=2).limit(1).collect()
    name = f"{tmp_path}/{file.path.rsplit('/', 1)[1]}.rec"
    data = open(name, "rb").read()
    for at in itertools.chain(range(0, len(data), 3), [len(data) - 1]):
        with open(name, "wb") as out:
            out.write(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(records.Damaged):
            list(records.read_file(file.path))
    with open(name, "wb") as out:
        out.write(data[:-2])
    with pytest.raises(records.Damaged):
        list(records.read_file(file.path))
