"""Byte-level BPE against the tokenizers library, which encodes the same texts by merging."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tripweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER, DECODER = bpe.Encoder(bpe.read_definition(PATH)), bpe.Decoder(bpe.read_definition(PATH))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab' stredl\n\té¿\x1c\x1f\x85\xa0\xadª²¼×÷ɏɐ_", max_size=60), st.just("<|endoftext|>")), max_size=6).map("".join))
def test_any_text(text):
    (ids,) = ENCODER.encode([text])
    assert ids.tolist() == library(text)
    assert DECODER.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "the " * 500, " \n\n  x", "don't we'll I'M", "日本語テキスト" * 50, "1234567890" * 9, "<|endoftext|><|endoftext|", "\U0001f600‍"])
def test_special_shapes(text):
    (ids,) = ENCODER.encode([text])
    assert ids.tolist() == library(text)


def test_pieces_of_a_long_text(monkeypatch):
    text = "Ein kurzer Satz, und  noch einer.\n" * 300 + "x" * 500 + "<|endoftext|> fin"
    monkeypatch.setattr(bpe, "PIECE_CHARS", 97)
    assert [x.tolist() for x in ENCODER.encode([text, "a b"])] == [library(text), library("a b")]


def test_more_words_than_the_tables_hold(spark, sf, monkeypatch):
    """Words met again in the older table are taken over; full tables change no encoding."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    monkeypatch.setattr(bpe, "KEPT_STEPS", 10)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 10)
    encoder = bpe.Encoder(bpe.read_definition(PATH))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["<|endoftext|>the end"]
    for _ in range(2):
        for text in texts:
            (ids,) = encoder.encode([text])
            assert ids.tolist() == library(text)
    assert len(encoder._older) > 0


def test_bytes_that_are_no_text():
    ids = [ENCODER._ids[bytes([b])] for b in (0xE2, 0x28, 0xFF, 0x41)]
    assert DECODER.decode(bpe.np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf):
    from tripweave.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, sf).collect()}
    assert len(found) == len(docs)
    for doc in docs:
        ids, row = library(doc.text or ""), found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a b", "y"), (2, "a b", "y"), (2, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text, list(r.ids)) for r in out) == sorted((i or 0, t or "", library(t or "")) for i, t, _ in rows)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
    apart = bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH), keep=("ids",))
    assert sorted(map(str, bpe.round_trip(docs, PATH, keep_ids=True).collect())) == sorted(map(str, apart.collect()))
    assert bpe.round_trip(docs.limit(0), PATH, keep_ids=True).count() == 0
