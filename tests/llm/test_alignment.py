"""Cross-tokenizer alignment against whole-text encodings by the two libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripweave.llm import alignment
from tripweave.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    """(id, text) rows to the operator's columns, document by document, link by link."""
    a, b = libraries
    to_byte = {letter: i for i, letter in enumerate(byte_letters())}
    found, held = [], Counter()
    for key, text in rows:
        pairs, groups = [], []
        if text:
            x = a.encode(" " + text, add_special_tokens=False).ids
            y = b.encode(text)
            x_bytes = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in x]
            names = [b.id_to_piece(i) for i in y]
            y_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(y, names)]
            if b"".join(x_bytes) == b"".join(y_bytes) == (" " + text).encode():
                i = j = p = q = 0
                group = ([], [])
                while i < len(x) or j < len(y):
                    if j == len(y) or (i < len(x) and p <= q):
                        p += len(x_bytes[i])
                        group[0].append(x[i])
                        i += 1
                    else:
                        q += len(y_bytes[j])
                        group[1].append(y[j])
                        j += 1
                    if p == q:
                        groups.append(group)
                        pairs += [(s, t) for s in group[0] for t in group[1]]
                        group = ([], [])
        held.update(set(pairs))
        found.append((key, groups, pairs))
    best = {}
    for (s, _), n in held.items():
        best[s] = max(best.get(s, 0), n)
    out = []
    for key, groups, pairs in found:
        joined = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in groups)
        out.append((
            key, sum(len(s) for s, _ in groups), sum(len(t) for _, t in groups), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs),
            sum(held[p] for p in pairs), hashlib.sha256(joined.encode()).hexdigest() if groups else "",
        ))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def compared(spark, docs, libraries):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(key, map(tuple, alignment.align(docs, A, B).collect()))) == sorted(map(key, plain(rows, libraries)))


def test_whole_table(spark, sf, libraries):
    compared(spark, spark.read.parquet(f"{sf}/documents.parquet"), libraries)


HARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b  ", "a▁b", "▁", "<|endoftext|> x <s> </s> <unk> <0x41>", "café café 日本語 \U0001f600\U0001f468‍\U0001f469",
    "it's we'll 'tis 12345 x1y2 ...!!! a\tb\r\nc", "a b   c　 d", "\x1c a \x1d\x1e b", "a \x00b", "word " * 300, "the the the the", "xyz" * 700,
]


def test_hard_texts_nulls_and_repeated_rows(spark, libraries):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(HARD)] + [(3, "the the the the")] * 40 + [(None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, a int, block string").repartition(5)
    compared(spark, docs, libraries)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(docs, A, B).count() == 0


def test_small_blocks_pieces_and_tables(spark, sf, libraries, monkeypatch):
    """Texts cut into many pieces, a table that starts anew all the time, and blocks of a few documents change nothing."""
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect())]
    monkeypatch.setattr(alignment, "PIECE_CHARS", 500)
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 50)
    aligner = alignment.Aligner(alignment.read_definition(A), alignment.read_model(B))
    entries, counts, facts = [], [], [()] * len(rows)
    for i, fact, pairs, often in aligner.align([t or "" for _, t in rows]):
        facts[i] = fact
        entries.append(pairs.astype(np.uint64) << np.uint64(16) | np.uint64(i))
        counts.append(often)
    wanted = plain(rows, libraries)
    assert [(f[0], f[1], f[2], f[3], f[4]) for f in facts] == [(w[1], w[2], w[3], w[4], w[7]) for w in wanted]


@pytest.mark.parametrize("docs", [1, 3, 40, 3000, 1 << 16])
def test_planes_give_back_their_links(docs):
    rng = np.random.default_rng(docs)
    share = {7: 1.0, 9: 0.4, 70_000: 0.01, 5 << 16: 0.5}
    keys = np.sort(np.concatenate([np.flatnonzero(rng.random(docs) < s).astype(np.uint64) | np.uint64(p << 16) for p, s in share.items()]))
    counts = rng.choice([1, 1, 1, 2, 4, 5, 1000], len(keys))
    pairs, held, lists = alignment.planes(keys, counts, docs)
    assert dict(zip(pairs.tolist(), held.tolist())) == Counter((keys >> np.uint64(16)).tolist())
    row, plane, slot = alignment.slots_of(lists, docs)
    found = Counter()
    for r, k, s in zip(pairs[row].tolist(), plane.tolist(), slot.tolist()):
        found[r << 16 | s] += 1 << k
    assert found == dict(zip(keys.tolist(), counts.tolist()))
    part = pa.chunked_array([lists]).slice(1).combine_chunks() if len(lists) > 1 else lists
    assert len(alignment.slots_of(part, docs)[0]) <= len(row)


def test_pair_counts(spark, libraries):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog the"), (3, None)], "doc_id bigint, text string")
    counts = alignment.pair_counts(alignment.blocks(docs, A, B))
    a = libraries[0].encode(" the", add_special_tokens=False).ids[0]
    (row,) = counts.where(F.col("a") == a).collect()
    assert (row.n_docs, row.best) == (2, True)
