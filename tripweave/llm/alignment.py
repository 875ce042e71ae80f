"""Alignment of two tokenizers' tokens over a corpus, by inverted bitmaps for each pair of ids.

Tokenizer A is byte-level BPE and encodes a blank and the text; tokenizer B is sentencepiece BPE with byte fallback, which adds that
blank itself. Where tokens of both end at the same byte, a group ends; each A token of a group links to each B token of it.

* Chunks: a single blank between two characters that are not white space is a cut for both: A's word pattern starts a word
  there, and no piece of B holds a blank after another character (checked on the vocabulary). So a chunk's tokens, groups and links do not
  depend on its neighbours, and each distinct chunk is aligned once while it is in a worker's bounded table.
* Blocks: consecutive documents of a task, by number of links (and 65,536 at most), so that a document is a small slot number. For each pair of ids a block
  has the postings as planes of compressed bitmaps: plane k holds the documents whose number of links of that pair has bit
  k set. A bitmap is a list of 16-bit slots or, where that is longer, plain bits.
* The planes ORed are the documents that hold the pair, and their popcount is the block's part of its document count; blocks
  share no document, so their ORed bitmaps lie side by side and the popcounts add up. Link counts are the popcounts weighted by 2**k.
* Postings return scores: each block's planes meet the pair's count and give it to the documents they name.

Defined results: a null or empty text, or one that B cannot give back byte for byte (one with U+2581, say), has no tokens and counts 0, and
its groups are ''. Special tokens' strings in a text are plain text. Every row is a document, whatever its id; repeated rows count
each. Texts of any length are worked on in pieces cut at chunk ends (a text without such an end is one piece). Columns but the id and the text are
not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tripweave.session import write_through

from .bpe import read_definition, token_bytes

PIECE_CHARS = 1 << 19
#: A block ends with the document that brings it to so many distinct (pair, document) entries, or with this many documents.
BLOCK_ENTRIES, BLOCK_DOCS = 1 << 20, 1 << 16
#: Chunks whose alignment a worker keeps; beyond it the table starts anew with the chunks at hand.
KEPT_CHUNKS = 400_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "▁"
#: Beyond these characters two libraries may hold different versions of Unicode.
_COMMON = re.compile("[\\x00-\u024f]*")

# Fixed value: the word pattern of byte-level BPE as its authors published it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(definition: str, names: list[bytes]) -> tiktoken.Encoding | None:
    """The same encoding by ranks, where ids rise with the merges and the word pattern is the published one; else None."""
    spec = json.loads(definition)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= not spec["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in pairs]
    if not plain or made != sorted(set(made)) or len(made) + 256 != len(model["vocab"]) - sum(t["content"] in model["vocab"] for t in spec["added_tokens"]):
        return None
    ranks = {names[i]: i for i in model["vocab"].values() if len(names[i]) == 1}
    ranks |= {names[i]: i for i in made}
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def read_model(path: str) -> bytes:
    """A sentencepiece model (under 1 MB), read by the driver and broadcast."""
    filesystem, name = pyarrow.fs.FileSystem.from_uri(path)
    with filesystem.open_input_stream(name) as stream:
        return stream.read()


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id; control pieces have none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        if model.is_byte(i) and byte:
            out.append(bytes([int(byte[1], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(_BLANK, " ").encode())
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next range."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Aligner:
    """Two tokenizers, and the alignments of the chunks met last."""

    def __init__(self, definition: str, model: bytes) -> None:
        self._a = Tokenizer.from_str(definition)
        self._a.encode_special_tokens = True
        self._a.no_truncation()
        self._a.no_padding()
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes, self.b_bytes = token_bytes(json.loads(definition)), piece_bytes(self._b)
        self._ranked = _ranked(definition, self.a_bytes)
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 ids are not supported")
        if any(re.search(f"[^{_BLANK}]{_BLANK}", self._b.id_to_piece(i)) for i in range(len(self.b_bytes))):
            raise ValueError("a piece of the second tokenizer crosses a blank between words")
        self._a_sizes, self._b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._names = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._texts: list[str] = []
        self._links: list[np.ndarray] = []
        #: For each chunk: A tokens, B tokens (-1: B cannot give it back), groups, links.
        self._sizes: list[np.ndarray] = []
        self._joined: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers for a text that starts with a blank; None if B cannot give it back."""
        b = self._b.encode(text[1:])
        if not b or b"".join(map(self.b_bytes.__getitem__, b)) != text.encode():
            return None
        if self._ranked is not None and _COMMON.fullmatch(text):
            a = self._ranked.encode_ordinary(text)
        else:
            a = self._a.encode(text, add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(b, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Align chunks that are not in the table, all together where the cuts between them are certain."""
        plain = [c for c in chunks if c[1:2] and not c[1].isspace() and not c[-1].isspace()]
        rest = set(chunks).difference(plain)
        common = [c for c in plain if _COMMON.fullmatch(c)]
        for some in (common, list(set(plain).difference(common))):
            found = self._tokens("".join(some)) if some else None
            if found is None:
                rest.update(some)
            else:
                self._add(some, *found)
        for chunk in rest:
            found = self._tokens(chunk)
            if found is None:
                self._place[chunk] = len(self._texts)
                self._texts.append("")
                self._links.append(np.zeros(0, np.uint32))
                self._sizes.append(np.array([[0, -1, 0, 0]]))
            else:
                self._add([chunk], *found)
        self._joined = None

    def _add(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])
        shared = np.intersect1d(a_ends, b_ends)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        a_count, b_count = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
        many = b_count[a_group]
        links = np.repeat(a, many).astype(np.uint32) << np.uint32(16) | b[_ranges((np.cumsum(b_count) - b_count)[a_group], many)].astype(np.uint32)
        # Names of a group's tokens, those of A first, each with the mark that follows it.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        last_a = np.append(a_group[1:] != a_group[:-1], True)
        last_b = np.append(b_group[1:] != b_group[:-1], True)
        names = [self._names[i] for i in np.concatenate([3 * a + last_a, 3 * b + 2 * last_b])[order].tolist()]
        ends = np.cumsum([len(c.encode()) for c in chunks])
        bounds = np.stack([np.searchsorted(x, ends) + 1 for x in (a_ends, b_ends, shared)], axis=1)
        link_ends = np.cumsum(a_count * b_count)[bounds[:, 2] - 1]
        sizes = np.diff(np.concatenate([bounds, link_ends[:, None]], axis=1), axis=0, prepend=0)
        at = 0
        for chunk, tokens in zip(chunks, (sizes[:, 0] + sizes[:, 1]).tolist()):
            self._place[chunk] = len(self._texts)
            self._texts.append("".join(names[at : at + tokens])[:-1])
            at += tokens
        self._links.append(links)
        self._sizes.append(sizes)

    def chunks(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text (with its first blank) as chunks, and for all chunks together: sizes, places of links, the links."""
        cut = []
        for text in texts:
            parts = _CUT.split(text)
            cut.append([parts[0], *[" " + p for p in parts[1:]]])
        new = list(set(chain.from_iterable(cut)).difference(self._place))
        if len(self._place) + len(new) > KEPT_CHUNKS:
            self._clear()
            new = list(set(chain.from_iterable(cut)))
        if new:
            self._learn(new)
        if self._joined is None:
            self._links, self._sizes = [np.concatenate(self._links)], [np.concatenate(self._sizes)]
            counts = self._sizes[0][:, 3]
            self._joined = (self._sizes[0], np.cumsum(counts) - counts, self._links[0])
        every = np.fromiter(map(self._place.__getitem__, chain.from_iterable(cut)), np.int64)
        return cut, every, *self._joined

    def groups(self, parts: list[str]) -> str:
        return ";".join([self._texts[self._place[p]] for p in parts])

    def pieces(self, text: str) -> Iterator[str]:
        """A blank and the text, cut at chunk ends into pieces of about PIECE_CHARS."""
        text, at = " " + text, 0
        while len(text) - at > PIECE_CHARS:
            gap = _CUT.search(text, at + PIECE_CHARS)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def align(self, texts: list[str]) -> Iterator[tuple[int, tuple, np.ndarray, np.ndarray]]:
        """For each text its place, (n_a, n_b, n_groups, n_links, digest of its groups), and its distinct links (A id << 16 | B id) with
        their counts."""
        short = [i for i, t in enumerate(texts) if t and _BLANK not in t and len(t) <= PIECE_CHARS]
        cut, every, sizes, starts, links = self.chunks([" " + texts[i] for i in short]) if short else ([], *[np.zeros(0, np.int64)] * 4)
        at = 0
        for i, parts in zip(short, cut):
            own = every[at : at + len(parts)]
            at += len(parts)
            total = sizes[own].sum(axis=0)
            if (sizes[own, 1] >= 0).all():
                pairs, counts = np.unique(links[_ranges(starts[own], sizes[own, 3])], return_counts=True)
                yield i, (*total.tolist(), hashlib.sha256(self.groups(parts).encode()).hexdigest()), pairs, counts
            else:
                yield i, (0, 0, 0, 0, ""), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for i, text in enumerate(texts):
            if not text or _BLANK in text:
                yield i, (0, 0, 0, 0, ""), np.zeros(0, np.uint32), np.zeros(0, np.int64)
            elif len(text) > PIECE_CHARS:
                yield i, *self._long(text)

    def _long(self, text: str) -> tuple[tuple, np.ndarray, np.ndarray]:
        total, digest, pairs, counts = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for number, piece in enumerate(self.pieces(text)):
            (parts,), every, sizes, starts, links = self.chunks([piece])
            if (sizes[every, 1] < 0).any():
                return (0, 0, 0, 0, ""), np.zeros(0, np.uint32), np.zeros(0, np.int64)
            total += sizes[every].sum(axis=0)
            digest.update((";" * bool(number) + self.groups(parts)).encode())
            some, often = np.unique(links[_ranges(starts[every], sizes[every, 3])], return_counts=True)
            pairs, counts = _summed(np.concatenate([pairs, some]), np.concatenate([counts, often]))
        return (*total.tolist(), digest.hexdigest()), pairs, counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def planes(entries: np.ndarray, counts: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """From sorted entries (pair << 16 | slot) with their counts: the pairs, the number of documents of each (popcount of its
    planes ORed) and its planes: list of bitmaps, the k-th with the slots whose count has bit k."""
    pair = entries >> np.uint64(16)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    held = np.diff(np.append(first, len(pair)))
    deep = np.maximum.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    bits = np.ceil(np.log2(deep + 1)).astype(np.int64)
    cell_start = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(first)), held)
    cells, slots = [], []
    for k in range(int(bits.max(initial=0))):
        has = np.flatnonzero(counts >> k & 1)
        cells.append(cell_start[of[has]] + k)
        slots.append((entries[has] & np.uint64(0xFFFF)).astype(np.uint16))
    cell = np.concatenate([*cells, np.zeros(0, np.int64)])
    order = np.argsort(cell, kind="stable")
    cell, slot = cell[order], np.concatenate([*slots, np.zeros(0, np.uint16)])[order]
    size = np.bincount(cell, minlength=int(bits.sum()))
    whole = -(-docs // 8)
    dense = 2 * size >= whole
    length = np.where(dense, whole, 2 * size)
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    sparse = ~dense[cell]
    rank = np.arange(len(cell)) - (np.cumsum(size) - size)[cell]
    at = (start[cell] + 2 * rank)[sparse]
    out[at], out[at + 1] = slot[sparse] & np.uint16(255), slot[sparse] >> np.uint16(8)
    thick = ~sparse
    np.bitwise_or.at(out, start[cell[thick]] + (slot[thick] >> np.uint16(3)), np.uint8(1) << (slot[thick] & np.uint16(7)).astype(np.uint8))
    offsets = np.append(start, len(out)).astype(np.int32)
    maps = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(cell_start, len(size)), pa.int32()), maps)
    return pair[first], held, lists


def slots_of(lists: pa.ListArray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All set bits of the planes: number of the list, plane, slot."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    maps = lists.values
    bounds = np.frombuffer(maps.buffers()[1], np.int32, count=len(maps) + 1 + maps.offset)[maps.offset :].astype(np.int64)
    data = np.frombuffer(maps.buffers()[2], np.uint8) if maps.buffers()[2] is not None and len(maps) else np.zeros(0, np.uint8)
    of = np.repeat(np.arange(len(lists)), np.diff(ends))
    cells = np.arange(ends[0], ends[-1])
    plane = cells - np.repeat(ends[:-1], np.diff(ends))
    length, start = np.diff(bounds)[cells], bounds[cells]
    whole = -(-docs // 8)
    thin, thick = np.flatnonzero(length != whole), np.flatnonzero(length == whole)
    at = np.repeat(start[thin], length[thin] // 2) + 2 * _ranges(np.zeros(len(thin), np.int64), length[thin] // 2)
    slot = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
    cell = np.repeat(thin, length[thin] // 2)
    step = max(1, (1 << 24) // max(1, 8 * whole))
    more_cells, more_slots = [cell], [slot]
    for low in range(0, len(thick), step):
        some = thick[low : low + step]
        set_bits = np.unpackbits(data[start[some][:, None] + np.arange(whole)], axis=1, bitorder="little")
        row, bit = np.nonzero(set_bits)
        more_cells.append(some[row])
        more_slots.append(bit)
    cell = np.concatenate(more_cells)
    return of[cell], plane[cell], np.concatenate(more_slots)


_ALIGNERS: dict[tuple[str, bytes], Aligner] = {}
_DOC = ["slot", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_DOC_DDL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_PAIR_DDL = "a int, b int, docs bigint, planes array<binary>"


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in slices of about PIECE_CHARS characters."""
    first, size, held = 0, 0, []
    for row, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > PIECE_CHARS:
            yield first, held
            first, size, held = row, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def blocks(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index as a written table. Rows of two kinds, both with the number of their block: one for each document (slot,
    id, counts of its tokens, groups and links, digest of its groups) and one for each pair of ids linked in the block (a, b, docs, planes)."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((read_definition(path_a), read_model(path_b)))
    kind = docs.schema[id_col].dataType
    types = [pa.int64(), pa.int32(), None, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary())]
    names = ["block", *_DOC, "a", "b", "docs", "planes"]

    def run(batches):
        if shared.value not in _ALIGNERS:
            _ALIGNERS[shared.value] = Aligner(*shared.value)
        aligner = _ALIGNERS[shared.value]
        held: list[tuple] = []
        ids, entries, counts, number, filled = [], [], [], None, 0

        def batch_of(rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            filled_in = [columns.get(n, pa.nulls(rows, t or id_type)) for n, t in zip(names, types)]
            return pa.RecordBatch.from_arrays([x.cast(t or id_type) if n != "planes" else x for n, x, t in zip(names, filled_in, types)], names=names)

        def flush():
            nonlocal held, ids, entries, counts, number, filled
            rows = len(held)
            columns = {n: pa.array([h[i] for h in held], t) for i, (n, t) in enumerate(zip(_DOC[2:], types[3:8]))}
            columns |= {"block": pa.array([number] * rows), "slot": pa.array(range(rows), pa.int32()), "id": pa.concat_arrays(ids)}
            yield batch_of(rows, columns)
            keys, often = _summed(np.concatenate(entries), np.concatenate(counts))
            pairs, found, lists = planes(keys, often, rows)
            for low in range(0, len(pairs), 20_000):
                some = pairs[low : low + 20_000]
                yield batch_of(len(some), {
                    "block": pa.array(np.full(len(some), number)), "a": pa.array((some >> np.uint64(16)).astype(np.int32)), "b": pa.array((some & np.uint64(0xFFFF)).astype(np.int32)),
                    "docs": pa.array(found[low : low + 20_000]), "planes": lists.slice(low, len(some)),
                })
            held, ids, entries, counts, number, filled = [], [], [], [], None, 0

        for batch in batches:
            id_type = batch.schema.field(1).type
            for first, texts in _slices(batch.column(2)):
                done = 0
                while done < len(texts):
                    some = texts[done : done + BLOCK_DOCS - len(held)]
                    if number is None:
                        number = batch.column(0)[first + done].as_py()
                    base = len(held)
                    facts = [()] * len(some)
                    for i, fact, pairs, often in aligner.align(some):
                        facts[i] = fact
                        entries.append(pairs.astype(np.uint64) << np.uint64(16) | np.uint64(base + i))
                        counts.append(often)
                        filled += len(pairs)
                    held += facts
                    ids.append(batch.column(1).slice(first + done, len(some)))
                    done += len(some)
                    if filled >= BLOCK_ENTRIES or len(held) == BLOCK_DOCS:
                        yield from flush()
        if held:
            yield from flush()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return write_through(rows.mapInArrow(run, f"block bigint, slot int, id {kind.simpleString()}, {_DOC_DDL}, {_PAIR_DDL}"))


def pair_counts(index: DataFrame) -> DataFrame:
    """For each pair of ids (a, b) linked anywhere: n_docs, the documents that hold it linked, and best, whether no other pair of a has
    more. Written, as several readers need it."""
    counts = write_through(index.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("n_docs")))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each id of A: at most 65,536
    return write_through(counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def _scores():
    def run(table: pa.Table) -> pa.Table:
        """Rows of one block: its documents, and its pairs with their counts. Returns the documents with their sums."""
        own = table.filter(pa.compute.is_valid(table["slot"])).sort_by("slot")
        pairs = table.filter(pa.compute.is_valid(table["planes"])).combine_chunks()
        n = own.num_rows
        sums = {name: np.zeros(n, np.int64) for name in ("links", "n_best", "count_sum")}
        counts, best = pairs["n_docs"].to_numpy(), pairs["best"].to_numpy().astype(bool)
        at = 0
        for lists in pairs["planes"].chunks:
            # An expanded bit takes some 50 bytes: a block has them worked off in parts.
            for low in range(0, len(lists), 50_000):
                part = lists.slice(low, 50_000)
                row, plane, slot = slots_of(part, n)
                links = np.int64(1) << plane
                np.add.at(sums["links"], slot, links)
                np.add.at(sums["n_best"], slot, links * best[at + row])
                np.add.at(sums["count_sum"], slot, links * counts[at + row])
                at += len(part)
        if not np.array_equal(sums.pop("links"), own["n_links"].to_numpy()):
            raise ValueError("the bitmaps of a block do not give back its links")
        found = own.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        for name, values in sums.items():
            found = found.append_column(name, pa.array(values))
        return found

    return run


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each document of the index: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair is the best of its A
    id) and count_sum (document counts of its links' pairs, added up)."""
    doc_rows = index.where("slot IS NOT NULL").select("block", *_DOC, *[F.lit(None).cast(t).alias(n) for n, t in (("planes", "array<binary>"), ("n_docs", "bigint"), ("best", "boolean"))])
    met = index.where("a IS NOT NULL").select("block", "a", "b", "planes").join(counts, ["a", "b"])
    kinds = {f.name: f.dataType for f in index.schema}
    pair_rows = met.select("block", *[F.lit(None).cast(kinds[n]).alias(n) for n in _DOC], "planes", "n_docs", "best")
    ddl = f"id {kinds['id'].simpleString()}, {_DOC_DDL}, n_best bigint, count_sum bigint"
    return doc_rows.unionByName(pair_rows).groupBy("block").applyInArrow(_scores(), ddl)


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each row of docs."""
    index = blocks(docs, path_a, path_b, id_col=id_col, text_col=text_col)
    found = scores(index, pair_counts(index))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
