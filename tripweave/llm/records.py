"""Token files: length-delimited binary records with masked checksums, and an offset index beside each file.

A data file is a sequence of records, each
    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload
and the payload of a document is
    u8 has_id | u8 bytes per token (2 or 4) | i64 id | token ids
all little-endian. The index file holds the u64 offset of every record and the end of the last, so that any record can be
read without those before it. A mask (rotation and constant) keeps checksums of data that hold checksums apart.

Documents are dealt out in ranges of ascending id. Each range is encoded, sorted and written by one task under a name of
its own; the task's result row names the file. That table of files is written before anything is read back, so a task that
runs twice leaves an unused file, never a repeated or half-written one.

Defined results: a null text is an empty one; every document ends with the end id, so it has a token at least. Null ids
come first, repeated ids stand side by side, in the order of their texts. An empty table gives no file and no rows. Other
columns are not read. Ids are whole numbers of 64 bits.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from tripweave.session import shared_path, write_through

from .arrow_text import raw_bytes
from .bpe import byte_letters, read_definition

#: Chunks of text (what white space separates) whose encodings a worker process keeps.
KEPT_CHUNKS = 300_000
PIECE_BYTES = 1 << 20
_HEAD, _CRC, _OWN = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload))))


def document(name: int | None, ids: bytes, width: int) -> bytes:
    """The record of a document whose ids are given as little-endian integers of width bytes."""
    return frame(_OWN.pack(name is not None, width, name or 0) + ids)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A store that executors reach by the same URI as Spark does."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class ChunkEncoder:
    """Encodes a text chunk by chunk where the tokenizer cannot join what white space separates.

    A chunk of Latin letters, digits and signs is lower-cased and cut here as the tokenizer's own normaliser and pattern
    do, and its pieces go to the library's model; any other chunk goes through the whole library. A tokenizer with
    another normaliser or pattern gets whole texts.
    """

    # The settings under which chunks are independent.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    _LATIN = "À-ÖØ-öø-įı-ňŊ-ž"

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_chunk = (
            spec["normalizer"] == self.NORMALIZER
            and len(parts) == 2
            and parts[0] == {"type": "Split", "pattern": {"Regex": self.PATTERN}, "behavior": "Removed", "invert": True}
            and parts[1]["type"] == "ByteLevel"
            and not parts[1]["add_prefix_space"]
            and not parts[1]["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._letters = byte_letters()
        self._special = [t["content"] for t in spec["added_tokens"]]
        if any("<" not in s for s in self._special):
            self.by_chunk = False
        self._plain = re.compile(f"[\x21-\x7e{self._LATIN}]+")
        self._cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{self._LATIN}]+|[0-9]|[^a-z0-9{self._LATIN}]+")
        self._chunks: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece of the pattern, lower-cased, by the library's model."""
        if len(self._pieces) >= KEPT_CHUNKS:
            self._pieces.clear()
        letters = piece if piece.isascii() else "".join(map(self._letters.__getitem__, piece.encode()))
        found = self._pieces[piece] = self._ids([t.id for t in self.tokenizer.model.tokenize(letters)])
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that are not kept yet."""
        kept, known, piece = self._chunks, self._pieces.get, self._piece
        plain, cut = self._plain.fullmatch, self._cut.findall
        # No chunk holds a newline.
        for chunk, text in zip(chunks, b"\n".join(chunks).decode("utf-8", "replace").split("\n")):
            if not plain(text) or ("<" in text and any(s in text for s in self._special)):
                kept[chunk] = self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            text = text.lower()
            found = known(text)
            kept[chunk] = b"".join([known(p) or piece(p) for p in cut(text)]) if found is None else found

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian integers of dtype."""
        if not self.by_chunk:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()
        out, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > PIECE_BYTES:
                gap = re.compile(rb"[ \t\n\r\x0b\x0c]").search(text, at + PIECE_BYTES)
                to = gap.end() if gap else to
            chunks = text[at:to].split()
            at = to
            kept = self._chunks
            new = set(chunks).difference(kept)
            if len(kept) + len(new) > KEPT_CHUNKS:
                kept.clear()
                new = set(chunks)
            if new:
                self._learn(list(new))
            out.append(b"".join(map(kept.__getitem__, chunks)))
        return b"".join(out)


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(definition: str) -> ChunkEncoder:
    """One for each worker process and vocabulary."""
    if definition not in _ENCODERS:
        _ENCODERS[definition] = ChunkEncoder(definition)
    return _ENCODERS[definition]


FILES = "path string, first_id bigint, n_records bigint, n_tokens bigint, n_bytes bigint"


def write(docs: DataFrame, folder: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents below folder, a URI that all executors reach. Returns the table of files (FILES), itself written
    to the shared folder."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encoder, store, place = _encoder(definition.value), None, None
        end = np.array([end_id], encoder.dtype).tobytes()
        if end_id != int(np.frombuffer(end, encoder.dtype)[0]):
            raise ValueError("the end id does not fit")
        offsets, at, first, tokens = [], 0, None, 0
        for batch in batches:
            if store is None and batch.num_rows:
                store, base = filesystem(folder)
                store.create_dir(base, recursive=True)
                place = f"{base}/{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{place}.rec")
                first = batch.column(0)[0].as_py()
            raw, ends = raw_bytes(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                ids = encoder.encode(raw[ends[i] : ends[i + 1]].tobytes()) + end
                record = document(name, ids, encoder.dtype.itemsize)
                out.write(record)
                offsets.append(at)
                at += len(record)
                tokens += len(ids) // encoder.dtype.itemsize
        if store is not None:
            out.close()
            with store.open_output_stream(f"{place}.idx") as index:
                index.write(np.array([*offsets, at], "<u8").tobytes())
            name = f"{folder}/{place.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pylist([{"path": name, "first_id": first, "n_records": len(offsets), "n_tokens": tokens, "n_bytes": at}], _FILES)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return write_through(rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, FILES))


_FILES = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


class Damaged(ValueError):
    """A checksum or a length does not fit."""


def _read_record(stream) -> tuple[int | None, np.ndarray]:
    head = stream.read(12)
    if len(head) != 12 or masked(head[:8]) != _CRC.unpack(head[8:])[0]:
        raise Damaged("length")
    size = _HEAD.unpack(head[:8])[0]
    body = stream.read(size + 4)
    if len(body) != size + 4 or masked(body[:size]) != _CRC.unpack(body[size:])[0]:
        raise Damaged("payload")
    has_id, width, name = _OWN.unpack(body[: _OWN.size])
    return (name if has_id else None), np.frombuffer(body[_OWN.size : size], np.dtype(f"<u{width}"))


def read_file(path: str, positions: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records (id, token ids) of one file: all in file order, or those at the given positions in that order."""
    store, name = filesystem(path)
    if positions is None:
        with store.open_input_stream(f"{name}.idx") as index:
            count = len(index.read()) // 8 - 1
        with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as stream:
            for _ in range(count):
                yield _read_record(stream)
            if stream.read(1):
                raise Damaged("more data than records")
        return
    with store.open_input_file(f"{name}.idx") as index, store.open_input_file(f"{name}.rec") as stream:
        for position in positions:
            index.seek(8 * position)
            stream.seek(_HEAD.unpack(index.read(8))[0])
            yield _read_record(stream)


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Columns doc_id, start (tokens of all documents before), n_tokens, ids_crc32 (CRC-32 of the ids as u32) and n_file
    (place of the file), read from the files. The running sum over files is over one row a file."""
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "path")
    placed = files.select(
        "path",
        (F.row_number().over(order) - 1).cast("bigint").alias("n_file"),
        F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )

    def run(batches):
        for batch in batches:
            for path, n_file, base in zip(*(c.to_pylist() for c in batch.columns)):
                rows, start = [], base
                for name, ids in read_file(path):
                    rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n_file))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    parts = max(1, files.count())
    return placed.repartitionById(parts, F.col("n_file").cast("int")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_file bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_file"])


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for files in the shared folder."""
    return shared_path(spark, "records")
