"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark items.

Texts are normalised by lower-casing A-Z and keeping words of ASCII letters, digits and everything beyond ASCII, joined
by one blank. Each item gives its windows of consecutive words; an item with fewer words than a window, but not none, is
one window. The automaton holds every distinct window framed by blanks, so that it only matches whole words, and one scan
of a text finds all of them. Matches are mapped back to words, and through the words' byte positions to the original
text.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no windows; an item whose
item_id is null marks hits but is not listed; repeated items and repeated windows count once for each item_id; an empty
benchmark marks nothing. Extra columns are ignored. One output row for each input row.

Of a benchmark with more windows than one automaton should hold, Spark deals the windows out to slices in the shared folder; a
task scans its rows with one slice's automaton after the other. Nothing of the benchmark passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, functions as F

from tripweave.session import shared_path, write_through

from .arrow_text import ALNUM, LOWER, raw_bytes, spans
from .records import filesystem

WINDOW = 10
#: Windows of one automaton come from at most about so many characters of items (about 60 bytes of automaton for each byte
#: of a window). A larger benchmark is dealt out to several automata, which scan the texts one after the other.
SLICE_CHARS = 100_000
#: Automata a worker process keeps, and the text that it scans with one before it takes the next.
KEPT_MACHINES, BLOCK_BYTES = 4, 32 << 20
PIECE_BYTES = 1 << 20

_KEEP = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def normal_line(text: bytes) -> bytes:
    """The lower-cased words of a text in UTF-8, each between two blanks; empty without words."""
    plain, words, start = text.translate(_KEEP), [], 0
    while start < len(plain):
        cut = plain.find(b" ", start + PIECE_BYTES)
        end = len(plain) if cut < 0 else cut
        words.append(b" ".join(plain[start:end].split()))
        start = end + 1
    line = b" ".join(w for w in words if w)
    return b" %b " % line if line else b""


def windows(text: bytes, size: int) -> Iterator[bytes]:
    words = normal_line(text).split()
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" ".join(words[i : i + size])


def write_slices(benchmark: DataFrame, id_col: str, text_col: str, size: int, slice_chars: int) -> tuple[str, int]:
    """Write the distinct pairs of item and window, dealt out to slices of bounded text, one folder for each. The driver keeps the
    folder's name and the number of slices. Pairs are dealt by a hash of both, so the items of a window that many share spread too."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.encode(F.col(text_col), "UTF-8").alias("text")).where("text IS NOT NULL")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                found = list(set(windows(text.as_py(), size)))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "window"])

    pairs = write_through(items.mapInArrow(emit, "item string, window binary").distinct())
    size_of = pairs.agg(F.sum(F.octet_length("window") + 1)).first()[0] or 0
    count = math.ceil(size_of / (size * slice_chars))
    folder = shared_path(benchmark.sparkSession, "windows")
    if count:
        dealt = pairs.withColumn("slice", F.pmod(F.xxhash64("window", "item"), F.lit(count)))
        dealt.repartitionByRange(count, "slice").write.partitionBy("slice").parquet(folder)
    return folder, count


def read_slice(folder: str, number: int) -> Iterator[tuple[str | None, bytes]]:
    store, place = filesystem(folder)
    for file in store.get_file_info(pyarrow.fs.FileSelector(f"{place}/slice={number}", allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as stream:
                rows = pyarrow.parquet.ParquetFile(stream).read(["item", "window"])
            yield from zip(rows["item"].to_pylist(), rows["window"].to_pylist())


def automaton(pairs: Iterable[tuple[str | None, bytes]]) -> ahocorasick.Automaton | None:
    """Windows framed by blanks, one byte a character; a window's value is (number of words, items)."""
    found: dict[bytes, set[str | None]] = {}
    for item, window in pairs:
        found.setdefault(window, set()).add(item)
    if not found:
        return None
    machine = ahocorasick.Automaton()
    for window, names in found.items():
        machine.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(n for n in names if n is not None)))
    machine.make_automaton()
    return machine


def scan(machine, line: bytes) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged runs of hit words (first, last + 1) of a normal line, and the items whose windows occur."""
    if machine is None or not line:
        return [], set()
    hits, items = [], set()
    for end, (count, names) in machine.iter(line.decode("latin-1")):
        hits.append((end, count))
        items.update(names)
    if not hits:
        return [], items
    after = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)[1:]  # the blank after word i stands at after[i]
    runs = []
    for end, count in hits:
        last = int(np.searchsorted(after, end)) + 1
        runs.append((last - count, last))
    return _union(runs), items


def word_offsets(text: bytes) -> np.ndarray:
    """Start and end of every word, counted in code points of the original text."""
    raw = np.frombuffer(text, dtype=np.uint8)
    start, end = spans(LOWER[raw], ALNUM, np.zeros(0, np.int64))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.stack([chars[start], chars[end]], axis=1)


_MACHINES: dict[tuple[str, int], object] = {}


def _machine(folder: str, number: int):
    """Built once for each worker process and slice; a worker keeps the last KEPT_MACHINES."""
    if (folder, number) not in _MACHINES:
        while len(_MACHINES) >= KEPT_MACHINES:
            _MACHINES.pop(next(iter(_MACHINES)))
        _MACHINES[folder, number] = automaton(read_slice(folder, number))
    return _MACHINES[folder, number]


def machines(folder: str, count: int) -> Iterator:
    """The automata of all slices, those that the worker still has first."""
    for number in sorted(range(count), key=lambda k: (folder, k) not in _MACHINES):
        yield _machine(folder, number)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about BLOCK_BYTES, so that an automaton scans many of them before the next one takes its place."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held


def _lines(column: pa.Array) -> list[bytes]:
    buffer, offsets = raw_bytes(column)
    return [normal_line(buffer[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]


def hits(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """For each row of docs: id, n_words, spans (start and end in code points of each merged run of hit words), n_hit
    (hit words) and items (sorted ids of items with an occurring window)."""
    key_type = docs.schema[id_col].dataType.simpleString()
    folder, count = write_slices(benchmark, item_col, item_text_col, window, slice_chars)
    schema = f"{id_col} {key_type}, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = [line for batch in block for line in _lines(batch.column(1))]
            runs: list[list[tuple[int, int]]] = [[] for _ in lines]
            items: list[set[str]] = [set() for _ in lines]
            for machine in machines(folder, count):
                for i, line in enumerate(lines):
                    more, names = scan(machine, line)
                    runs[i] += more
                    items[i] |= names
            first = 0
            for batch in block:
                buffer, offsets = raw_bytes(batch.column(1))
                own = slice(first, first + batch.num_rows)
                first += batch.num_rows
                marked, n_hit = [], []
                for k, found in enumerate(runs[own]):
                    found = _union(found)
                    n_hit.append(sum(b - a for a, b in found))
                    at = word_offsets(buffer[offsets[k] : offsets[k + 1]].tobytes()) if found else None
                    marked.append([{"start": int(at[a][0]), "end": int(at[b - 1][1])} for a, b in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([max(0, line.count(b" ") - 1) for line in lines[own]], pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(marked, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x) for x in items[own]], pa.list_(pa.string())),
                    ],
                    names=[id_col, "n_words", "n_hit", "spans", "items"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of docs, all columns, in whose text no benchmark window occurs. Rows with a null or empty text stay."""
    folder, count = write_slices(benchmark, "item_id", "text", window, slice_chars)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = [line for batch in block for line in _lines(batch.column(place))]
            clean = np.ones(len(lines), dtype=bool)
            for machine in machines(folder, count):
                for i in np.flatnonzero(clean):
                    clean[i] = not scan(machine, lines[i])[0]
            first = 0
            for batch in block:
                yield batch.filter(pa.array(clean[first : first + batch.num_rows]))
                first += batch.num_rows

    return docs.mapInArrow(run, docs.schema)
