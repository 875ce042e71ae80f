"""Words and their hashes from Arrow string columns, whole batches at a time with numpy.

Everything works on UTF-8 bytes: the word alphabets used here are fixed by ASCII classes, and every byte of a longer
code point is a word byte, so byte positions never cut a character. Memory is bounded by the slice size, not by the
text: a text longer than a slice is cut at a byte that is in no word and its hashes are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbered(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _GOLDEN)


_BYTE = numbered(256, 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is False for the bytes of the ranges (both ends included), True for all others."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: White space of ASCII separates words; everything else is in a word.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Only digits, lower-case letters and whatever lies beyond ASCII is in a word; A-Z is lowered before.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type.value_type)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer, ends


def spans(buffer: np.ndarray, alphabet: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the buffer; no word crosses one of the sorted positions in breaks."""
    inside = alphabet[buffer]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = breaks[(breaks > 0) & (breaks < len(inside))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _hash_slice(buffer: np.ndarray, alphabet: np.ndarray, breaks: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lowered = LOWER[buffer]
    start, end = spans(lowered, alphabet, breaks)
    up, down = _powers(len(buffer) + 1)
    hashes = np.zeros((1 + len(stems), len(start)), np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[lowered] * up[:-1], out=sums[1:])
        hashes[0] = mix((sums[end] - sums[start]) * down[start])
        for row, size in enumerate(stems, 1):
            longer = np.flatnonzero(end - start > size)
            at = start[longer]
            hashes[row, longer] = mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size))
    return hashes, start, end


def _cut(buffer: np.ndarray, low: int, high: int, alphabet: np.ndarray) -> int:
    """A position after low, at or before low + SLICE_BYTES if a word ends there, where no word is cut."""
    at = low + SLICE_BYTES
    while at < high:
        gap = np.flatnonzero(~alphabet[LOWER[buffer[max(low, at - 4096) : at]]])
        if len(gap):
            return max(low, at - 4096) + int(gap[-1]) + 1
        at += 4096
    return high


def hashed_stems(column, alphabet: np.ndarray, stems: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, hashes, bounds, starts, ends) for slices of whole rows.

    hashes has a row for whole words and one for each number of bytes in stems, for the first so many bytes of each longer
    word (0 for the others). Words of row first + i are those from bounds[i] to bounds[i + 1]; starts and ends are byte
    positions in the row's slice of raw_bytes, counted from the slice's first byte. A-Z is lowered before hashing.
    """
    buffer, offsets = raw_bytes(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= SLICE_BYTES:
            hashes, start, end = _hash_slice(buffer[low:high], alphabet, offsets[first : last + 1] - low, stems)
        else:
            parts, at = [], low
            while at < high:
                to = _cut(buffer, at, high, alphabet)
                h, s, e = _hash_slice(buffer[at:to], alphabet, np.zeros(0, np.int64), stems)
                parts.append((h, s + (at - low), e + (at - low)))
                at = to
            hashes, start, end = (np.concatenate(x, axis=-1) for x in zip(*parts))
        bounds = np.searchsorted(start, offsets[first : last + 1] - low)
        yield first, last, hashes, bounds, start, end
        first = last


def hashed_words(column, alphabet: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """hashed_stems for whole words only, with a plain array of hashes."""
    for first, last, hashes, bounds, start, end in hashed_stems(column, alphabet, ()):
        yield first, last, hashes[0], bounds, start, end


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; fewer words, but not none, are one run."""
    if not len(words):
        return words
    count = max(1, len(words) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(n, len(words))):
            out += words[j : j + count] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    return mix(out)


def gram_counts(column, sizes: tuple[int, ...], bits: int, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets (ascending) of its byte n-grams of all sizes (4 at most) and of its words, and how often
    each occurs. N-grams have the first 2**bits buckets, words the next 2**bits; one last bucket counts words that repeat
    the word before them."""
    buffer, offsets = raw_bytes(column)
    for first, last, words, bounds, _, _ in hashed_words(column, SPACED):
        for i in range(last - first):
            counts = np.zeros((2 << bits) + 1, np.int64)
            own = words[bounds[i] : bounds[i + 1]]
            counts[-1] = np.count_nonzero(own[1:] == own[:-1])
            counts[1 << bits : 2 << bits] = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            low, high = int(offsets[first + i]), int(offsets[first + i + 1])
            for at in range(low, high, SLICE_BYTES):
                piece = buffer[at : min(high, at + SLICE_BYTES + max(sizes) - 1)]
                piece = (LOWER[piece] if lower else piece).astype(np.uint32)
                for size in sizes:
                    count = min(SLICE_BYTES, len(piece) - size + 1)
                    if count <= 0:
                        continue
                    gram = piece[:count].copy()
                    for j in range(1, size):
                        gram |= piece[j : j + count] << np.uint32(8 * j)
                    gram *= np.uint32(0x9E3779B1)
                    gram ^= gram >> np.uint32(15)
                    gram *= np.uint32(0x85EBCA6B + 2 * size)
                    counts[: 1 << bits] += np.bincount(gram >> np.uint32(32 - bits), minlength=1 << bits)
            held = np.flatnonzero(counts)
            yield held.astype(np.int32), counts[held]
