"""Byte-level BPE encoding and decoding by a traversal of the prefix trie of distinct words.

Merges are applied in the order of their ranks, and a merge can only use tokens of earlier merges. Two facts follow.

* Whether tokens a, b stay apart when a's bytes are followed by b's depends on the tokens that stand at the border while
  a and b are built: the pair is valid unless some token at a's right edge and some token at b's left edge have a merge
  that comes due while both exist.
* A sequence is an encoding if and only if its neighbours are valid pairs. So the last token of the encoding of a prefix
  is the one token that ends there and goes with the last token of the shorter prefix before it. That last token is all
  the state a prefix needs.

The distinct words of a slice of text, sorted, are their trie in depth-first order: the stack of last tokens is kept for
the prefix that a word shares with the one before, so every shared prefix is worked out once. Word encodings are kept in a
bounded table for each worker process. Which tokens end at a position is read off the trie of the tokens with suffix links, one step
a byte, the longest first.

Defined results: a null text is an empty one, which has no tokens; texts of any length are worked on in pieces cut before a
single blank between words, where no word of the pre-tokenizer is cut; a special token's own text is that token, as the
library has it. One output row for each input row, repeated rows and ids included; other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

PIECE_CHARS = 1 << 19
#: A worker process keeps the encodings of so many words, and of as many met before them: a full table becomes the older one, and
#: words that are met again in the older one are taken over.
KEPT_WORDS = 150_000
_NEVER = 1 << 60

#: Validity of so many token pairs is kept as well.
KEPT_PAIRS = 200_000
#: So many steps to the state of a shorter suffix, too.
KEPT_STEPS = 200_000

# The word pattern of byte-level BPE as its authors published it, with white space, letters and numbers up to
# U+024F spelled out.
_S, _L, _N = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, other = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else other))
        other += b not in printable
    return out


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id."""
    to_byte = {letter: b for b, letter in enumerate(byte_letters())}
    out = {i: bytes(to_byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    for token in spec["added_tokens"]:
        out[token["id"]] = token["content"].encode()
    return [out.get(i, b"") for i in range(max(out) + 1)]


class Decoder:
    """A vocabulary's ids to text: no more than the bytes of each id."""

    def __init__(self, definition: str) -> None:
        self._bytes = token_bytes(json.loads(definition))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self._bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Encoder:
    """One vocabulary, given as the text of a tokenizers file."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take neighbouring text with them are not supported")
        self.bytes = token_bytes(spec)
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(names)})") if names else None
        self._words = re.compile(WORDS)
        self._ids = {self.bytes[i]: i for i in model["vocab"].values()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab, self._rank, self._made = model["vocab"], {}, {}
        for rank, (left, right) in enumerate(merges):
            pair = (vocab[left], vocab[right])
            self._rank[pair] = rank
            self._made[vocab[left + right]] = (rank, *pair)
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._ids = {b: i for b, i in self._ids.items() if i not in self._made or self._stands(i)}
        if any(bytes([b]) not in self._ids for b in range(256)):
            raise ValueError("a byte has no token")
        self._size = [len(b) for b in self.bytes]
        self._build_trie()
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}

    def _build_trie(self) -> None:
        """The trie of the tokens' bytes with suffix links. _goto: state << 8 | byte to the next state (also where a shorter suffix
        goes on, once met); _suffix: the longest token that ends at a state; _shorter: the next shorter token that ends a token."""
        goto: dict[int, int] = {}
        at, count, parents = {}, 1, [0]
        for token in sorted(self._ids):
            state = 0
            for byte in token:
                step = state << 8 | byte
                if step not in goto:
                    goto[step] = count
                    parents.append(step)
                    count += 1
                state = goto[step]
            at[state] = self._ids[token]
        depth = [0] * count
        for state in range(1, count):
            depth[state] = depth[parents[state] >> 8] + 1
        self._goto, self._fail, self._suffix, self._shorter, self._trie_size = goto, [0] * count, [-1] * count, [-1] * len(self.bytes), len(goto)
        for state in sorted(range(1, count), key=depth.__getitem__):
            above, byte = parents[state] >> 8, parents[state] & 255
            while above:
                above = self._fail[above]
                found = goto.get(above << 8 | byte)
                if found is not None:
                    self._fail[state] = found
                    break
            token, other = at.get(state, -1), self._suffix[self._fail[state]]
            self._suffix[state] = other if token < 0 else token
            if token >= 0:
                self._shorter[token] = other

    def _step(self, step: int) -> int:
        """The state of the longest suffix that goes on with the byte."""
        state, byte = step >> 8, step & 255
        while state:
            state = self._fail[state]
            found = self._goto.get(state << 8 | byte)
            if found is not None:
                return found
        return 0

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it is built, each with the rank of the merge that ends it."""
        out, end = [(token, _NEVER)], _NEVER
        while token in self._made:
            rank, *parts = self._made[token]
            token, end = parts[side], rank
            out.append((token, end))
        return out

    def valid(self, a: int, b: int) -> bool:
        right, left = self._right.get(a), self._left.get(b)
        if right is None:
            right = self._right[a] = self._edge(a, 1)
        if left is None:
            left = self._left[b] = self._edge(b, 0)
        rank = self._rank.get
        for x, ends in right:
            for y, stops in left:
                due = rank((x, y))
                # Of equal merges the left one goes first.
                if due is not None and due < ends and due <= stops:
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """Whether the token's bytes are encoded as that token: its halves stand, and nothing comes between them before."""
        rank, left, right = self._made[token]
        for part in (left, right):
            if part in self._made and not self._stands(part):
                return False
        for x, ends in self._edge(left, 1):
            for y, stops in self._edge(right, 0):
                due = self._rank.get((x, y))
                if due is not None and (x, y) != (left, right) and due < min(ends, rank) and due <= min(stops, rank):
                    return False
        return True

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Encodings (ids as 32-bit integers) of words that are sorted by their UTF-8 bytes."""
        valid, pairs, goto, longest, shorter, size = self.valid, self._pairs, self._goto, self._suffix, self._shorter, self._size
        last, states, before = [-1], [0], b""
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        if len(goto) > self._trie_size + KEPT_STEPS:
            for step in list(goto)[self._trie_size :]:
                del goto[step]
        for word in words:
            raw, shared = word.encode(), 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in raw[shared:]:
                step = state << 8 | byte
                state = goto.get(step)
                if state is None:
                    state = goto[step] = self._step(step)
                end += 1
                token = longest[state]
                while end > size[token]:
                    pair = last[end - size[token]] << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = valid(last[end - size[token]], token)
                    if fits:
                        break
                    token = shorter[token]
                last.append(token)
                states.append(state)
            out, end = [], len(raw)
            while end:
                out.append(last[end])
                end -= size[last[end]]
            before = raw
            out.reverse()
            yield array("i", out).tobytes()

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            gap = self._gap.search(text, at + PIECE_CHARS)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    _gap = re.compile(r"(?<=\S) (?=\S)")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. The texts' distinct new words are put through the trie together."""
        if not any(len(text) > PIECE_CHARS for text in texts):
            yield from self._whole(texts)
            return
        for text in texts:
            yield np.concatenate([ids for part in self._parts(text) for piece in self.pieces(part) for ids in self._whole([piece])])

    def _cut(self, text: str) -> list[str]:
        """Words of the pre-tokenizer. A text with characters beyond U+024F goes through the library's own, so that both
        agree on what a letter is."""
        if self._beyond.search(text) is None:
            return self._words.findall(text)
        return [text[a:b] for _, (a, b) in self._before.pre_tokenize_str(text)]

    _beyond = re.compile(r"[^\u0000-\u024f]")
    _before = ByteLevel(add_prefix_space=False, use_regex=True)

    def _parts(self, text: str) -> list[str]:
        return self._split.split(text) if self._split else [text]

    def _whole(self, texts: list[str]) -> Iterator[np.ndarray]:
        kept, special = self._kept, self.special
        split = []
        for text in texts:
            words: list[str] = []
            for part in self._parts(text):
                if part in special:
                    words.append(part)
                else:
                    words += self._cut(part)
            split.append(words)
        new = set(chain.from_iterable(split)).difference(kept)
        if len(kept) + len(new) > KEPT_WORDS:
            self._older, self._kept = kept, {}
            kept, new = self._kept, set(chain.from_iterable(split))
        met = new.intersection(self._older)
        kept.update(zip(met, map(self._older.__getitem__, met)))
        new -= met
        for name, i in special.items():
            kept[name] = array("i", [i]).tobytes()
            new.discard(name)
        order = sorted(new, key=str.encode)
        kept.update(zip(order, self.encode_words(order)))
        for words in split:
            yield np.frombuffer(b"".join(map(kept.__getitem__, words)), dtype=np.int32)


_MADE: dict[tuple[type, str], Encoder | Decoder] = {}


def _shared(kind: type, definition: str) -> Encoder | Decoder:
    """One for each worker process and vocabulary."""
    if (kind, definition) not in _MADE:
        _MADE[kind, definition] = kind(definition)
    return _MADE[kind, definition]


def read_definition(path: str) -> str:
    """A vocabulary file (a few MB), read by the driver and broadcast."""
    filesystem, name = pyarrow.fs.FileSystem.from_uri(path)
    with filesystem.open_input_stream(name) as stream:
        return stream.read().decode("utf-8")


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in slices of about PIECE_CHARS characters; a longer text is a slice by itself."""
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


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and ids (array of int)."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches):
        encoder = _shared(Encoder, definition.value)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                found = list(encoder.encode(texts))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns id_col, ids and text. Null ids are an empty text."""
    definition = encoded.sparkSession.sparkContext.broadcast(read_definition(path))

    def run(batches):
        decoder = _shared(Decoder, definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """digests(decode(encode(docs))) in one pass, so that neither ids nor decoded texts leave the worker: id_col, n_tokens, ids_sha256 and
    decoded_sha256, and with keep_ids the ids."""
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    more = ", ids array<int>" if keep_ids else ""

    def run(batches):
        encoder, decoder = _shared(Encoder, definition.value), _shared(Decoder, definition.value)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                counts, joined, decoded, kept = [], [], [], []
                for ids in encoder.encode(texts):
                    counts.append(len(ids))
                    joined.append(sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                    decoded.append(sha256(decoder.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(joined), pa.array(decoded)]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def digests(decoded: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Token count and checksums of what decode() returns, and the columns named in keep."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        id_col,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
        *keep,
    )
