"""BPE encoding and decoding with a public vocabulary file.

Encoding a piece: its symbols form a doubly linked list, every mergeable
neighbour pair enters a priority queue by merge rank and place, the best pair
is merged and its new neighbours enter; entries whose symbols have changed in
the meantime are stale and skipped.  A piece of n symbols costs O(n log n),
however long it is.  Decoding looks the ids up and concatenates the vocabulary
strings with the separator of the file's decoder.

Pieces repeat, so each task keeps a bounded table of pieces already encoded.
The vocabulary is read once on the driver and broadcast; its size is that of
the file, whatever the corpus.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tables import whole_text

KEPT_BYTES = 48 << 20  # of pieces, and of chunks between white space, per Python worker, by estimate
LONGEST_KEPT = 1024  # longer ones are encoded each time
ROWS_AT_ONCE = 256  # encoded and decoded together, and given back at once
LOW = (1 << 32) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in plain}
    spare = iter(range(0x100, 0x200))
    return [signs[b] if b in signs else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a worker needs of a vocabulary file."""

    strings: list[str]  # by id
    merges: dict[int, int]  # pair of ids (first << 32 | second) -> rank << 32 | id of the merged symbol
    first: list[int]  # id of each byte inside a piece
    final: list[int]  # id of each byte at the end of a piece
    special: dict[str, int]
    pattern: str


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file with word ends, NFC, folded white space and lower case.

    Files that ask for other steps are refused.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], [s["type"] for s in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or level["add_prefix_space"] or level["use_regex"]:
        raise ValueError(f"{path}: not a vocabulary of the supported kind")
    ids, end = model["vocab"], model["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in [*ids.items(), *special.items()]:
        strings[i] = text
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
    signs = byte_alphabet()
    return Vocabulary(strings, merges, [ids[s] for s in signs], [ids[s + end] for s in signs], special, split["pattern"]["Regex"])


def merge_piece(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply all merges to one piece, best rank first, leftmost first among equals.

    Queue entries are (rank << 32) | place.  A rank belongs to one pair only,
    so an entry is stale if the pair at its place has another rank by now.
    """
    n = len(symbols)
    symbols, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    found = merges.get
    queue = []
    for i in range(n - 1):
        merge = found(symbols[i] << 32 | symbols[i + 1])
        if merge is not None:
            queue.append((merge & ~LOW) | i)
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        at = entry & LOW
        after = right[at]
        if after < 0 or symbols[at] < 0:
            continue
        merge = found(symbols[at] << 32 | symbols[after])
        if merge is None or merge >> 32 != entry >> 32:
            continue  # stale: one of the two has been merged already
        symbols[at], symbols[after] = merge & LOW, -1
        right[at] = right[after]
        if right[at] >= 0:
            left[right[at]] = at
            fresh = found(symbols[at] << 32 | symbols[right[at]])
            if fresh is not None:
                heapq.heappush(queue, (fresh & ~LOW) | at)
        if left[at] >= 0:
            fresh = found(symbols[left[at]] << 32 | symbols[at])
            if fresh is not None:
                heapq.heappush(queue, (fresh & ~LOW) | left[at])
    return [s for s in symbols if s >= 0]


class Known(dict):
    """Ids of the texts seen last."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, chunk: str) -> bytes:
        packed = self.encode(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self.held += 200 + 4 * len(chunk) + len(packed)
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 200 + 4 * len(chunk) + len(packed)
            self[chunk] = packed
        return packed


class Encoder:
    """Encodes whole texts; keeps the pieces seen last."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.strings = pa.array(vocabulary.strings, pa.large_string())
        self.piece = regex.compile(vocabulary.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.chunks = Known(self._chunk)
        self.pieces = Known(self._piece)

    def _chunk(self, chunk: str) -> bytes:
        """Ids (int32) of a stretch without white space."""
        return b"".join(map(self.pieces.__getitem__, self.piece.findall(chunk)))

    def _piece(self, piece: str) -> bytes:
        v, raw = self.vocabulary, piece.encode()
        return array("i", merge_piece([*(v.first[b] for b in raw[:-1]), v.final[raw[-1]]], v.merges)).tobytes()

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        chunks = text.split() if text.isprintable() or not regex.search(r"[\x1c-\x1f]", text) else regex.split(r"\s+", text)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of the text as packed int32; strings of special tokens in the text give their ids."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        ids = self.vocabulary.special
        return b"".join(np.int32(ids[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))


@dataclass
class SharedVocabulary:
    """A broadcast vocabulary and the key under which a worker keeps its encoder."""

    value: Broadcast
    key: str

    def encoder(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.key] = Encoder(self.value.value)
        return _ENCODERS[self.key]


_ENCODERS: dict[str, Encoder] = {}


def share_vocabulary(spark: SparkSession, path: str) -> SharedVocabulary:
    return SharedVocabulary(spark.sparkContext.broadcast(read_vocabulary(path)), uuid.uuid4().hex)


def _encoded(texts: pa.Array, shared: SharedVocabulary) -> pa.Array:
    encoder = shared.encoder()
    packed = [encoder.encode(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(lists: pa.Array, shared: SharedVocabulary) -> pa.Array:
    strings, space = shared.encoder().strings, pa.scalar(" ", pa.large_string())
    ends = pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, strings.take(lists.flatten())), space).cast(pa.string())


def in_parts(batches: Iterator[pa.Array], turn: Callable[[pa.Array, SharedVocabulary], pa.Array], shared: SharedVocabulary) -> Iterator[pa.Array]:
    """``turn`` of a few rows at a time: a worker never holds the results of a whole batch."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield turn(batch.slice(at, ROWS_AT_ONCE), shared)


def encode(text: Column, shared: SharedVocabulary) -> Column:
    """Token ids (array of int) of a text column; null and empty texts give an empty array.

    Special tokens are not added; their strings inside a text are recognised.
    Texts are never cut.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_parts(texts, _encoded, shared)

    return run(whole_text(text))


def decode(ids: Column, shared: SharedVocabulary) -> Column:
    """Vocabulary strings of the ids, joined by one space as a file without a decoder has it.

    Null and empty arrays give the empty text.
    """

    @F.arrow_udf(T.StringType())
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_parts(lists, _decoded, shared)

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def _both(texts: pa.Array, shared: SharedVocabulary) -> pa.Array:
    ids = _encoded(texts, shared)
    return pa.StructArray.from_arrays([ids, _decoded(ids, shared)], names=["ids", "decoded"])


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def round_trip(text: Column, shared: SharedVocabulary) -> Column:
    """Struct of the ids of a text and of what they decode to, in one pass through the workers."""

    @F.arrow_udf(ROUND_TRIP)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_parts(texts, _both, shared)

    return run(whole_text(text))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
