"""Best-fit decreasing packing of token pieces into sequences of one length.

Pieces are taken longest first, each into the open bin with the least room that still holds it. As bins with the same room are
alike, what is kept of them is how many there are of each room, in a segment tree over the rooms 0 to capacity; the tightest bin
is found from its root in logarithmic time. Pieces of one length go in runs, since a piece's bin stays the tightest
for the next of its length until it's too full, so a plan for any number of pieces is made from their counts by length, of which there are no more
than the capacity. Pieces are then numbered within their length by Spark, and their number tells the run, hence the bin and the place in it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ship
from .common import batch, free_name, map_arrow, staged, to_bytes

CAPACITY, END = 4096, 1
#: Words that a worker remembers, in each of two generations, and bytes of a word that it remembers.
WORDS, LONGEST = 300_000, 40


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Token ids of words, as packed 32-bit numbers; a word has no ASCII white space, at which no token, and nothing that precedes tokens, spans.

    Words of ASCII and of Latin-1 letters are cut up here, as they are their own normal form and fold one character at a time, and
    only their parts go through the library's merges; all other words go through the library whole. Remembers the words of late.
    """

    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        signs = dict.fromkeys(seen) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(seen))}
        self.signs = {b: c for b, c in signs.items() if c is not None}  # bytes that aren't written as the character of the same number
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids(word.decode("utf-8", "replace"))
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if not self._PLAIN.fullmatch(word) or "<|" in word:
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        parts = self._PART.findall(word.lower())
        return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self._part, parts))

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            signs = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
            ids = _packed([t.id for t in self.merges.tokenize(signs)])
            if len(part) <= LONGEST:
                if len(self.parts) >= WORDS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, to_bytes(text).split()))


_words: dict[str, Words] = {}


def words(vocabulary: str) -> Words:
    """A worker reads a vocabulary once."""
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids array<int> if asked for): the token ids of each text and an end, cut only where there are more than
    capacity.

    A null or empty text is an end alone; a text of any length is encoded whole. Repeated rows and ids are kept as they are; other
    columns are ignored; an empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if with_ids else fields[:-1])
    name, tail = ship(docs.sparkSession, vocabulary), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(SparkFiles.get(name))
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = known.of(text) + tail
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32))[: len(schema)])
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, shape)


class Rooms:
    """A segment tree over the rooms 0 to capacity: which of them open bins have. Bins of one room are kept as ranges of numbers."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, to: int) -> None:
        i = self.leaves + room
        while i and self.open[i] != to:
            self.open[i] = to
            i >>= 1
            to = self.open[2 * i] | self.open[2 * i + 1] if i else 0

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.ranges[room].append((first, n))
            self._set(room, 1)

    def tightest(self, least: int) -> int | None:
        """The least room of an open bin that is at least so large."""
        i = self.leaves + least
        if self.open[i]:
            return least
        while i > 1 and (i & 1 or not self.open[i + 1]):  # up until there is something to the right
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        if not self.ranges[room]:
            self._set(room, 0)
        return found


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, n, bin, each, offset): of the pieces of a length those from first on go into bins from bin on, so many each, one
    behind the other from the offset on."""
    rooms, bins, runs = Rooms(capacity), 0, []
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                new = -(-left // (capacity // length))
                rooms.put(capacity, bins, new)
                bins += new
                continue
            bin_, n = rooms.take(room)
            each = room // length
            full = min(n, left // each)
            if not full:
                each, full = left, 1
            runs.append((length, first, full * each, bin_, each, capacity - room))
            rooms.put(room - each * length, bin_, full)
            rooms.put(room, bin_ + full, n - full)
            first, left = first + full * each, left - full * each
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """items with sequence_id and offset: every row has a place in a sequence of at most capacity, without gaps, as best-fit decreasing
    over all rows puts it.

    Lengths from 1 to capacity; others, and null, raise ValueError. Rows of one length change places freely, so repeated rows are packed each for
    itself. Columns of items called sequence_id or offset are replaced. An empty table stays empty.
    """
    items = items.drop("sequence_id", "offset")
    part, nth, before = (free_name(items.schema, n) for n in ("part", "nth", "before"))
    at = items.columns.index(length_col)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for b in batches:
            own = b.column(at).to_pylist()
            places = []
            for n in own:
                places.append(seen.get(n, 0))
                seen[n] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(own), pa.int64()), pa.array(places, pa.int64())], names=[*b.schema.names, part, nth])

    more = T.StructType([*items.schema.fields, T.StructField(part, T.LongType()), T.StructField(nth, T.LongType())])
    rows = staged(map_arrow(items, number, more), "numbered")
    by_part = staged(rows.groupBy(F.col(length_col), part).agg(F.count(F.lit(1)).alias(before)), "lengths")
    odd = ~F.col(length_col).between(1, capacity) | F.col(length_col).isNull()
    if not by_part.where(odd).isEmpty():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = {int(n): int(c) for n, c in by_part.groupBy(length_col).agg(F.sum(before)).collect()}  # as many as the capacity at most
    runs = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 6)
    longer, total = np.zeros(capacity + 2, np.int64), 0
    for n in sorted(counts, reverse=True):
        longer[n] = total
        total += counts[n]
    starts = longer[runs[:, 0]] + runs[:, 1]  # ascending, as runs go from the longest pieces to the shortest

    earlier = F.sum(before).over(Window.partitionBy(length_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select(length_col, part, F.coalesce(earlier, F.lit(0)).alias(before))
    keys = rows[length_col].eqNullSafe(offsets[length_col]) & (rows[part] == offsets[part])
    rows = rows.join(offsets, keys).select(*(rows[c] for c in items.columns), (rows[nth] + offsets[before]).alias(nth))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            g = longer[length] + b.column(b.num_columns - 1).to_numpy()
            run = runs[np.searchsorted(starts, g, "right") - 1] if len(g) else runs[:0]
            j = g - longer[length] - run[:, 1]
            each = np.maximum(run[:, 4], 1)
            out = pa.array(run[:, 3] + j // each, pa.int64()), pa.array(run[:, 5] + j % each * length, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    shape = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_arrow(rows, place, shape)


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, ids, starts): whole sequences of rows that pack() placed, their token ids and where each piece starts. A sequence has no more
    than its capacity of pieces."""
    own = F.sort_array(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.offset").alias("starts"))
