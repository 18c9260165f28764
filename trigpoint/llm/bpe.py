"""Byte-level BPE encoding and decoding.

Method: the pieces of a text that occur for the first time become rows of padded numpy matrices, dealt by
length. Each round finds the pair of least rank in every row (the leftmost of equals), merges it, and drops
the rows that have no pair left. Pairs are looked up in an open-addressing hash table. Pieces are independent
of each other, so a row's result serves all its occurrences.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, to_bytes

#: What an id that no token has is decoded to.
_UNKNOWN = "\ufffd".encode()
NONE = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pieces that a worker remembers, and the cells of a matrix.
REMEMBERED, CELLS = 100_000, 2_000_000
#: Rows of more bytes than this are merged by a heap, as a round costs time in proportion to a row's length.
LONG = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Merges of a rank file. Ids are ranks; a pair merges if its bytes together have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._fill(np.array(keys, np.uint64), np.array(values, np.int32))
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):  # each round puts one key into each free slot; the others go to the next slot
            self.probes += 1
            free = self.values[at] == NONE
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[left[won]], values[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is none, or where an id is below 0."""
        keys = (a.astype(np.int64) << 32 | b.astype(np.int64)).view(np.uint64).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            found = self.keys[at] == keys[todo]
            out[todo[found]] = self.values[at[found]]
            on = ~found & (self.values[at] != NONE)
            if not on.any():
                break
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(a.shape)

    def encode_rows(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of pieces of at most LONG bytes."""
        out: list[list[int]] = [[]] * len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        width = 1
        while True:
            here = np.flatnonzero((lengths > width // 2 if width > 1 else lengths >= 0) & (lengths <= width))
            step = max(1, CELLS // width)
            for lo in range(0, len(here), step):
                self._merge(rows, here[lo : lo + step], lengths, width, out)
            if width >= (lengths.max() if len(rows) else 0):
                return out
            width *= 2

    def _merge(self, rows: list[bytes], at: np.ndarray, lengths: np.ndarray, width: int, out: list[list[int]]) -> None:
        flat = np.frombuffer(b"".join(rows[i] for i in at), np.uint8)
        live = lengths[at]
        ids = np.full((len(at), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < live[:, None]] = self.byte_id[flat]
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width + 1)
        while True:
            best = ranks.argmin(1)
            least = ranks[np.arange(len(at)), best]
            done = least == NONE
            if done.any():
                for i, row, n in zip(at[done].tolist(), ids[done].tolist(), live[done].tolist(), strict=True):
                    out[i] = row[:n]
                go = ~done
                at, ids, ranks, live, best, least = at[go], ids[go], ranks[go], live[go], best[go], least[go]
                if not len(at):
                    return
                most = int(live.max()) + 1
                ids, ranks, cols = ids[:, :most], ranks[:, : most - 1], cols[:most]
            r = np.arange(len(at))
            take = np.minimum(cols + (cols > best[:, None]), len(cols) - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[r, best] = least
            live = live - 1
            ids[r, live] = -1
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, take[:, :-1].clip(max=len(cols) - 2), 1)
            ranks[:, -1] = NONE
            ranks[r, best] = self.rank(ids[r, best], ids[r, best + 1])
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.rank(ids[before, best[before] - 1], ids[before, best[before]])

    def encode_long(self, piece: bytes) -> list[int]:
        """The same merges for a very long piece: a heap of (rank, place) over a linked list."""
        import heapq

        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (r := self.ranks.get(both := part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (h := prior[i]) >= 0 and (r := self.ranks.get(both := part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(both)))
        return [self.ranks[p] for p in part if p is not None]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
        for i, ids in zip(short, self.encode_rows([pieces[i] for i in short]), strict=True):
            out[i] = ids
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.encode_long(p)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens.get(i, _UNKNOWN) for i in ids])


class Coder:
    """Encodes and decodes texts; remembers the pieces it has met, with their ids as decimal numbers and their bytes."""

    def __init__(self, vocabulary: str, pattern: str):
        self.merges = Merges(read_ranks(vocabulary))
        self.numerals = list(map(str, range(len(self.merges.lengths))))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:  # pieces that have come before and come again stay
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        new = [p for p in pieces if p not in self.known]
        for p, ids in zip(new, self.merges.encode([to_bytes(p) for p in new]), strict=True):
            self.known[p] = ",".join(map(self.numerals.__getitem__, ids)), self.merges.decode(ids)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """Each text's ids, joined by commas, and the bytes that they decode to."""
        found = [self.split(t or "") for t in texts]
        self.learn(set().union(*found))
        for pieces in found:
            ids, decoded = zip(*map(self.known.__getitem__, pieces), strict=True) if pieces else ((), ())
            yield ",".join(ids), b"".join(decoded)


class Counter:
    """Counts the ids of texts by several vocabularies; remembers each piece's numbers of ids, in one integer."""

    def __init__(self, vocabularies: tuple[str, ...], pattern: str):
        self.merges = [Merges(read_ranks(v)) for v in vocabularies]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        new = [p for p in pieces if p not in self.known]
        raw = [to_bytes(p) for p in new]
        found = [m.encode(raw) for m in self.merges]
        for i, p in enumerate(new):
            self.known[p] = sum(len(ids[i]) << 48 * k for k, ids in enumerate(found))

    def count(self, texts: list[str | None]) -> list[list[int]]:
        """For each text its numbers of ids, by vocabulary."""
        split = [self.split(t or "") for t in texts]
        self.learn(set().union(*split))
        sums = [sum(map(self.known.__getitem__, pieces)) for pieces in split]
        return [[x >> 48 * k & (1 << 48) - 1 for k in range(len(self.merges))] for x in sums]


_counters: dict[tuple[tuple[str, ...], str], Counter] = {}


def counter(vocabularies: tuple[str, ...], pattern: str) -> Counter:
    """A worker reads vocabularies once."""
    if (vocabularies, pattern) not in _counters:
        _counters[vocabularies, pattern] = Counter(vocabularies, pattern)
    return _counters[vocabularies, pattern]


_coders: dict[tuple[str, str], Coder] = {}


def coder(vocabulary: str, pattern: str) -> Coder:
    """A worker reads a vocabulary once."""
    if (vocabulary, pattern) not in _coders:
        _coders[vocabulary, pattern] = Coder(vocabulary, pattern)
    return _coders[vocabulary, pattern]


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, vocabulary: str) -> str:
    """Gives each executor a copy of a vocabulary that the driver can read; its name, for SparkFiles: one of its own for each content."""
    data = Path(vocabulary).read_bytes()
    name = f"{xxhash.xxh3_64_hexdigest(data)}-{Path(vocabulary).name}"
    if (spark.sparkContext.applicationId, name) not in _shipped:
        copy = Path(os.path.realpath(tempfile.mkdtemp(prefix="ship-"))) / name  # the driver alone reads it there, and sends it
        copy.write_bytes(data)
        spark.sparkContext.addFile(str(copy))
        _shipped.add((spark.sparkContext.applicationId, name))
    return name


def chunks(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row: the ids of a whole text and their bytes.

    A null text counts as an empty one, which has no ids. Repeated rows and ids are kept as they are; other
    columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    name = ship(docs.sparkSession, vocabulary)

    def run(batches):
        c = coder(SparkFiles.get(name), pattern)
        for b in batches:
            doc_id, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                ids, decoded = zip(*c.encode(texts[lo:hi]), strict=True)
                yield batch(schema, doc_id[lo:hi], [list(map(int, x.split(","))) if x else [] for x in ids], decoded)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, ids array<int>, decoded binary")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text; bytes that aren't UTF-8 become U+FFFD, and so does each id that
    the vocabulary doesn't have, or that is null. Repeated rows are decoded each for itself; an empty table stays empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    name = ship(encoded.sparkSession, vocabulary)

    def run(batches):
        c = coder(SparkFiles.get(name), "")
        for b in batches:
            rows = b.column(1).to_pylist()
            yield batch(schema, b.column(0), [None if x is None else c.merges.decode(x).decode("utf-8", "replace") for x in rows])

    return map_arrow(encoded.select(F.col(id_col).cast("long"), F.col(ids_col)), run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode() gives, without holding a text's ids as a row.

    A null text counts as an empty one: no ids, and the digests of nothing. Repeated rows are digested each for itself; other
    columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    name = ship(docs.sparkSession, vocabulary)

    def run(batches):
        c = coder(SparkFiles.get(name), pattern)
        for b in batches:
            doc_id, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                n, ids_sha, decoded_sha = [], [], []
                for ids, decoded in c.encode(texts[lo:hi]):
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                yield batch(schema, doc_id[lo:hi], n, ids_sha, decoded_sha)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
