"""Benchmark decontamination: short test items inside long documents.

Method: MinHash containment search in partitions of items by size, a factor of two each. An item's sketch is its least hashes, as
many of them as the largest item of its partition needs: a document that holds at least `percent` of the n shingles of an
item misses n - ceil(percent n) of them at most, so it holds one of the n - ceil(percent n) + 1 least. The
size of the sketch thus follows from the sizes of items alone and no long document lowers the recall, as it
would with bands over signatures of the same length. Each partition is searched by itself, and only in documents that are long
enough for its smallest item. Pairs that share a hash of a sketch are verified by exact shingle containment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, WordHash, batch, filter_rows, lower_words, map_arrow, prepare, shingle_hashes

#: Characters of items that are sent to the executors at a time.
BLOCK_CHARS = 16_000_000


class Partition:
    """Items of similar sizes: sketches of one length, and where they lead."""

    def __init__(self, items: Items, members: list[int]):
        sizes = [len(items.sets[i]) for i in members]
        self.width, self.least = items.widths[members[0]], min(-(-n * items.percent // 100) for n in sizes)
        sketch = max(n + (-n * items.percent // 100) + 1 for n in sizes)
        keys = [items.sets[i][:sketch] for i in members]
        owner = np.repeat(members, [len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        bits = max(10, (8 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.keys & self.mask).astype(np.int64)] = True

    def near(self, s: np.ndarray) -> set[int]:
        """Items one of whose least hashes is among s."""
        hit = s[self.filter[(s & self.mask).astype(np.int64)]]
        if not len(hit):
            return set()
        lo, hi = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
        return {int(o) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for o in self.owner[a:b]}


class Items:
    """A block of items: their shingles, and partitions of them by size."""

    def __init__(self, items: list[tuple[int, str | None]], percent: int):
        words = WordHash()
        self.percent, self.ids, self.sets, self.widths = percent, [], [], []
        for item_id, text in items:
            h = words.of(lower_words(text))
            if len(h):
                self.ids.append(item_id)
                self.sets.append(np.unique(shingle_hashes(h)))
                self.widths.append(min(len(h), SHINGLE))
        members: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(self.sets):
            members.setdefault((self.widths[i], len(own).bit_length()), []).append(i)
        self.partitions = [Partition(self, members[k]) for k in sorted(members)]

    def search(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the document has) for a document's word hashes. Partitions whose items ask for more shingles than
        the document has words aren't looked at."""
        found, width, s = [], 0, h
        for p in self.partitions:
            if len(h) - p.width + 1 < p.least:
                continue
            if p.width != width:
                width, s, distinct = p.width, shingle_hashes(h, p.width), None
            near = p.near(s)
            if near and distinct is None:
                distinct = np.unique(s)
            for i in sorted(near):
                own = self.sets[i]
                at = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
                shared = int((distinct[at] == own).sum())
                if 100 * shared >= self.percent * len(own):
                    found.append((self.ids[i], len(own), shared))
        return found


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())])


def _search(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = WordHash(), items.value
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in block.search(words.of(lower_words(t)))]
            yield batch(_SCHEMA, *(zip(*rows, strict=True) if rows else [[]] * 4))

    return run


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): documents that hold at least percent of an item's word shingles.

    n_shingles counts an item's distinct shingles of five words; an item of fewer words is one shingle of all
    its words, which a document holds if those words stand in it in a row. Items and documents without words,
    empty and null texts among them, match nothing. Repeated rows on either side give repeated pairs. Other
    columns are ignored. Empty tables give an empty result.

    Items are a query set: they are read in blocks of about BLOCK_CHARS characters, each searched in all documents.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in item_blocks(items, percent, item_col, item_text_col):
        part = map_arrow(docs, _search(block), "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    return out


def item_blocks(items: DataFrame, percent: int = 75, item_col: str = "item_id", item_text_col: str = "text") -> Iterator:
    """Broadcasts of Items, each of about BLOCK_CHARS characters."""
    spark = prepare(items.sparkSession)
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], percent))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Null and empty texts stay, and so do all rows if there are no items with words. Repeated
    rows stay or go together; texts of any length are searched whole; an empty table stays empty."""
    for block in item_blocks(items, percent):

        def keep(block=block):
            words = WordHash()
            return lambda texts: [not block.value.search(words.of(lower_words(t))) for t in texts]

        docs = filter_rows(docs, keep, text_col)
    return docs
