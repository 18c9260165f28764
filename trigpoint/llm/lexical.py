"""Ranked lexical search over a two-level quantised index.

Documents are dealt into shards of bounded size. A shard has a list for each term: the documents that hold it, one byte each
for the term's impact there, rounded up, and the exact number of occurrences. An impact doesn't depend on how rare its term is, so
the index can be searched with the weights that the whole corpus gives. Bytes alone bound every document's score on both sides; the
k-th lower bound is then the least that a result can have, and every document whose upper bound reaches it is scored again in exact integers.
A shard's best documents are the only ones of the shard that can be among the best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, batch, map_arrow, prepare, staged, to_bytes

#: What a shard holds at most: bytes of text (a longer text is a shard of its own), and documents, as their places in it are 16-bit numbers.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 1 << 16
#: Bytes of a row group of the index, or one shard. Parquet's writer looks at its size after 100 rows unless told otherwise, and so
#: keeps, as a reader does later, as many whole shards in memory as a task makes.
GROUP_BYTES = 4 << 20
#: Terms of queries that are looked up at a time.
BLOCK_TERMS = 1 << 20
#: Impacts lie below SCALE; a byte of them has STEPS steps.
SCALE, STEPS = 1_000_000, 255
_PATTERN = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased. Null has none."""
    return to_bytes(text).translate(_TERM_BYTES).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact impacts of terms that occur tf times in documents of the length factor m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + (90 * length * n_docs) div n_terms; the product may be beyond 64 bits, the quotient isn't."""
    return np.fromiter((10 + 90 * n * n_docs // n_terms for n in lengths.tolist()), np.int64, len(lengths))


_SHARDS = "ids array<bigint>, lengths binary, terms binary, starts binary, docs binary, bytes binary, counts binary"
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("lengths", "terms", "starts", "docs", "bytes", "counts"))])


def _shard(ids: list, found: list[tuple[np.ndarray, np.ndarray]], lengths: list[int], n_docs: int, n_terms: int) -> pa.RecordBatch:
    n = np.array(lengths, np.int64)
    term = np.concatenate([t for t, _ in found])
    tf = np.concatenate([c for _, c in found])
    doc = np.repeat(np.arange(len(ids)), [len(t) for t, _ in found])
    order = np.argsort(term, kind="stable")
    term, tf, doc = term[order], tf[order], doc[order]
    own, starts = np.unique(term, return_index=True)
    exact = impacts(tf, length_factors(n, n_docs, n_terms)[doc])
    upper = -((-exact * STEPS) // SCALE)
    parts = (n, own, np.append(starts, len(term)).astype(np.int64), doc.astype(np.uint16), upper.astype(np.uint8), tf.astype(np.uint32))  # a text has less than 2 GB
    return batch(_SCHEMA, [ids], *([x.tobytes()] for x in parts))


@dataclass
class Block:
    """Queries that are looked up together: their ids, the distinct terms of all, each one's places among these, and the terms' weights."""

    ids: list
    terms: np.ndarray
    places: list[np.ndarray]
    weights: np.ndarray | None = None


class LexicalIndex:
    """All documents in shards, with how many documents have a term at all, and how many terms these have together."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """Reads docs twice: once, in the JVM, for the numbers that impacts need, and once for the shards, which are written to the shared folder.

        Null and empty texts, and texts of other characters alone, hold no term: they count nowhere and are never found. Repeated
        rows are documents each for itself. Ids are integers, null among them. Other columns are ignored.
        """
        docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        n = F.regexp_count("text", F.lit(_PATTERN))
        n_docs, n_terms = docs.select(n.cast("long").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            ids, found, lengths, size = [], [], [], 0
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = terms(text)
                    if not own:
                        continue
                    if ids and (size + len(text) > SHARD_BYTES or len(ids) == SHARD_DOCS):
                        yield _shard(ids, found, lengths, n_docs, n_terms)
                        ids, found, lengths, size = [], [], [], 0
                    ids.append(doc_id)
                    found.append(np.unique(hashes.of(own), return_counts=True))
                    lengths.append(len(own))
                    size += len(text)
            if ids:
                yield _shard(ids, found, lengths, n_docs, n_terms)

        groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
        return cls(staged(map_arrow(docs, run, _SHARDS), "shards", **groups), n_docs, n_terms)

    def blocks(self, queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
        """Queries with their terms, about BLOCK_TERMS at a time. Rows of the same id are one query; queries without terms are left out."""
        schema = pa.schema([("id", pa.int64()), ("term", pa.int64())])

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for b in batches:
                for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = np.unique(hashes.of(terms(text))).view(np.int64)
                    yield batch(schema, [item] * len(own), own)

        rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        own = staged(map_arrow(rows, split, "id long, term long").groupBy("id").agg(F.collect_set("term").alias("terms")), "queries")
        count = (own.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS + 1
        for i in range(count):
            part = own.where(F.pmod(F.xxhash64("id"), F.lit(count)) == i).orderBy("id").collect()
            if part:
                sets = [np.array(r.terms, np.int64).view(np.uint64) for r in part]
                all_terms = np.unique(np.concatenate(sets))
                yield Block([r.id for r in part], all_terms, [np.searchsorted(all_terms, np.sort(s)) for s in sets])

    def weigh(self, block: Block) -> Block:
        """The weights of a block's terms, from how many documents of all hold them: floor(1000 ln((2N + 2) / (2 df + 1)))."""
        spark = prepare(self.shards.sparkSession)
        wanted = spark.sparkContext.broadcast(block.terms)
        schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(wanted.value), np.int64)
            for b in batches:
                for own, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own, starts = np.frombuffer(own, np.uint64), np.frombuffer(starts, np.int64)
                    at = np.minimum(np.searchsorted(own, wanted.value), len(own) - 1)
                    df += np.where(own[at] == wanted.value, starts[at + 1] - starts[at], 0)
            hit = np.flatnonzero(df)
            yield batch(schema, hit, df[hit])

        df = np.zeros(len(block.terms), np.int64)
        for term, n in map_arrow(self.shards.select("terms", "starts"), run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            df[term] = n
        wanted.unpersist()
        block.weights = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        return block

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item_id, rank, doc_id, score): for each query its k documents of the highest scores above 0, equal ones by ascending id, null last.

        Exact but for 64-bit hashes of terms. Rows of one query id are one query with the terms of all of them; queries without terms,
        and empty tables, give no rows.
        """
        out = None
        shape = f"{id_col} long, doc_id long, score long"
        schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        spark = prepare(self.shards.sparkSession)
        for block in self.blocks(queries, id_col, text_col):
            sent = spark.sparkContext.broadcast(self.weigh(block))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                asked = sent.value
                best: list[list[tuple]] = [[] for _ in asked.ids]
                for b in batches:
                    for i in range(b.num_rows):
                        Shard(b, i, self_counts).search(asked, k, best)
                rows = [(item, doc, score) for item, own in zip(asked.ids, best, strict=True) for score, doc in own]
                yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 3))

            self_counts = self.n_docs, self.n_terms
            part = map_arrow(self.shards, run, shape)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = spark.createDataFrame([], shape)
        rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).select(id_col, "rank", "doc_id", "score")


class Shard:
    """A shard as arrays."""

    def __init__(self, b: pa.RecordBatch, row: int, counts: tuple[int, int]):
        ids = b.column(0)[row].values
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        kinds = (np.int64, np.uint64, np.int64, np.uint16, np.uint8, np.uint32)
        self.lengths, self.terms, self.starts, self.docs, self.bytes, self.counts = (np.frombuffer(b.column(c + 1)[row].as_buffer(), kind) for c, kind in enumerate(kinds))
        self.m = length_factors(self.lengths, *counts)

    def search(self, block: Block, k: int, best: list[list[tuple]]) -> None:
        """Brings the k best documents of each query, as (score, id) in the order of results, up to date with this shard."""
        at = np.searchsorted(self.terms, block.terms)
        at[at == len(self.terms)] = 0
        have = (self.terms[at] == block.terms) & (block.weights > 0)
        lo, hi = self.starts[at], self.starts[at + 1]
        for i, places in enumerate(block.places):
            own = places[have[places]]
            if len(own):
                best[i] = self._one([(int(block.weights[t]), slice(lo[t], hi[t])) for t in own.tolist()], k, best[i])

    def _one(self, lists: list[tuple[int, slice]], k: int, so_far: list[tuple]) -> list[tuple]:
        upper, slack = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for w, s in lists:
            docs = self.docs[s]
            upper[docs] += w * self.bytes[s].astype(np.int64)
            slack[docs] += w
        near = np.flatnonzero(slack)
        upper, lower = upper[near], upper[near] - slack[near]
        least = np.partition(lower, len(near) - k)[len(near) - k] if len(near) > k else lower.min()
        reach = upper >= least
        if len(so_far) == k:  # what earlier shards of this task have found is a bound too
            reach &= SCALE * upper >= STEPS * so_far[-1][0]
        near = near[reach]
        score = np.zeros(len(near), np.int64)
        for w, s in lists:
            docs = self.docs[s]
            p = np.minimum(np.searchsorted(docs, near), len(docs) - 1)
            hit = docs[p] == near
            score[hit] += w * impacts(self.counts[s][p[hit]].astype(np.int64), self.m[near[hit]])
        order = np.lexsort((self.ids[near], self.no_id[near], -score))[:k]
        found = [(int(score[j]), None if self.no_id[near[j]] else int(self.ids[near[j]])) for j in order.tolist() if score[j] > 0]
        return sorted(so_far + found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]
