"""LM scoring by a subword lattice.

Method: a text is a sequence of words and one end. A word's lattice has the pieces of a fixed public
vocabulary as arcs, and the whole word as one more arc if training texts have it. Piece weights are learned by
expectation maximisation over all training words, in rounds over the whole corpus until the likelihood settles; a
forward recursion in log space sums all segmentations, and the sums multiply to the marginal probability of the text.

The corpus is dealt by words. Documents send their distinct words with their frequencies, packed into arrays,
to blocks of words; a block counts its words over all documents, scores each word once and sends partial sums
per document to blocks of documents. Words that are in many documents (HOT of them, chosen on a sample, which
decides no result) stay with their documents: only their counts are sent, and their scores come back in one
small table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks_for, lower_words, map_arrow, prepare, staged
from .lattice import Lattice, log_table, sentencepiece_pieces

#: Words that stay with their documents, and documents of the sample that they are chosen on.
HOT, SAMPLE = 1024, 2000
#: Pairs of document and word that a task gathers before it sends them.
FLUSH = 1_500_000
#: Bytes of the longest piece that takes part, which is more than any piece of the vocabulary has; count given to every piece; learning ends when a round gains less (natural logarithm, per training token).
LONGEST, FLOOR, SETTLED = 64, 0.5, 1e-3
#: Bounds of the share that the arc of a whole word has: one less the share of training tokens that occur once.
WHOLE = (0.05, 0.99)
_LN10 = np.log(10)

_ROW = "bucket long, uid long, doc_id long, held_out boolean, n_tokens long, words binary, c binary, docs binary, per_doc binary, w binary, tf binary, once long"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _ROW.split(", ")])


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return batch(_SCHEMA, *(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)))


def _packed(held: list[tuple[int, np.ndarray, np.ndarray]], uniq: list[bytes], count: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A bucket's words, their counts in training, and for each document the words it has and how often."""
    to = np.fromiter(((xxhash.xxh3_64_intdigest(w) >> 17) % buckets for w in uniq), np.int64, len(uniq))
    order = np.argsort(to, kind="stable")
    local = np.empty(len(uniq), np.int64)
    starts = np.searchsorted(to[order], np.arange(buckets + 1))
    local[order] = np.arange(len(uniq)) - starts[to[order]]
    doc = np.repeat(np.arange(len(held)), [len(h[1]) for h in held]) if held else np.zeros(0, np.int64)
    word = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
    tf = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.int64)
    by = np.argsort(to[word], kind="stable")
    doc, word, tf = doc[by], word[by], tf[by]
    cuts = np.searchsorted(to[word], np.arange(buckets + 1))
    uid = np.array([h[0] for h in held], np.int64)
    for b in range(buckets):
        own = order[starts[b] : starts[b + 1]]
        if len(own):
            here = slice(cuts[b], cuts[b + 1])
            used, per_doc = np.unique(doc[here], return_counts=True)
            yield (b, None, None, None, None, b" ".join(uniq[i] for i in own), count[own].tobytes(), uid[used].tobytes(), per_doc.astype(np.uint32).tobytes(), local[word[here]].astype(np.uint32).tobytes(), tf[here].astype(np.uint32).tobytes(), None)


def _deal(hot_words: list[bytes], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = {w: i for i, w in enumerate(hot_words)}
        base = len(hot)
        place: dict[bytes, int] = dict(hot)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        trained: list[bool] = []
        hot_count = np.zeros(base, np.int64)
        pairs = 0

        def flush():
            uniq = list(place)[base:]
            count = np.zeros(len(uniq), np.int64)
            for (_, w, tf), train in zip(held, trained, strict=True):
                if train:
                    count[w] += tf
            rows = list(_packed(held, uniq, count, buckets))
            for lo in range(0, len(rows), 32):
                yield _arrow(rows[lo : lo + 32])

        for b in batches:
            rows = []
            for uid, doc_id, out, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = lower_words(text)
                at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
                at, tf = np.unique(at, return_counts=True)
                k = int(np.searchsorted(at, base))
                if not out:
                    hot_count[at[:k]] += tf[:k]
                # documents are spread by their number, so that no block of documents is large
                rows.append((-1 - (uid % (1 << 33) * 7919 + (uid >> 33)) % buckets, uid, doc_id, out, len(words) + 1, None, None, None, None, at[:k].astype(np.uint16).tobytes(), tf[:k].astype(np.uint32).tobytes(), None))
                held.append((uid, at[k:] - base, tf[k:]))
                trained.append(not out)
                pairs += len(at) - k
                if pairs >= FLUSH:
                    yield from flush()
                    place, held, trained, pairs = dict(hot), [], [], 0
            yield _arrow(rows)
        yield from flush()
        place, held, trained = dict(hot), [], []
        yield from (_arrow([r]) for r in _packed([], hot_words, hot_count, buckets) if base)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Blocks of a bucket of words as one: each word once, with its count over all of them."""
    if table.num_rows == 0 or table.column("bucket")[0].as_py() < 0:
        return table
    place: dict[bytes, int] = {}
    counts, at, docs, per_doc, w, tf = [], [], [], [], [], []
    for row in table.select(["words", "c", "docs", "per_doc", "w", "tf"]).to_pylist():
        own = np.fromiter((place.setdefault(x, len(place)) for x in row["words"].split(b" ")), np.int64)
        at.append(own)
        counts.append(np.frombuffer(row["c"], np.int64))
        docs.append(row["docs"])
        per_doc.append(row["per_doc"])
        w.append(own[np.frombuffer(row["w"], np.uint32)].astype(np.uint32).tobytes())
        tf.append(row["tf"])
    c = np.zeros(len(place), np.int64)
    np.add.at(c, np.concatenate(at), np.concatenate(counts))
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_batches([_arrow([(bucket, None, None, None, int((c > 0).sum()), b" ".join(place), c.tobytes(), *map(b"".join, (docs, per_doc, w, tf)), int((c == 1).sum()))])])


#: The last of the counts is the log-likelihood.
_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


@lru_cache(2)
def _lattice(pieces: tuple[bytes, ...]) -> Lattice:
    """A worker makes it once, as every round and block needs it."""
    return Lattice(list(pieces))


def _expect(pieces, logp):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts, part = _lattice(pieces.value), np.zeros(len(pieces.value) + 1), 0
        for b in batches:
            for bucket, words, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c, words, part = np.frombuffer(c, np.int64), words.split(b" "), bucket
                on = np.flatnonzero(c)
                if len(on):
                    own, fit = lattice.expected_fit([b" " + words[i] for i in on], c[on].astype(float), logp.value)
                    counts += np.append(own, fit)
        yield batch(_COUNTS, [part % 64], [counts.tobytes()])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("counts"))
    return pa.Table.from_batches([batch(_COUNTS, [table.column("part")[0].as_py()], [total.tobytes()])])


def _learn(of_words: DataFrame, own_pieces: list[bytes], pieces, n: int, ends: int) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end, from all training words: n tokens, of them so many ends.

    A round with FLOOR added to its counts can't lower the likelihood times the pieces' probabilities to the power of FLOOR,
    and this is bounded, so the rounds come to an end without a limit on their number.
    """
    send = of_words.sparkSession.sparkContext.broadcast
    logp, log_end, last = log_table(np.array([float(len(p)) for p in own_pieces]), 0), float(np.log(1e-4)), -np.inf
    while ends:
        sent = send(logp)
        parts = map_arrow(of_words.select("bucket", "words", "c"), _expect(pieces, sent), "part int, counts binary")
        sums = parts.groupBy("part").applyInArrow(_add, "part int, counts binary").collect()  # 64 rows at most
        sent.unpersist()
        found = sum((np.frombuffer(r[1], np.float64) for r in sums), np.zeros(len(own_pieces) + 1))
        fit = found[-1] + ends * log_end + FLOOR * logp[:-1].sum()
        counts = found[:-1] + FLOOR
        total = counts.sum() + ends
        logp, log_end = np.append(np.log(counts / total), -np.inf), float(np.log(ends / total))
        if fit - last < SETTLED * n:
            break
        last = fit
    return logp, log_end


class Weights:
    """What scoring needs besides a word's count."""

    def __init__(self, logp: np.ndarray, log_end: float, n: int, v: int, once: int):
        self.logp, self.log_end, self.n, self.v = logp, log_end, n, v
        self.whole = float(np.clip(1 - once / n, *WHOLE)) if n else 0.0

    def words(self, lattice: Lattice, words: list[bytes], c: np.ndarray) -> np.ndarray:
        """log10 of each word's probability: all segmentations, and the arc of the whole word."""
        sub = lattice.scores([b" " + w for w in words], self.logp[:, None])[:, 0] if words else np.zeros(0)
        return self.mixed(sub, c)

    def mixed(self, sub: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            whole = np.log(self.whole * c / max(1, self.n))
        return np.logaddexp(sub + np.log(1 - self.whole), whole) / _LN10


_SUMS = pa.schema([("block", pa.int64()), ("uid", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("score", pa.binary())])


def _sum(pieces, weights, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, own = _lattice(pieces.value), weights.value
        for b in batches:
            for words, c, docs, per_doc, w, tf in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c, docs = np.frombuffer(c, np.int64), np.frombuffer(docs, np.int64)
                score = own.words(lattice, words.split(b" "), c)
                w, tf = np.frombuffer(w, np.uint32), np.frombuffer(tf, np.uint32).astype(float)
                doc, inv = np.unique(np.repeat(docs, np.frombuffer(per_doc, np.uint32)), return_inverse=True)
                sums = [np.bincount(inv, weights=x[w] * tf, minlength=len(doc)) for x in (np.log10(c + 1), (c > 0).astype(float), score)]
                to = (doc % (1 << 33) * 7919 + (doc >> 33)) % buckets
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                for at in np.split(order, cuts) if len(order) else []:
                    yield batch(_SUMS, [-1 - int(to[at[0]])], [doc[at].tobytes()], [sums[0][at].tobytes()], [sums[1][at].astype(np.uint32).tobytes()], [sums[2][at].tobytes()])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(hot, weights, end_count: int):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        c, mixed = hot.value
        own = weights.value
        uid = docs.column("uid").to_numpy()
        order = np.argsort(uid)
        found = np.zeros((3, len(uid)))
        for row in sums.to_pylist():
            at = order[np.searchsorted(uid[order], np.frombuffer(row["uid"], np.int64))]
            for k, (name, kind) in enumerate((("base", np.float64), ("known", np.uint32), ("score", np.float64))):
                found[k, at] += np.frombuffer(row[name], kind)
        log_c = np.log10(c + 1)
        end = np.array([np.log10(end_count + 1), float(end_count > 0), own.mixed(np.array([own.log_end]), np.array([end_count]))[0]])
        for i, (w, tf) in enumerate(zip(docs.column("w").to_pylist(), docs.column("tf").to_pylist(), strict=True)):
            w, tf = np.frombuffer(w, np.uint16), np.frombuffer(tf, np.uint32)
            found[:, i] += end + ([(log_c[w] * tf).sum(), ((c[w] > 0) * tf).sum(), (mixed[w] * tf).sum()] if len(w) else [0, 0, 0])
        n = docs.column("n_tokens").to_numpy()
        base = found[0] - n * np.log10(own.n + own.v + 1)
        return pa.Table.from_batches([batch(_OUT, docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), n, found[1].round().astype(np.int64), np.full(len(n), own.n, np.int64), base, found[2])])

    return run


def lm_scores(docs: DataFrame, vocabulary: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from rows where held_out doesn't hold (null counts as holding). Tokens are words and one end; n_known
    counts those that training rows have. base_score: log10 by single tokens with one added to each count. score: log10 of
    the text's probability by the lattice. Null and empty texts are one end. Repeated rows and ids count as
    often as they occur. Other columns are ignored. Without training rows the pieces keep the weights they
    start with; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    send = spark.sparkContext.broadcast
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    buckets = blocks_for(docs)
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = docs.where("NOT held_out AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(*order).limit(SAMPLE).collect()
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in ids], "doc_id long"))
    once = docs.where("NOT held_out").join(ids, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    seen = Counter()
    for (text,) in once.select("text").toLocalIterator():
        seen.update(set(lower_words(text)))
    hot_words = [w for w, k in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:HOT] if k >= SAMPLE // 40]

    dealt = map_arrow(docs.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "held_out", "text"), _deal(hot_words, buckets), _ROW)
    rows = staged(dealt.groupBy("bucket").applyInArrow(_merge, _ROW), "words")
    of_docs, of_words = rows.where("bucket < 0"), rows.where("bucket >= 0")
    n, ends = of_docs.where("NOT held_out").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    v, once = of_words.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    v += ends > 0

    own_pieces = sentencepiece_pieces(vocabulary, LONGEST)
    lattice, pieces = Lattice(own_pieces), send(tuple(own_pieces))
    logp, log_end = _learn(of_words, own_pieces, pieces, n, ends)
    weights = Weights(logp, log_end, n, v, once)

    # counts of hot words: their rows are those of their buckets
    want = {w: i for i, w in enumerate(hot_words)}
    hot_c = np.zeros(len(hot_words), np.int64)
    for word, c in _counts_of(of_words, hot_words):
        hot_c[want[word]] = c
    hot = send((hot_c, weights.words(lattice, hot_words, hot_c)))
    sent = send(weights)
    partial = map_arrow(of_words.select("words", "c", "docs", "per_doc", "w", "tf"), _sum(pieces, sent, buckets), "block long, uid binary, base binary, known binary, score binary")
    return of_docs.select("bucket", "uid", "doc_id", "held_out", "n_tokens", "w", "tf").groupBy("bucket").cogroup(partial.groupBy("block")).applyInArrow(_finish(hot, sent, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _counts_of(of_words: DataFrame, wanted: list[bytes]) -> list[tuple[bytes, int]]:
    """Counts of a few words."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
    own = frozenset(wanted)

    def run(batches):
        for b in batches:
            for words, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c = np.frombuffer(c, np.int64)
                found = [(w, int(c[i])) for i, w in enumerate(words.split(b" ")) if w in own]
                yield batch(schema, [f[0] for f in found], [f[1] for f in found])

    return [(bytes(r[0]), r[1]) for r in map_arrow(of_words.select("words", "c"), run, "word binary, c long").collect()]
