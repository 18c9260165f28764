"""Language ID by segmentation-marginalised unigrams.

Method: each language has probabilities over the pieces of a fixed public vocabulary. A word's probability in
a language is the sum over all its segmentations, by a forward algorithm over padded matrices of words; a
text's is the product over its words. Probabilities are learned by expectation maximisation from a bounded
number of labelled rows. Beside the languages stands the table that learning starts from, in which a piece weighs as much as it has
bytes: a text that it explains better than every language is in none of them, which keep_known() goes by.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks
from .common import batch, filter_rows, map_arrow, prepare
from .lattice import Lattice, log_table, tiktoken_pieces

#: Labelled rows per language, and rounds of learning.
ROWS, ROUNDS = 300, 3
#: The count that every piece is given besides its own.
FLOOR = 0.05
#: Words and log-probabilities (words x languages) that a worker remembers, and languages that are scored at a time.
REMEMBERED, CELLS, BLOCK = 250_000, 1_000_000, 16
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = _LETTERS.findall((text or "").lower())
    return found if not found or any(map(str.isalpha, found)) else []  # `[^\W\d_]` has a few numerals besides letters


class Model:
    def __init__(self, pieces: list[bytes], samples: dict[str, list[str | None]]):
        self.languages, self.pieces = sorted(samples), pieces
        lattice, tables = Lattice(pieces), []
        for lang in self.languages:
            seen = Counter(w for t in samples[lang] for w in letter_words(t))
            words, weights = [b" " + w.encode() for w in seen], np.array(list(seen.values()), float)
            logp = log_table(np.array([float(len(p)) for p in pieces]), 0)
            for _ in range(ROUNDS):
                logp = log_table(lattice.expected(words, weights, logp), FLOOR) if words else logp
            tables.append(logp)
        self.logp = np.stack(tables, 1) if tables else np.zeros((len(pieces) + 1, 0))

    def with_none(self) -> Model:
        """The same model with one more column, that of no language."""
        out = copy.copy(self)
        out.logp = np.concatenate([self.logp, log_table(np.array([float(len(p)) for p in self.pieces]), 0)[:, None]], 1)
        return out


class Scorer:
    """A worker's words and their log-probabilities."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, model.logp.shape[1]))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities [text, language], and numbers of words."""
        found = [letter_words(t) for t in texts]
        words = set().union(*found)
        if len(self.place) + len(words) > min(REMEMBERED, CELLS // max(1, self.table.shape[1])):
            self.place, self.table = {}, self.table[:0]
        new = [w for w in words if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            own, logp = [b" " + w.encode("utf-8", "surrogatepass") for w in new], self.model.logp
            fresh = [self.lattice.scores(own, logp[:, lo : lo + BLOCK]) for lo in range(0, max(1, logp.shape[1]), BLOCK)]
            self.table = np.concatenate([self.table, np.concatenate(fresh, 1)])
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, own in enumerate(found):
            if own:
                out[i] = self.table[np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))].sum(0)
        return out, np.array([len(own) for own in found])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        names = scorer.model.languages
        for b in batches:
            doc_id, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                total, n = scorer.totals(texts[lo:hi])
                lang, score = ["und"] * (hi - lo), [0.0] * (hi - lo)
                if names:
                    best = total.argmax(1)
                    p = np.exp(total - total.max(1, keepdims=True))
                    p = 1 / p.sum(1)
                    for i in np.flatnonzero(n).tolist():
                        lang[i], score[i] = names[best[i]], float(p[i])
                yield batch(_SCHEMA, doc_id[lo:hi], lang, score)

    return run


def learn(docs: DataFrame, vocabulary: str, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from ROWS rows a language, those with the least hashes of their ids, of rows where train holds.

    Rows without a language, an id or a text are left out. Of rows with the same id and language the one whose text has the
    least hash counts. A model of an empty table knows no language.
    """
    spark = prepare(docs.sparkSession)
    own = docs.where(train).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = own.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.approx_count_distinct("id", 0.02)).collect()  # a row a language
    # hashes below this share of their range hold twice as many rows as are needed, so no task reads a whole language
    shares = spark.createDataFrame([(lang, min(1.0, 2 * ROWS / n)) for lang, n in counts], "lang string, share double")
    low = known.join(F.broadcast(shares), "lang").where(F.xxhash64("id") / 2.0**64 + 0.5 <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = low.select("id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= ROWS).select("id", "lang")
    chosen = spark.createDataFrame(chosen.collect(), "id long, lang string")  # ROWS a language at most
    texts = known.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    samples: dict[str, list[str | None]] = {}
    for lang, text in texts.orderBy("lang", "id").select("lang", "text").toLocalIterator():
        samples.setdefault(lang, []).append(text)
    return Model(tiktoken_pieces(vocabulary), samples)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its share among all, with equal priors.

    Null texts and texts without a letter give `und` and 0, and so does a model without languages. Repeated
    rows are predicted each for itself; other columns are ignored; an empty table gives an empty result. Of
    languages that are equally likely, the first by name is taken.
    """
    spark = prepare(docs.sparkSession)
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _predict(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in one of these languages, or in any that the model knows, with all their columns.

    A text is in its likeliest language, unless it has no letter, or pieces weighed by their length alone make it likelier than
    that language does. Null texts go, and so does all if the model has no languages. Repeated rows are judged each for
    itself; an empty table stays empty.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model.with_none())
    wanted = [i for i, name in enumerate(model.languages) if languages is None or name in languages]

    def keep():
        scorer = Scorer(sent.value)

        def judge(texts: list) -> list:
            out = []
            for lo, hi in chunks(texts):
                total, n = scorer.totals(texts[lo:hi])
                best = total.argmax(1)  # of equals, a language comes before none
                out += [bool(k) and int(b) in wanted for k, b in zip(n, best, strict=True)]
            return out

        return judge

    return filter_rows(docs, keep, text_col)
