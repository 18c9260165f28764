"""Quality rules: a ledger of failure bits and measurements, evaluated once.

Policies are versioned sets of rules; a policy is a mask, so applying another version, or asking what a
version would lose without one of its rules, is bitwise work on the ledger and needs no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, batch, fold, map_arrow, place_of, prepare, to_bytes

WINDOW = 8
#: Rules in the order of their bits; a rule is an SQL condition on the measurements that holds for rows that fail it.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 40 * n_words",
    "capitals": "100 * n_upper > 60 * (n_upper + n_lower) AND n_upper > 20",
    "digits": "2 * n_digits > word_chars",
}
BASE = ("few_words", "repeated_windows")
#: Published versions are never changed; a new one is added.
POLICIES = {"base-1": BASE, "web-1": tuple(RULES)}

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in _MEASURES)])


def _codes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_SYMBOLS, _SPACES, _UPPER, _LOWER, _DIGITS = map(_codes, ("#*$%&|<>", " \t\n\v\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))


def repeated_words(h: np.ndarray, k: int = WINDOW) -> int:
    """Words within k-word windows that the text has twice or more; the first one counts too."""
    if len(h) <= k:
        return 0
    windows = fold([h[i : len(h) - k + 1 + i] for i in range(k)], k)
    _, inverse, seen = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(seen[inverse] > 1)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + k, -1)
    return int((np.cumsum(step) > 0).sum())


def measure(text: str | None, words: WordHash) -> tuple[int, ...]:
    raw = to_bytes(text)
    found = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    count = lambda codes: int(seen[codes].sum())
    return (len(found), len(text or "") - count(_SPACES), count(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words.of(found)), len(lines), count(_UPPER), count(_LOWER), count(_DIGITS))


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in batches:
        rows = [measure(t, words) for t in b.column(1).to_pylist()]
        yield batch(_SCHEMA, b.column(0), *(zip(*rows, strict=True) if rows else [[]] * len(_MEASURES)))


def keep_good(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass a policy, with all their columns.

    A null or empty text has no words and fails few_words alone. Repeated rows are judged each for itself; an empty table stays empty.
    """
    schema, at = docs.schema, place_of(docs, text_col)
    free = next(n for n in (f"measured{'_' * k}" for k in range(len(schema) + 1)) if n.lower() not in {f.name.lower() for f in schema})
    added = T.StructType([*schema.fields, T.StructField(free, T.StructType([T.StructField(m, T.LongType()) for m in _MEASURES]))])

    def run(batches):
        words = WordHash()
        for b in batches:
            rows = [measure(t, words) for t in b.column(at).to_pylist()]
            own = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_MEASURES))], list(_MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, free])

    prepare(docs.sparkSession)
    rows = docs.mapInArrow(run, added)
    return rows.where(failed_bits(f"{free}.").bitwiseAND(mask(POLICIES[policy])) == 0).drop(free)


def failed_bits(prefix: str = ""):
    """The bits of all rules as a column over measurements."""
    out = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        own = re.sub("|".join(_MEASURES), lambda m: prefix + m[0], rule)
        out = out.bitwiseOR(F.when(F.expr(own), F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def mask(rules: tuple[str, ...] | list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failed): every rule's bit for every row.

    A null or empty text has no words and fails few_words alone. Repeated rows are measured each for itself;
    other columns are ignored; an empty table gives an empty ledger.
    """
    rows = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _measures, "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES))
    return rows.withColumn("failed", failed_bits())


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds kept: whether a row of a ledger passes all rules of a policy. Repeated rows are judged each for itself, a column kept is replaced,
    an empty ledger stays empty."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(mask(POLICIES[policy])) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_rows): how many fail a rule, and how many a policy without it would keep too.
    Repeated rows count each; other columns are ignored; of an empty ledger all numbers are 0."""
    own = POLICIES[policy]
    hit = F.col("failed").bitwiseAND(mask(own))
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for r in own:
        sums += [F.count_if(hit.bitwiseAND(mask([r])) != 0).alias(f"failed_{r}"), F.count_if(hit == mask([r])).alias(f"only_{r}")]
    pairs = F.array(*(F.struct(F.lit(policy).alias("policy"), F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only"), F.col("n_rows")) for r in own))
    return rows.agg(*sums).select(F.inline(pairs))
