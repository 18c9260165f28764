"""URL filters: a sorted digest array.

Method: entries become 64-bit xxhash keys, hashed and sorted by Spark, in files that each executor gets once and its workers map
into memory; a batch of urls is probed by one vectorised binary search, and the full strings behind equal keys are
compared, so a collision of digests never decides. Neither the driver nor a worker holds the list in memory; what it takes of
each executor's disk is its own size and 16 bytes an entry.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, prepare, staged

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words in a host's labels that the default list blocks: gambling, pills, adult pages, adverts, link farms.
WORDS = ("ads", "adult", "adserver", "bet", "bets", "betting", "casino", "clicks", "escort", "gambling", "jackpot", "lottery", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "tracker", "viagra", "warez", "xxx")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both are empty for null and for what has no `://`."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    end = re.search(r"[/?#]", rest[2])
    host, tail = (rest[2], "") if end is None else (rest[2][: end.start()], rest[2][end.start() :])
    return host.translate(_AZ), re.split(r"[?#]", tail, maxsplit=1)[0] if tail.startswith("/") else ""


_KINDS = (("keys", np.uint64), ("bounds", np.int64), ("text", np.uint8))
_KEYED = pa.schema([("key", pa.int64()), ("entry", pa.binary())])
_SIGN = 1 << 63


def _digests(entries: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, entries), np.uint64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [e.encode("utf-8", "surrogatepass") for e in b.column(0).to_pylist()]
        yield batch(_KEYED, (_digests(raw) ^ np.uint64(_SIGN)).view(np.int64), raw)  # signed numbers in the order of the digests


def ship(spark: SparkSession, entries: DataFrame) -> str:
    """Writes a list (one column of strings) as sorted arrays, which every executor gets as files; their name. Nulls and repeats are left out."""
    prepare(spark)
    own = entries.toDF("entry").where("entry IS NOT NULL").select(F.col("entry").cast("string")).distinct()
    rows = staged(map_arrow(own, _keyed, "key long, entry binary"), "entries")
    name = f"digests-{uuid.uuid4().hex}"
    paths = [os.path.join(SparkFiles.getRootDirectory(), f"{name}.{kind}") for kind, _ in _KINDS]
    with open(paths[0], "wb") as keys, open(paths[1], "wb") as bounds, open(paths[2], "wb") as text:
        at = 0
        bounds.write(np.int64(0).tobytes())
        for key, entry in rows.orderBy("key", "entry").toLocalIterator():  # a partition at a time
            at += len(entry)
            keys.write(np.uint64(key + _SIGN).tobytes())
            bounds.write(np.int64(at).tobytes())
            text.write(entry)
    for path in paths:
        spark.sparkContext.addFile(path)
    return name


class DigestArray:
    """Strings as sorted digests, with the strings themselves for confirmation: given ones in memory, or shipped ones mapped."""

    def __init__(self, entries: Iterable[str] = (), shipped: str | None = None):
        if shipped is None:
            own = sorted({e.encode("utf-8", "surrogatepass") for e in entries})
            keys = _digests(own)
            order = np.argsort(keys, kind="stable")
            own = [own[i] for i in order]
            self.keys, self.bounds, self.text = keys[order], np.cumsum([0, *map(len, own)], dtype=np.int64), np.frombuffer(b"".join(own), np.uint8)
        else:
            paths = [(SparkFiles.get(f"{shipped}.{kind}"), dtype) for kind, dtype in _KINDS]
            self.keys, self.bounds, self.text = (np.memmap(p, dtype, "r") if os.path.getsize(p) else np.zeros(0, dtype) for p, dtype in paths)

    def holds(self, probes: list[str]) -> np.ndarray:
        raw = [p.encode("utf-8", "surrogatepass") for p in probes]
        found = np.zeros(len(raw), bool)
        if not len(self.keys) or not raw:
            return found
        h = _digests(raw)
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            found[i] = any(self.text[self.bounds[k] : self.bounds[k + 1]].tobytes() == raw[i] for k in range(lo[i], hi[i]))
        return found


def suffixes(host: str) -> list[str]:
    """A host and the domains above it."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


_SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("listed", pa.bool_())])


def _judge(rules: list[str], shipped: str, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_array, blocked = DigestArray(rules), DigestArray(shipped=shipped)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            probes, owner = [], []
            words, word_owner = [], []
            for i, (host, path) in enumerate(parts):
                for s in suffixes(host):
                    for n in lengths:
                        if len(path) >= n:
                            probes.append(s + path[:n])
                            owner.append((i, len(s)))
                    words.append(s + "/")
                    word_owner.append(i)
                for w in set(re.split(r"[^0-9a-z]+", host)):
                    if w:
                        words.append(w)
                        word_owner.append(i)
            rule: list[tuple[int, int, str] | None] = [None] * len(parts)
            for k in np.flatnonzero(rule_array.holds(probes)).tolist():
                i, n = owner[k]
                best = (len(probes[k]), n, probes[k])
                rule[i] = best if rule[i] is None else max(rule[i], best)
            listed = np.zeros(len(parts), bool)
            listed[[word_owner[k] for k in np.flatnonzero(blocked.holds(words))]] = True
            yield batch(_SCHEMA, b.column(0), [p[0] for p in parts], [p[1] for p in parts], [r and r[2] for r in rule], listed)

    return run


def judge_urls(pages: DataFrame, rules: dict[str, str], blocked: DataFrame | Iterable[str] = WORDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    rules: entries like `example.net/en/` with `allow` or `block`; one fits its host and the hosts below it if
    the url's path starts with the rule's path. The longest wins. A url that no rule fits is blocked if the
    list holds a word of its host (`casino`), or its host or a domain above it (`example.org/`), and is
    allowed else. The list is a table of one column, of any length, or a few strings. Null urls and those without `://` have an empty host and path, no rule, and are allowed.
    Repeated rows are judged each for itself; other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(pages.sparkSession)
    entries = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(w,) for w in blocked], "entry string")
    lengths = sorted({len(r) - r.index("/") for r in rules})
    out = map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")), _judge(sorted(rules), ship(spark, entries), lengths), "page_id long, host string, path string, rule string, listed boolean")
    verdict = F.lit(None).cast("string")
    for verb in ("allow", "block"):
        verdict = F.when(F.col("rule").isin([r for r, v in rules.items() if v == verb]), verb).otherwise(verdict)
    verdict = F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
