"""Token counts: additive totals kept up to date by signed deltas.

Method: an insert adds a row's tokens, a delete takes them away, a revised count adds the difference. A
batch of deltas is summed by source, language and tokenizer version and committed under its id as one folder.
The folder appears by Spark's commit protocol, whole or not at all, so a commit that is repeated, after a lost
driver too, leaves the totals as they are. compact() merges committed batches to one folder of sums, which remembers their
ids; totals are the sums of the newest such folder and of the batches that it doesn't name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import chunks, counter, ship
from .common import batch, map_arrow

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(deltas: DataFrame) -> DataFrame:
    """Rows (kind, source, lang, tokenizer, tokens, old_tokens) as additive ones; kind is insert, delete or revise.

    Null tokens count as 0; null keys are a group of their own; a null or unknown kind adds nothing.
    """
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    change = F.when(F.col("kind") == "insert", tokens).when(F.col("kind") == "delete", -tokens).when(F.col("kind") == "revise", tokens - old).otherwise(0)
    return deltas.select(*KEYS, docs.cast("long").alias("n_docs"), change.cast("long").alias("n_tokens"))


def sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share. One writer at a time; readers may come at any time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = target.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _whole(self, kind: str) -> list[str]:
        """Folders of a kind that were written to their end."""
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("")) if s.isDirectory()]
        return sorted(n for n in names if n.startswith(f"{kind}-") and self.fs.exists(self._path(f"{n}/_SUCCESS")))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest merged folder, and the batches that are in it."""
        found = max(self._whole("base"), key=lambda n: int(n[5:]), default=None)
        if found is None:
            return None, set()
        rows = self.spark.read.schema(f"{SCHEMA}, merged string").parquet(f"{self.path}/{found}")
        return found, {r[0] for r in rows.where("merged IS NOT NULL").select("merged").collect()}  # a row a batch

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        base, merged = self._base()
        return base, merged, [n for n in self._whole("batch") if n not in merged]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch. False if a batch of this id is there already, merged or not; its deltas aren't read then."""
        name = f"batch-{batch_id}"
        _, merged, own = self._state()
        if name in merged or name in own:
            return False
        sums(signed(deltas)).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def _rows(self, base: str | None, own: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in ([base] if base else []) + own]
        rows = self.spark.read.schema(f"{SCHEMA}, merged string").parquet(*paths) if paths else self.spark.createDataFrame([], f"{SCHEMA}, merged string")
        return rows.where("merged IS NULL").drop("merged")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all batches; groups that have no rows left are left out."""
        base, _, own = self._state()
        return sums(self._rows(base, own)).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Merges what was committed since the last time. False if there is nothing to merge. A merge that breaks off changes nothing."""
        base, merged, own = self._state()
        if not own:
            return False
        names = self.spark.createDataFrame([(n,) for n in sorted({*merged, *own})], "merged string")
        rows = sums(self._rows(base, own)).unionByName(names, allowMissingColumns=True)
        at = 1 + max((int(s.getPath().getName()[5:]) for s in self.fs.listStatus(self._path("")) if s.getPath().getName().startswith("base-")), default=0)
        rows.write.mode("overwrite").parquet(f"{self.path}/base-{at}")
        return True

    def vacuum(self) -> None:
        """Deletes merged batches, older merged folders and what broke off. Readers that began before may fail."""
        base, _, own = self._state()
        for s in self.fs.listStatus(self._path("")):
            if s.isDirectory() and s.getPath().getName() not in {base, *own}:
                self.fs.delete(s.getPath(), True)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("words", pa.int64()), ("counts", pa.list_(pa.int64()))])


def count_tokens(docs: DataFrame, vocabularies: dict[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, words, tokens map<version, long>) of every row, by the ids that bpe.encode() gives with each vocabulary.

    A text is split once for all vocabularies. Null and empty texts count 0. Repeated rows are counted each for itself; other
    columns are ignored; an empty table gives an empty result.
    """
    versions, names = list(vocabularies), [ship(docs.sparkSession, v) for v in vocabularies.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tuple(map(SparkFiles.get, names)), pattern)
        for b in batches:
            doc_id, source, lang, texts = (c.to_pylist() for c in b.columns)
            for lo, hi in chunks(texts):
                words = [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts[lo:hi]]
                yield batch(_SCHEMA, doc_id[lo:hi], source[lo:hi], lang[lo:hi], words, own.count(texts[lo:hi]))

    rows = docs.select(F.col(id_col).cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string"))
    rows = map_arrow(rows, run, "doc_id long, source string, lang string, words long, counts array<long>")
    return rows.select("doc_id", "source", "lang", "words", F.map_from_arrays(F.array(*map(F.lit, versions)), "counts").alias("tokens"))
