"""What the operators share: words and their hashes, shared-folder tables, links between rows."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else; bytes above 127 are parts of other characters and stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLE = 5
#: Bounds of an Arrow batch; a single row of more bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this session import the package, and bounds an Arrow batch."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *have] if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a new one of this machine, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))


_written: list[tuple[SparkSession, str]] = []


def cleanup() -> None:
    """Removes the tables that staged() wrote. Results that still read them can't be computed afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session or its JVM has ended
            return


atexit.register(cleanup)


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet, with options for its writer, to the shared folder and reads it again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trigpoint/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHash(dict):
    """64-bit hashes of words. Forgets all of them when there are too many, so that memory stays bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. bytes.split() splits at just these six characters."""
    return to_bytes(text).translate(LOWER).split()


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_29, _32 = np.uint64(29), np.uint64(32)


def fold(parts: Iterable[np.ndarray], start: int) -> np.ndarray:
    """Hashes sequences; parts: the first elements of all, the second ones, and so on."""
    with np.errstate(over="ignore"):
        out = np.uint64(start) * _A
        for x in parts:
            out = (out ^ x) * _B
            out = (out ^ (out >> _29)) * _A
        return out ^ (out >> _32)


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all k-word shingles in order; of fewer words, one for the whole sequence; of none, none."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return np.atleast_1d(fold([h[i : i + 1] for i in range(n)], n))
    return fold([h[i : n - k + 1 + i] for i in range(k)], k)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def place_of(df: DataFrame, column: str) -> int:
    """The place of a column, whatever the case of its name's letters, as Spark resolves it; one that is written alike comes first."""
    if column in df.columns:
        return df.columns.index(column)
    found = [i for i, c in enumerate(df.columns) if c.lower() == column.lower()]
    if len(found) != 1:
        raise ValueError(f"{column} is {'none' if not found else 'more than one'} of the columns {df.columns}")
    return found[0]


def filter_rows(docs: DataFrame, keep: Callable[[], Callable[[list], list]], column: str) -> DataFrame:
    """The rows of docs that pass, with all their columns as they are; keep() makes, in each task, a function from the
    values of a column to booleans."""

    at = place_of(docs, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keep()
        for b in batches:
            yield b.filter(pa.array(judge(b.column(at).to_pylist()), pa.bool_()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


#: Bits of the table of bits_of(), in rows of 32,768 bits: 16 MB at most, whatever it is made from.
BITS, ROW_BITS = 1 << 27, 1 << 15


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(BITS))


def bits_of(table: DataFrame, key: str) -> DataFrame:
    """(bit_row, bits): a bit for the hash of each key of a table, to be sent to all executors.

    The size is fixed. The more keys there are, the more others share their bits, so it can only tell which rows of a
    large table need not be looked up; the rest is joined exactly.
    """
    bit = _bit(F.col(key))
    rows = table.select(F.floor(bit / ROW_BITS).alias("bit_row"), (bit % ROW_BITS).alias("bit"))
    return rows.groupBy("bit_row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_in(rows: DataFrame, key: Column, bits: DataFrame, flag: str) -> DataFrame:
    """Rows with one more column: false if the key is surely not among those that the bits were made from. A null key is in none."""
    bit = F.coalesce(_bit(key), F.lit(0))
    row, byte = F.floor(bit / ROW_BITS), (F.floor(bit / 8) % (ROW_BITS // 8) + 1).cast("int")
    own, held = free_name(rows.schema, "_bit_row"), free_name(rows.schema, "_bits")
    hit = F.conv(F.hex(F.substring(held, byte, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    table = F.broadcast(bits.select(F.col("bit_row").alias(own), F.col("bits").alias(held)))  # BITS / ROW_BITS rows at most
    joined = rows.join(table, row == F.col(own), "left")
    return joined.withColumn(flag, key.isNotNull() & F.coalesce(hit, F.lit(False))).drop(own, held)


def blocks_for(df: DataFrame, megabytes: int = 16) -> int:
    """How many blocks to deal a table into: so many megabytes each by Spark's estimate of its size, and one for each partition of a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(size // (megabytes << 20), 1 << 20))


def free_name(schema, wanted: str) -> str:
    """A column name that a table doesn't have, whatever the case of its letters."""
    have = {f.name.lower() for f in schema}
    return next(n for n in (wanted + "_" * k for k in range(len(have) + 1)) if n.lower() not in have)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def find(parent: np.ndarray | list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def union(parent: np.ndarray | list, a: int, b: int) -> bool:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
    return a != b


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links a-b as connect the same nodes."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = inv.reshape(2, -1)
    parent = list(range(len(nodes)))
    keep = np.fromiter((union(parent, x, y) for x, y in zip(ends[0].tolist(), ends[1].tolist(), strict=True)), bool, ends.shape[1])
    return a[keep], b[keep]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that can be reached.

    Each round hooks every node to its least neighbour, jumps once, and contracts the links; all of it
    by joins and partial aggregates, so a component of any size is spread over the cluster.
    """
    links = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hook = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "hook")
        top = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = staged(hook.join(top, "up", "left").select("node", F.coalesce("top", "up").alias("root")), "jump")
        rounds.append(hook)
        ends = links
        for side in ("a", "b"):
            ends = ends.join(hook.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("root", f"r{side}")
        links = staged(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for more in rounds[1:]:
        later = more.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = staged(found.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")), "found")
    return found
