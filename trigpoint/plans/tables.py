"""Prepared tables: derived once, written as Parquet, read by later sessions; and cuts in long plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Log

#: Written beside the tables; a reader that finds another version asks for a rebuild.
FORMAT = 4
#: What tables are sorted by.
SORTED = {"postal": ("country", "code"), "admin1": ("key",), "names": ("country", "name"), "grams": ("country", "gram"), "cubes": ("level", "parent"), "leaves": ("cube",), "prefixes": ("country", "prefix"), "gram_counts": ("country", "gram")}


_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and the master is local, as in tests, a new folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. cleanup() removes what is written there, and so does the end of the driver."""
    path = f"{shared_dir(spark)}/places/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Removes what stands in places of scratch(). Results that still read them can't be computed afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session or its JVM has ended
            return


atexit.register(cleanup)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that a table doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    return next(n for n in ("_" + wanted + "_" * k for k in range(len(have) + 1)) if n.lower() not in have)


def _content(spark: SparkSession, path: str) -> list[int]:
    """Files of a table, their bytes, and a checksum over the names and the content of all."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return list(files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(name, "length", F.crc32("content"))), F.lit(0))).first())


def save(tables: dict[str, DataFrame], path: str) -> int:
    """Writes a generation of tables in a folder of its own, and names it in the log when all of it is there; gives its number.

    A build that stops on the way leaves the generation before it as it was, and readers that have one open stay with it. Tables are written
    sorted, so that row groups cover ranges and lookups skip the others.
    """
    spark = next(iter(tables.values())).sparkSession
    log, folder = Log(spark, f"{path}/_log"), f"gen-{uuid.uuid4().hex}"
    version, _ = log.read()
    meta = {}
    for name, df in tables.items():
        keys = SORTED.get(name)
        out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        out.write.parquet(f"{path}/{folder}/{name}")
        meta[name] = _content(spark, f"{path}/{folder}/{name}")
    return log.commit(version, {"format": FORMAT, "folder": folder, "tables": meta})


def load(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of the last whole generation. Raises ValueError if there is none, if it has another format, or if a byte of its files isn't
    as it was written, which verify=False doesn't look for."""
    version, meta = Log(spark, f"{path}/_log").read()
    if not version:
        raise ValueError(f"{path} has no build")
    if meta["format"] != FORMAT:
        raise ValueError(f"{path} has format {meta['format']}, not {FORMAT}: build it again")
    out = {}
    for name, content in meta["tables"].items():
        if verify and _content(spark, f"{path}/{meta['folder']}/{name}") != content:
            raise ValueError(f"{name} isn't what was written: build it again")
        out[name] = spark.read.parquet(f"{path}/{meta['folder']}/{name}")
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes the folders of all but the last generations, and of builds that stopped; none of them may be read any more. Gives their number."""
    log = Log(spark, f"{path}/_log")
    kept = {log.at(v)["folder"] for v in log.versions()[-keep:]}
    gone = [f for f in log.folders(path) if f.startswith("gen-") and f not in kept]
    for folder in gone:
        log.remove(f"{path}/{folder}")
    return len(gone)
