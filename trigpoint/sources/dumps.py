"""Tab-separated dumps of places, postal codes and names of first-level divisions.

A dump is read as lines with their numbers; every line becomes a row with its fields and, if it can't be used,
a reason. Loaders keep the rows without one; skip_report() counts the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.config import check_feature_classes

#: Bytes of a line above which it is skipped.
LONGEST_LINE = 1 << 20
#: Line numbers that a skip report names for each reason.
NAMED = 5
_NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a file: split at line feeds alone, without one carriage return at the end and a BOM at the start.

    Lines are numbered within the blocks that the file is read in; how many lines each block has, a row a block, tells what
    to add.
    """
    block = ("_metadata.file_path", "_metadata.file_block_start")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", *(F.col(c).alias(a) for c, a in zip(block, ("_file", "_start"), strict=True)), F.monotonically_increasing_id().alias("_id"))
    at, offsets = 0, []
    for file, start, first, n in rows.groupBy("_file", "_start").agg(F.min("_id"), F.count(F.lit(1))).orderBy("_file", "_start").collect():
        offsets.append((file, start, at - first + 1))
        at += n
    offsets = spark.createDataFrame(offsets, "_file string, _start long, _add long")
    lines = rows.join(F.broadcast(offsets), ["_file", "_start"]).select((F.col("_id") + F.col("_add")).alias("line_no"), F.col("value").alias("line"))
    return lines.withColumn("line", F.regexp_replace(F.when(F.col("line_no") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")), "\r$", ""))


def _field(fields: Column, i: int) -> Column:
    return F.coalesce(F.get(fields, F.lit(i)), F.lit(""))


def _double(raw: Column) -> Column:
    return F.when(raw.rlike(_NUMBER), raw.try_cast("double"))


def _coordinates(lat: str, lon: str) -> list[tuple[Column, str]]:
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return [
        (F.col(lat).isNull() | F.col(lon).isNull(), "coordinate can't be read"),
        (bad(F.col(lat)) | bad(F.col(lon)) | ~(F.abs(F.col(lat)) <= 90) | ~(F.abs(F.col(lon)) <= 180), "coordinate out of range"),
    ]


def _first(reasons: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, reason in reversed(reasons):
        out = F.when(F.coalesce(test, F.lit(False)), reason).otherwise(out)
    return out


def parse_places(lines: DataFrame, include: list[str] | None = None, exclude_admin: bool = False) -> DataFrame:
    """Rows of a place dump with reason. filtered rows (by class) have the reason `feature class`.

    A population that is empty, no number or too large is 0 and the row stays; a negative one drops it.
    """
    check_feature_classes(include or [])
    f = F.split("line", "\t")
    rows = lines.select(
        F.col("line_no").alias("row_id"), F.octet_length("line").alias("_bytes"), _field(f, 1).alias("name"),
        F.when(_field(f, 3) != "", F.split(_field(f, 3), ",")).otherwise(F.array().cast("array<string>")).alias("alt_names"),
        _field(f, 8).alias("country"), _field(f, 4).alias("_lat"), _field(f, 5).alias("_lon"), _field(f, 6).alias("feature_class"),
        _field(f, 10).alias("admin1_code"), _field(f, 11).alias("admin2_code"), _field(f, 14).alias("_population"),
    )
    rows = rows.withColumns({"lat": _double(F.col("_lat")), "lon": _double(F.col("_lon")), "population": F.coalesce(F.when(F.col("_population").rlike(r"^[+-]?\d+$"), F.col("_population").try_cast("int")), F.lit(0))})
    drop = [(F.col("_bytes") > LONGEST_LINE, "line too long")]
    if include:
        drop.append((~F.col("feature_class").isin(include), "feature class"))
    if exclude_admin:
        drop.append((F.col("feature_class") == "A", "feature class"))
    missing = F.lit(False)
    for c in ("name", "_lat", "_lon", "country"):
        missing = missing | (F.col(c) == "")
    drop += [(missing, "field missing"), *_coordinates("lat", "lon"), (F.col("population") < 0, "population negative")]
    return rows.withColumn("reason", _first(drop)).drop("_bytes", "_lat", "_lon", "_population")


def parse_postal(lines: DataFrame) -> DataFrame:
    """Rows of a postal dump with reason; empty lines have the reason `blank`, which reports leave out; lines of white space are malformed like others."""
    f = F.split("line", "\t")
    names = ("country", "code", "place", "admin_name1", "admin_code1", "admin_name2", "admin_code2", "admin_name3", "admin_code3")
    rows = lines.select(
        F.col("line_no").alias("row_id"), F.octet_length("line").alias("_bytes"), F.col("line").alias("_line"), F.size(f).alias("_n"), *(_field(f, i).alias(n) for i, n in enumerate(names)),
        _double(_field(f, 9)).alias("lat"), _double(_field(f, 10)).alias("lon"), F.coalesce(F.when(_field(f, 11).rlike(r"^[+-]?\d+$"), _field(f, 11).try_cast("int")), F.lit(0)).alias("accuracy"),
    )
    drop = [(F.col("_bytes") > LONGEST_LINE, "line too long"), (F.col("_line") == "", "blank"), (F.col("_n") < 12, "too few fields"), *_coordinates("lat", "lon")]
    return rows.withColumn("reason", _first(drop)).drop("_bytes", "_line", "_n")


def parse_admin1(lines: DataFrame) -> DataFrame:
    f = F.split("line", "\t")
    rows = lines.select(F.col("line_no").alias("row_id"), F.octet_length("line").alias("_bytes"), F.col("line").alias("_line"), _field(f, 0).alias("key"), _field(f, 1).alias("name"))
    drop = [(F.col("_bytes") > LONGEST_LINE, "line too long"), (F.col("_line") == "", "blank"), ((F.col("key") == "") | (F.col("name") == ""), "malformed")]
    return rows.withColumn("reason", _first(drop)).drop("_bytes", "_line")


def kept(parsed: DataFrame, limit: int = 0) -> DataFrame:
    """Rows without a reason; with a limit, the first so many of them in file order."""
    rows = parsed.where("reason IS NULL").drop("reason")
    return rows.orderBy("row_id").limit(limit) if limit > 0 else rows


def keep_last(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key the row that comes last in the file."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "row_id").alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def skip_report(parsed: DataFrame) -> DataFrame:
    """(reason, skipped, first_lines): reasons in the order in which they come up first."""
    bad = parsed.where("reason IS NOT NULL AND reason NOT IN ('blank', 'feature class')")
    # the first few of each reason are found before anything is gathered
    nth = F.row_number().over(Window.partitionBy("reason").orderBy("row_id"))
    first = bad.select("reason", "row_id").withColumn("nth", nth).where(F.col("nth") <= NAMED).groupBy("reason").agg(F.sort_array(F.collect_list("row_id")).alias("first_lines"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("skipped")).join(first, "reason").orderBy(F.col("first_lines")[0])


def class_counts(parsed: DataFrame) -> DataFrame:
    """(seen, kept, by_class, skipped): lines, rows that stay, rows that a class filter dropped, and others."""
    return parsed.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason") == "feature class").alias("by_class"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "feature class")).alias("skipped"))


def load_places(spark: SparkSession, path: str, limit: int = 0, include: list[str] | None = None, exclude_admin: bool = False) -> DataFrame:
    """Raises ValueError if no row can be used, and for unknown classes before it opens the file."""
    check_feature_classes(include or [])
    rows = kept(parse_places(read_lines(spark, path), include, exclude_admin), limit)
    if rows.isEmpty():
        raise ValueError(f"{path} has no place")
    return rows


def load_postal(spark: SparkSession, path: str) -> DataFrame:
    return keep_last(kept(parse_postal(read_lines(spark, path))), "country", "code")


def load_admin1(spark: SparkSession, path: str) -> DataFrame:
    return keep_last(kept(parse_admin1(read_lines(spark, path))), "key")
