"""Places by postal code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dumps import keep_last


def postal_table(rows: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(country, code, lat, lon, place) of which each key has its last row; added rows come after the others."""
    base = rows.select("country", "code", "lat", "lon", "place", F.struct(F.lit(0).alias("v"), F.col("row_id").alias("r")).alias("row_id"))
    if added is not None:
        base = base.unionByName(added.select("country", "code", "lat", "lon", "place", F.struct(F.lit(1).alias("v"), F.col("row_id").alias("r")).alias("row_id")))
    return keep_last(base, "country", "code").drop("row_id")


def merge_postal(rows: DataFrame) -> DataFrame:
    """The row with the largest row_id of each key, over rows in any order and however often they come; of equal row_ids the largest row."""
    last = rows.groupBy("country", "code").agg(F.max(F.struct("row_id", "place", "lat", "lon")).alias("last"))
    return last.select("last.row_id", "country", "code", "last.place", "last.lat", "last.lon")


def by_postal_code(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(qid, name, country, lat, lon, population) for queries (qid, code, country); population is always 0."""
    hit = queries.select("qid", "code", "country").join(table, ["country", "code"])
    return hit.select("qid", F.col("place").alias("name"), "country", "lat", "lon", F.lit(0).alias("population"))
