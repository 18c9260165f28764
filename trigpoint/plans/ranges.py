"""Numbers for rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, free_name

#: Spark's row ids are a partition's number and, in so many bits, a row's place in it.
_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with each row's place in the order, from 0; equal rows come one after the other in any order.

    Rows are dealt by range, equal ones too, and numbered within their partition; what the partitions before hold, a number for each of
    them, is added. No task has more than its range, whatever the keys.
    """
    tie, at, part, before = (free_name(df, n) for n in ("tie", "at", "part", "before"))
    rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order).drop(tie)
    rows = cut(rows.withColumn(at, F.monotonically_increasing_id()), "ranged")
    counts = sorted(rows.groupBy(F.shiftright(at, _BITS).alias("p")).agg(F.count(F.lit(1))).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} long, {before} long"))  # a row for each partition
    rows = rows.join(offsets, F.shiftright(at, _BITS) == F.col(part))
    return rows.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << _BITS) - 1)).drop(at, part, before)


def dense_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """df with ids 0, 1, ... in the order of columns that no two rows share."""
    return numbered(df, *order, name=name)


def places_among_equals(df: DataFrame, values: list[str], *order: str, name: str = "nth") -> DataFrame:
    """df with each row's place, from 0, among the rows that are equal in values, null being equal to null."""
    pos, first = free_name(df, "pos"), free_name(df, "first")
    rows = cut(numbered(df, *values, *order, name=pos), "numbered")
    firsts = rows.groupBy(*values).agg(F.min(pos).alias(first)).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(values)), first)
    same = [rows[c].eqNullSafe(firsts[f"_{i}"]) for i, c in enumerate(values)]
    joined = rows.join(firsts, same)
    return joined.select(*(rows[c] for c in df.columns), (rows[pos] - firsts[first]).alias(name))
