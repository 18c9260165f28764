"""Request metrics, load-test summaries, fingerprints of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duration
from ..plans.ranges import places_among_equals
from ..plans.tables import cut

#: Upper bounds of the latency histogram in seconds.
BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def outcome(status: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(status.between(200, 299), "served").when(status == 404, "not_found").otherwise("failed")


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("path", "status").agg(F.count(F.lit(1)).alias("requests"))


def histogram(log: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Per path cumulative counts up to each bound, all of them, and their sum."""
    s = F.col(seconds)
    return log.groupBy("path").agg(*(F.count_if(s <= b).alias("le_" + str(b).replace(".", "_")) for b in BOUNDS), F.count(F.lit(1)).alias("le_inf"), F.sum(s).alias("sum_seconds"))


def _g(x: Column) -> Column:
    """A number as text without a fraction that is zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def exposition(counts: DataFrame, durations: DataFrame | None = None, gauges: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """(line) of the text format, in order: request counts by path and status, then histograms by path, gauges and counters.

    counts: of request_counts(); durations: of histogram(); gauges and counters: (name, value), in the order of their names.
    """
    quoted = F.concat(F.lit('"'), F.regexp_replace("path", r'(["\\])', r"\\$1"), F.lit('"'))
    spark = counts.sparkSession
    parts: list[DataFrame] = []

    def head(k: int, *lines: str) -> None:
        parts.append(spark.createDataFrame([(k, "", i, x) for i, x in enumerate(lines)], "part int, key string, i int, line string"))

    head(0, "# HELP http_requests_total Completed HTTP requests.", "# TYPE http_requests_total counter")
    line = F.concat(F.lit("http_requests_total{path="), quoted, F.lit(',status="'), F.col("status").cast("string"), F.lit('"} '), F.col("requests").cast("string"))
    parts.append(counts.select(F.lit(1).alias("part"), F.col("path").alias("key"), F.col("status").cast("int").alias("i"), line.alias("line")))
    if durations is not None:
        name = "http_request_duration_seconds"
        head(2, f"# HELP {name} Handler latency by route.", f"# TYPE {name} histogram")
        rows = [(f'{name}_bucket{{path=%s,le="{b:g}"}} ', F.col("le_" + str(b).replace(".", "_"))) for b in BOUNDS]
        rows += [(f'{name}_bucket{{path=%s,le="+Inf"}} ', F.col("le_inf")), (f"{name}_sum{{path=%s}} ", F.col("sum_seconds")), (f"{name}_count{{path=%s}} ", F.col("le_inf"))]
        lines = F.array(*(F.concat(F.format_string(start, quoted), _g(value)) for start, value in rows))
        parts.append(durations.select(F.lit(3).alias("part"), F.col("path").alias("key"), F.posexplode(lines).alias("i", "line")))
    for k, kind, own in ((4, "gauge", gauges), (5, "counter", counters)):
        if own is not None:
            lines = F.array(F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}")), F.concat("name", F.lit(" "), _g(F.col("value"))))
            parts.append(own.select(F.lit(k).alias("part"), F.col("name").alias("key"), F.posexplode(lines).alias("i", "line")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy("part", "key", "i").select("line")


def nearest_ranks(values: DataFrame, key: str, value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, and a column for each share): of the whole numbers of each key the least one that is at least as large as the share of them, a fraction of two
    whole numbers. Null values and keys don't count.

    Selected by passes over 16 bits each, the leading ones first: counts by these bits tell which of them the rank has, and the next pass reads those values alone.
    No more than 65,536 counts a key and share are together at once, however many different values there are.
    """
    rows = values.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).where("v IS NOT NULL AND k IS NOT NULL")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    rows = rows.withColumn("v", F.col("v") - F.lit(low or 0))
    bits = max(1, ((high or 0) - (low or 0)).bit_length())
    share = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, (a, b) in shares.items())))
    asked = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", "n", share.alias("s"))
    asked = asked.select("k", "s.name", F.lit(0).cast("long").alias("prefix"), F.greatest(F.lit(1), F.floor((F.col("n") * F.col("s.a") + F.col("s.b") - 1) / F.col("s.b"))).cast("long").alias("rank"))
    for shift in range((bits - 1) // 16 * 16, -1, -16):
        left = rows.select("k", F.shiftright("v", shift + 16).alias("prefix") if shift < 48 else F.lit(0).cast("long").alias("prefix"), F.shiftright("v", shift).bitwiseAND(0xFFFF).alias("digit"))
        left = left.join(asked.select("k", "prefix").distinct(), ["k", "prefix"], "left_semi").groupBy("k", "prefix", "digit").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("k", "name").orderBy("digit"))
        hit = asked.join(left, ["k", "prefix"]).withColumn("upto", upto).where("rank <= upto AND rank > upto - n")
        asked = cut(hit.select("k", "name", (F.shiftleft("prefix", 16) + F.col("digit")).alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "ranks")
    return asked.groupBy(F.col("k").alias(key)).agg(*(F.max(F.when(F.col("name") == name, F.col("prefix") + F.lit(low or 0))).alias(name) for name in shares))


def sweep(samples: DataFrame, window_s: float) -> DataFrame:
    """Per step: outcomes, achieved rate, share of errors, and percentiles by nearest rank over served requests."""
    served = F.col("outcome") == "served"
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = samples.groupBy("step").agg(
        F.count(F.lit(1)).alias("scheduled"), n("served").alias("served"), n("not_found").alias("not_found"), n("failed").alias("failed"), n("dropped").alias("dropped"),
        (n("served") / F.lit(float(window_s))).alias("achieved"), ((n("failed") + n("dropped")) / F.count(F.lit(1))).alias("error_share"), F.max(F.when(served, F.col("latency_ns"))).alias("slowest"),
    )
    ranks = nearest_ranks(samples.where(served), "step", "latency_ns", {name: (round(1000 * p), 1000) for name, p in PERCENTILES.items()})
    same = counts["step"].eqNullSafe(ranks["step"])
    return counts.join(ranks, same, "left").select(*(counts[c] for c in counts.columns[:-1]), *(ranks[c] for c in PERCENTILES), counts["slowest"])


def fingerprint(places: DataFrame) -> DataFrame:
    """(rows, sum): equal for tables of the same rows in any order. The sum wraps, by splitting it in two."""
    h = F.xxhash64("name", "country", "lat", "lon", "population")
    return places.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftright(h, 32)).alias("high"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): how many rows one table has more than the other, counting repeated rows."""
    return a.exceptAll(b).select(F.lit("left").alias("side")).unionAll(b.exceptAll(a).select(F.lit("right").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


def remap(old: DataFrame, new: DataFrame, values: list[str], id_col: str = "row_id") -> DataFrame:
    """(old_id, new_id): which row of a new table is a row of an old one, by their values; equal rows in the order of their ids.

    Null is a value like others. Raises ValueError, with one differing row, if a row of either table has none in the other. Equal rows are
    numbered on both sides by ranges, so that no task has all of a value that a third of all rows share, and values and numbers are joined one to one.
    """
    a = places_among_equals(old.select(id_col, *values), values, id_col, name="_nth").withColumnRenamed(id_col, "old_id")
    b = places_among_equals(new.select(id_col, *values), values, id_col, name="_nth")
    b = b.select(F.col(id_col).alias("new_id"), *(F.col(c).alias(f"_new_{c}") for c in values), F.col("_nth").alias("_new_nth"))
    same = [a[c].eqNullSafe(b[f"_new_{c}"]) for c in values]
    both = cut(a.join(b, [*same, a["_nth"] == b["_new_nth"]], "full").withColumn("_side", F.when(F.col("_new_nth").isNull(), "old").when(F.col("_nth").isNull(), "new")), "remap")
    odd = both.where(F.col("_side").isNotNull()).first()
    if odd is not None:
        row = {c: odd[c] if odd["_side"] == "old" else odd[f"_new_{c}"] for c in values}
        raise ValueError(f"the {odd['_side']} table alone has {row}")
    return both.select("old_id", "new_id")


#: Fixed value: the CRC-64 polynomial of ECMA-182, its highest term left out.
POLYNOMIAL = 0x42F0E1EBA9EA3693


def _times(x: int, y: int) -> int:
    """The product of polynomials over GF(2), modulo the CRC's."""
    out = 0
    while y:
        out ^= x if y & 1 else 0
        x = (x << 1 ^ (POLYNOMIAL | 1 << 64)) if x >> 63 else x << 1
        y >>= 1
    return out


def _shift(rows: int) -> int:
    """x to the power of 64 for each row."""
    out, power = 1, _times(1 << 32, 1 << 32)
    while rows:
        out = _times(out, power) if rows & 1 else out
        power, rows = _times(power, power), rows >> 1
    return out


def _crc(words: np.ndarray) -> int:
    """The CRC of 64-bit numbers: neighbours are put together, then pairs of them, and so on."""
    if not len(words):
        return 0
    factor = _shift(1)
    while len(words) > 1:
        words = np.concatenate([np.zeros(len(words) % 2, np.uint64), words])  # zeros in front change nothing
        left, right = words[::2], words[1::2].copy()
        for bit in range(64):  # left times factor, a bit of left at a time
            term = np.uint64(_times(1 << bit, factor))
            right ^= np.where(left >> np.uint64(bit) & np.uint64(1), term, np.uint64(0))
        words, factor = right, _times(factor, factor)
    return int(words[0])


def ordered_fingerprint(rows: DataFrame, order: list[str], values: list[str]) -> tuple[int, int]:
    """(rows, CRC-64) of a table in an order: the same on any number of partitions, another one if two different rows change places.

    Each partition of the ordered table gives the CRC of the hashes of its rows; these are put together by multiplication of polynomials: what
    comes before n rows is multiplied by x to the power of 64 n. Null values count. Rows that are equal in `order` stand by their values. An empty table has (0, 0).
    """
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = crc = 0
        for b in batches:
            words = b.column(0).to_numpy().view(np.uint64)
            n, crc = n + len(words), _times(crc, _shift(len(words))) ^ _crc(words)
        if n:
            out = TaskContext.get().partitionId(), n, crc - (1 << 64) if crc >> 63 else crc
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in out], schema=schema)

    hashed = F.xxhash64(*(x for c in values for x in (F.col(c).isNull(), F.col(c)))).alias("h")
    keys = list(dict.fromkeys([*order, *values]))
    parts = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).select(hashed).mapInArrow(run, "part long, n long, crc long")
    total = crc = 0
    for _, n, own in sorted(parts.collect()):  # a row for each partition
        total, crc = total + n, _times(crc, _shift(n)) ^ (own % (1 << 64))
    return total, crc


def sweep_table(steps: DataFrame, window_s: float) -> DataFrame:
    """(step, line): a sweep as lines of a table, a heading first (step null). Columns are as wide as what stands in them."""
    rounded = lambda c: duration(F.when(F.col(c) >= 1_000_000_000, F.round(F.col(c) / 1e6) * 1e6).when(F.col(c) >= 1_000_000, F.round(F.col(c) / 1e4) * 1e4).otherwise(F.round(F.col(c) / 1e3) * 1e3).cast("long"))
    cells = {
        "offered/s": F.format_string("%.0f", F.col("scheduled") / float(window_s)), "achieved/s": F.format_string("%.1f", F.col("achieved")), "err%": F.format_string("%.2f", 100 * F.col("error_share")), "dropped": F.col("dropped").cast("string"),
        "404s": F.col("not_found").cast("string"), **{name: F.coalesce(rounded(c), F.lit("0s")) for name, c in (("p50", "p50"), ("p90", "p90"), ("p99", "p99"), ("p99.9", "p999"), ("max", "slowest"))},
    }
    rows = steps.select("step", F.array(*cells.values()).alias("cells"))
    head = steps.sparkSession.createDataFrame([(None, list(cells))], "step int, cells array<string>")
    rows = rows.select(F.col("step").cast("int").alias("step"), "cells").unionByName(head)
    width = rows.agg(*(F.max(F.length(F.col("cells")[i])) for i in range(len(cells)))).first()
    return rows.select("step", F.concat(*(F.lpad(F.col("cells")[i], w + 2, " ") for i, w in enumerate(width))).alias("line"))


def sweep_json(steps: DataFrame) -> DataFrame:
    """(step, body): each step of a sweep as a JSON object."""
    return steps.select("step", F.to_json(F.struct(*steps.columns)).alias("body"))


def place_line(name: str = "name", country: str = "country", lat: str = "lat", lon: str = "lon", population: str = "population") -> Column:
    """A place as a transcript writes it; `nil` where there is none."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(F.col(name).isNull(), "nil").otherwise(F.concat_ws("|", quote(name), quote(country), F.format_string("%.9f", lat), F.format_string("%.9f", lon), F.col(population).cast("string")))


def transcript(answers: DataFrame, key: str, line: Column) -> DataFrame:
    """One line of text a query, in the order of their keys."""
    return answers.orderBy(key).select(line.alias("value"))


def lookup_line(kind: str, asked: str, country: str, place: Column) -> Column:
    """A line of a transcript for a name or a postal code: what was asked, and what was found."""
    return F.concat(F.lit(f'{kind} "'), F.col(asked), F.lit('" '), F.col(country), F.lit(" -> "), place)


def prefix_lines(found: DataFrame) -> DataFrame:
    """(qid, names) of answers (qid, rank, name, ...): the names of each prefix in their order, as a transcript writes them."""
    rows = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("own"))  # a prefix has a limited number of names
    return rows.select("qid", F.concat_ws("", F.transform("own", lambda x: F.concat(F.lit('"'), x["name"], F.lit('";')))).alias("names"))
