"""Requests: validation, normalisation, batches and responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import round2
from ..functions.text import trimmed

LONGEST_NAME, MOST_POINTS = 200, 100
POINT = "lat double, lon double, rank string, include string"


def point_error(of: Callable[[str], Column] = F.col) -> Column:
    """What is wrong with a point (lat, lon, rank, include), or null. Missing rank and include are fine. of: where its fields are."""
    finite = lambda c: of(c).isNotNull() & ~F.isnan(of(c)) & (F.abs(of(c)) < float("inf"))
    return (
        F.when(~finite("lat"), "lat").when(~finite("lon"), "lon").when(F.abs(of("lat")) > 90, "lat range").when(F.abs(of("lon")) > 180, "lon range")
        .when(~F.coalesce(of("rank"), F.lit("")).isin("", "distance", "population"), "rank").when(~F.coalesce(of("include"), F.lit("")).isin("", "admin"), "include")
    )


def name_request(name: Column, country: Column) -> tuple[Column, Column, Column]:
    """(name, country, error) as a lookup takes them: trimmed, the country in upper case."""
    n, c = trimmed(F.coalesce(name, F.lit(""))), F.upper(trimmed(F.coalesce(country, F.lit(""))))
    return n, c, F.when(n == "", "name").when(F.length(n) > LONGEST_NAME, "name length").when(c == "", "country")


def prefix_limit(raw: Column, default: int = 10, most: int = 50) -> tuple[Column, Column]:
    """(limit, error) of a limit as text."""
    value = F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("int"))
    out = F.when(F.coalesce(raw, F.lit("")) == "", default).otherwise(value)
    return out, F.when(out.isNull() | ~out.between(1, most), "limit")


def postal_request(code: Column, country: Column) -> tuple[Column, Column, Column]:
    """(code, country, error) as a lookup takes them: trimmed, white space within the code kept, the country in upper case."""
    k, c = trimmed(F.coalesce(code, F.lit(""))), F.upper(trimmed(F.coalesce(country, F.lit(""))))
    return k, c, F.when(k == "", "code").when(c == "", "country")


#: Fields of a point, and the kinds of JSON values that they take besides null.
_KINDS = {"lat": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$", "lon": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$", "rank": "^STRING$", "include": "^STRING$"}


def _strict(body: Column) -> Column:
    """The body as a variant if it is one JSON document and nothing else, or null. A parser may stop after the first document,
    so it has to be one both as the only element of an array and as the only value of an object."""
    element = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    value = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"b":'), body, F.lit("}"))), "$.b", "variant")
    return F.when(F.size(element) == 1, value)


def _entries(v: Column) -> Column:
    """(lower-case key, value) of an object; no entries of null; null of anything else. Keys are matched whatever their case."""
    own = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    own = F.transform(own, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:variant>>")
    return F.when(F.schema_of_variant(v) == "VOID", none).when(F.schema_of_variant(v).startswith("OBJECT"), own)


def _last(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def parse_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, idx, lat, lon, rank, include, error) of batches (batch_id, body): JSON objects of 1 to 100 points.

    A batch is one row with idx -1 and error `body` if it is null, isn't a single JSON document, holds a key twice, an unknown field, a
    value of a wrong kind or a number without a place among doubles, or has no points or too many. Points that can be read but not used have an error of
    their own.
    """
    return read_batches(batches).drop("failed")


#: A point as it is mostly written, of which nothing has to be asked but its values: fields once each and in their order, numbers that are the same doubles however they
#: are read, and names. A body of such points is read by its schema; any other is taken apart as a variant, field by field, which takes some hundred times as long.
_NUMBER = r"(?!-0(?:\.0*)?[,} ])-?(?:0|[1-9][0-9]{0,2})(?:\.[0-9]{1,20})?"
_POINT = r'\{"lat": ?' + _NUMBER + r', ?"lon": ?' + _NUMBER + "".join(rf'(?:, ?"{name}": ?"[a-z]*")?' for name in ("rank", "include")) + r"\}"
_MARK = "\x01"  # isn't JSON


def _plain(body: Column) -> Column:
    """Whether a body is 1 to MOST_POINTS such points and nothing else."""
    rest = F.regexp_replace(body, _POINT, _MARK)
    return F.coalesce(rest.rlike(rf'^\{{"points": ?\[{_MARK}(?:, ?{_MARK}){{0,{MOST_POINTS - 1}}}\]\}}\z') & ~body.contains(_MARK), F.lit(False))


def read_batches(batches: DataFrame) -> DataFrame:
    """As parse_batches(), with failed: the idx of the first point of the batch that has an error, or null. Each batch is looked at by itself, once."""
    plain = F.col("plain")
    rows = batches.select("batch_id", "body", _plain(F.col("body")).alias("plain")).withColumn("top", F.when(~plain, _entries(_strict(F.col("body")))))
    rows = rows.withColumns({"alone": F.forall("top", lambda e: e["key"] == "points"), "entries": F.try_variant_get(_last(F.col("top"), "points"), "$", "array<variant>")})
    rows = rows.withColumn("entries", F.transform("entries", _entries))

    def fits(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        out = F.lit(False)
        for name, pattern in _KINDS.items():
            out = out | ((e["key"] == name) & ((kind == "VOID") | kind.rlike(pattern)))
        return out & ~((kind == "DOUBLE") & (F.abs(F.coalesce(F.try_variant_get(e["value"], "$", "double"), F.lit(0.0))) == float("inf")))

    good = F.col("alone") & F.forall("entries", lambda p: p.isNotNull() & F.forall(p, fits)) & F.size("entries").between(1, MOST_POINTS)
    kinds = {f.split()[0]: f.split()[1] for f in POINT.split(", ")}
    taken = F.transform("entries", lambda p: F.struct(*(F.try_variant_get(_last(p, name), "$", kind).alias(name) for name, kind in kinds.items())))
    read = F.from_json("body", f"points array<struct<{', '.join(f'{name}: {kind}' for name, kind in kinds.items())}>>")["points"]
    points = rows.select("batch_id", F.when(plain, read).when(F.coalesce(good, F.lit(False)), taken).alias("points"))
    points = points.withColumn("bad", F.col("points").isNull())
    failing = F.filter(F.transform("points", lambda p, i: F.when(point_error(lambda name: p[name]).isNotNull(), i)), lambda i: i.isNotNull())
    points = points.select("batch_id", "bad", F.when(F.col("bad"), -1).otherwise(F.try_element_at(failing, F.lit(1))).alias("failed"), F.posexplode_outer("points").alias("idx", "p"))
    of = [F.col(f"p.{name}").alias(name) for name in kinds]
    error = F.when(F.col("bad"), "body").otherwise(point_error(lambda name: F.col("p")[name]))
    return points.select("batch_id", F.coalesce("idx", F.lit(-1)).alias("idx"), *of, error.alias("error"), "failed")


def first_errors(points: DataFrame) -> DataFrame:
    """(batch_id, idx, error) of the first bad point of each batch that has one."""
    return points.where("error IS NOT NULL").groupBy("batch_id").agg(F.min(F.struct("idx", "error")).alias("e")).select("batch_id", "e.idx", "e.error")


def response(with_population: Column, with_admin: Column) -> Column:
    """A winner as JSON; population and admin fields appear where they are asked for, empty ones not at all."""
    some = lambda c: F.when(with_admin & (F.col(c) != ""), F.col(c))
    return F.to_json(F.struct(
        F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.when(with_population, F.col("population")).alias("Population"), F.col("name").alias("Name"), F.col("country").alias("Country"),
        round2(F.col("km")).alias("distance_km"), some("admin1_code").alias("admin1_code"), some("admin1_name").alias("admin1_name"), some("admin2_code").alias("admin2_code"),
    ))


def gather(rows: DataFrame, value: str, sizes: DataFrame | None = None) -> DataFrame:
    """(batch_id, results): values of each batch in the order of its points, of which there are at most MOST_POINTS. sizes: (batch_id, size), how many points
    batches have; then those without a row are there as null."""
    found = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("idx", value))).alias("results"))
    if sizes is None:
        return found.select("batch_id", F.transform("results", lambda x: x[value]).alias("results"))
    at = F.map_from_entries("results")
    every = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.try_element_at(at, i))
    plain = F.transform("results", lambda x: x[value])
    return sizes.join(found, "batch_id", "left").select("batch_id", F.when(F.size("results") == F.col("size"), plain).otherwise(every).alias("results"))


def batch_body(results: Column) -> Column:
    """The answer to a batch: its points' answers in their order, as JSON texts; null for a point without one."""
    return F.concat(F.lit('{"results":['), F.array_join(F.transform(results, lambda x: F.coalesce(x, F.lit("null"))), ","), F.lit("]}"))
