"""Places by name: exact, within two edits, and by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..plans.ranges import numbered
from ..plans.tables import cut

#: Names that can be asked for by a prefix at most, and characters of the prefixes that have a list of their own.
MOST, LONG = 50, 400
#: Names, in order, that are looked through together for those that come before them.
_BLOCK = 20_000


def _keys(df: DataFrame, tier: int) -> DataFrame:
    names = F.concat(F.coalesce("alt_names", F.array().cast("array<string>")), F.array("name"))
    return df.select("country", F.posexplode(names).alias("pos", "name"), F.lit(tier).alias("tier"), F.col("row_id").cast("long").alias("row_id"))


def name_table(places: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(country, name, tier, row_id, added_at): for each name in a country its first place, alternate names included.

    Places that were added later (tier 1) come after all that were there at the build (tier 0). added_at tells names that no place of
    the build has, in any country: when they were added first, by row and within a row alternate names before the name. Others have null.
    """
    built = _keys(places, 0).groupBy("country", "name").agg(F.lit(0).alias("tier"), F.min("row_id").alias("row_id"))
    built = _with_added_at(built)
    return built if added is None else add_names(built, added)


def add_names(built: DataFrame, added: DataFrame) -> DataFrame:
    """A name table of the build with the names of places that were added since. Only these are grouped anew."""
    return with_runs(built, merge_names(new_names(built, added)))


def new_names(built: DataFrame, added: DataFrame) -> DataFrame:
    """(country, name, row_id, at) of added places whose name the build doesn't have in that country. at: when it was added, by row and within a
    row alternate names before the name; null if the build has the name in some country."""
    known = built.select("country", "name")
    rows = _keys(added, 1).join(known, ["country", "name"], "left_anti")
    elsewhere = known.select("name").distinct().withColumn("_known", F.lit(True))
    return rows.join(elsewhere, "name", "left").select("country", "name", "row_id", F.when(F.col("_known").isNull(), F.struct("row_id", "pos")).alias("at"))


def merge_names(rows: DataFrame) -> DataFrame:
    """What holds for each name in a country over all rows of new_names(), in whatever order and however often they come."""
    return rows.groupBy("country", "name").agg(F.min("row_id").alias("row_id"), F.min("at").alias("at"))


def with_runs(built: DataFrame, added: DataFrame) -> DataFrame:
    """A name table of the build with what merge_names() gives of additions."""
    first = added.groupBy("name").agg(F.min("at").alias("added_at"))
    return _with_added_at(built).unionByName(added.join(first, "name").select("country", "name", F.lit(1).alias("tier"), "row_id", "added_at"))


def _with_added_at(names: DataFrame) -> DataFrame:
    """A table of the build alone may come without that column."""
    return names if "added_at" in names.columns else names.withColumn("added_at", F.lit(None).cast("struct<row_id:bigint,pos:int>"))


def exact(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, matched, distance, tier, row_id) of queries (qid, name, country) whose name stands in the country as it is."""
    return queries.select("qid", "name", "country").join(names, ["country", "name"]).select("qid", F.col("name").alias("matched"), F.lit(0).alias("distance"), "tier", "row_id")


def gram_counts(names: DataFrame) -> DataFrame:
    """(gram, postings): how many distinct names have a trigram."""
    return names.select("name").distinct().select(F.explode(trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("postings"))


def gram_table(names: DataFrame) -> DataFrame:
    """(country, gram, name, postings) for names of the build: their trigrams, and how many names of the country have each."""
    keys = _with_added_at(names).where("added_at IS NULL").select("country", "name").withColumn("gram", F.explode(trigrams(F.col("name"))))
    counts = keys.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("postings"))
    return keys.join(counts, ["country", "gram"])


def country_gram_counts(grams: DataFrame) -> DataFrame:
    """(country, gram, postings) of a gram table, each once."""
    return grams.groupBy("country", "gram").agg(F.first("postings").alias("postings"))


def fuzzy(queries: DataFrame, names: DataFrame, edits: int, grams: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(qid, matched, distance, tier, row_id): the name in the country within so many edits, nearest first, then names of the
    build in byte order, then added ones in the order in which they were added.

    A name of the build must share a trigram with the query, which all but the shortest do. Of a query's g trigrams the
    g - max(1, g - 3 * edits) + 1 rarest are looked up: a name within reach has one of them. Added names, which are few, are compared by
    country and length. grams, counts: gram_table(names) and country_gram_counts() of it, if they were made before.
    """
    names = _with_added_at(names)
    grams = gram_table(names) if grams is None else grams
    q = queries.select("qid", F.col("name").alias("q"), "country").withColumn("grams", trigrams(F.col("q")))
    g = F.size("grams")
    q = q.withColumn("walk", g - F.greatest(F.lit(1), g - 3 * edits) + 1)
    counts = country_gram_counts(grams) if counts is None else counts
    walks = q.select("qid", "q", "country", "walk", g.alias("g"), F.explode("grams").alias("gram")).join(counts, ["country", "gram"])
    # trigrams that no name has cost nothing, so they are walked first: as many fewer of the others are needed
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("postings", "gram"))
    missing = F.col("g") - F.count(F.lit(1)).over(Window.partitionBy("qid"))
    walks = walks.withColumn("rank", rank + missing).where(F.col("rank") <= F.col("walk"))
    near = F.abs(F.length("q") - F.length("name")) <= edits
    pairs = walks.join(grams.select("country", "gram", "name"), ["country", "gram"]).where(near).select("qid", "q", "country", "name").distinct()
    added = names.where("added_at IS NOT NULL").select("country", "name", F.length("name").alias("n"))
    lengths = q.select("qid", "q", "country", F.explode(F.sequence(F.length("q") - edits, F.length("q") + edits)).alias("n"))
    pairs = pairs.unionByName(lengths.join(added, ["country", "n"]).select("qid", "q", "country", "name"))
    pairs = pairs.withColumn("distance", F.levenshtein("q", "name", edits)).where("distance >= 0")
    found = pairs.join(names, ["country", "name"])
    order = F.struct("distance", F.col("added_at").isNotNull(), "added_at", "name")
    best = found.groupBy("qid").agg(F.min_by(F.struct("name", "distance", "tier", "row_id"), order).alias("b"))
    return best.select("qid", F.col("b.name").alias("matched"), F.col("b.distance").alias("distance"), F.col("b.tier").alias("tier"), F.col("b.row_id").alias("row_id"))


def find(queries: DataFrame, names: DataFrame, grams: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(qid, matched, distance, tier, row_id): exact, else within one edit, else within two. Unknown countries find nothing."""
    found = exact(queries, names)
    left = queries.join(found.select("qid"), "qid", "left_anti")
    # one search within two edits: its order puts one edit before two
    return found.unionByName(fuzzy(left, names, 2, grams, counts))


def prefix_table(names: DataFrame, most: int = MOST) -> DataFrame:
    """(country, prefix, tier, names): for each prefix of up to LONG characters its first names in byte order, `most` at most, as an array of (name, row_id).

    Names that begin alike stand next to each other in byte order, so a name is among the first of a prefix unless the name that
    stands `most` places before it begins so too. Names are numbered by ranges and looked through in blocks, each with the last names
    of the one before it: a prefix that a third of all names share is spread over tasks, and no name is written for a prefix that doesn't list it.
    """
    rows = numbered(names.select("tier", "country", "name", "row_id"), "tier", "country", "name")
    block = F.floor(F.col("pos") / _BLOCK)
    own = rows.withColumn("block", block).withColumn("own", F.lit(True))
    last = rows.where(F.col("pos") % _BLOCK >= _BLOCK - most).withColumn("block", block + 1).withColumn("own", F.lit(False))
    before = F.lag(F.struct("tier", "country", "name"), most).over(Window.partitionBy("block").orderBy("pos"))
    rows = own.unionByName(last).withColumn("before", before).where("own")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.length("name"), F.lit(LONG))))).withColumn("prefix", F.substring("name", F.lit(1), F.col("n")))
    full = (F.col("before.tier") == F.col("tier")) & (F.col("before.country") == F.col("country")) & F.startswith("before.name", "prefix")
    rows = rows.where(~F.coalesce(full, F.lit(False)))
    return rows.groupBy("country", "prefix", "tier").agg(F.sort_array(F.collect_list(F.struct("name", "row_id"))).alias("names"))


def prefixes(queries: DataFrame, names: DataFrame, default: int = 10, most: int = MOST, table: DataFrame | None = None) -> DataFrame:
    """(qid, rank, name, tier, row_id) for queries (qid, prefix, country, limit): names in byte order, build-time names first.

    A null limit is the default one, a larger one than `most` is `most`. An empty prefix matches all names. table: prefix_table(names) or, with
    the same columns, that of the build and that of additions together; without it, it is derived. A query meets no more names than it can list.
    Prefixes of more than LONG characters are compared with names that are as long.
    """
    if table is None:
        names = cut(names.select("country", "name", "tier", "row_id"), "names")  # read several times
        table = prefix_table(names, most)
    k = F.least(F.coalesce("limit", F.lit(default)), F.lit(most))
    q = queries.select("qid", "prefix", "country", k.alias("k"))
    hit = q.join(table, ["country", "prefix"]).where("k > 0").select("qid", "k", "tier", F.inline(F.slice("names", F.lit(1), F.col("k"))))
    start = lambda c: F.substring(c, F.lit(1), F.lit(LONG))
    long = q.where(F.length("prefix") > LONG).withColumn("start", start("prefix"))
    names = names.where(F.length("name") > LONG).select("country", "name", "tier", "row_id", start("name").alias("start"))
    hit = hit.unionByName(long.join(names, ["country", "start"]).where(F.startswith("name", "prefix")).select("qid", "k", "tier", "name", "row_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("tier", "name"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).select("qid", "rank", "name", "tier", "row_id")
