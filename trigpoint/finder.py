"""All lookups behind one object, over tables of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import names as by_name
from .operators import nearest as by_point
from .operators import postal as by_code
from .operators import requests
from .plans import tables
from .plans.config import Config, feature_classes
from .plans.runs import Runs
from .sources import dumps


#: Tables that are derived from places.
PREPARED = ("names", "grams", "gram_counts", "prefixes", "cubes", "leaves")


def prepare(places: DataFrame, only: str | None = None) -> dict[str, DataFrame]:
    """The tables that lookups use besides places: names, their trigrams, and the tree of cubes; or those that come with one of them."""
    out: dict[str, DataFrame] = {}
    if only not in ("cubes", "leaves"):
        out["names"] = by_name.name_table(places).drop("added_at")
        if only != "prefixes":
            out["grams"] = by_name.gram_table(out["names"])
            out["gram_counts"] = by_name.country_gram_counts(out["grams"])
        if only in (None, "prefixes"):
            out["prefixes"] = by_name.prefix_table(out["names"])
    if only in (None, "cubes", "leaves"):
        out["cubes"], out["leaves"] = by_point.cube_tables(places)
    return out


class Finder:
    """Answers tables of queries. Built from places and postal rows; additions are seen by the next query."""

    def __init__(self, places: DataFrame, postal: DataFrame | None = None, admin1: DataFrame | None = None, prepared: dict[str, DataFrame] | None = None, additions: str | None = None):
        """prepared: tables that are derived from places, by the names that prepare() gives them; without them they are derived when they are needed.
        additions: a folder for rows that are added, which a later Finder over the same build may open again; None: a new one, for this driver."""
        self.places, self.postal, self.admin1, self.prepared = places, postal, admin1, dict(prepared or {})
        spark, path = places.sparkSession, additions or tables.scratch(places.sparkSession, "added")
        self._names_added = Runs(spark, f"{path}/names", by_name.merge_names, ("country", "name"))
        self._places_added = Runs(spark, f"{path}/places", DataFrame.distinct, ("row_id",))
        self._postal_added = Runs(spark, f"{path}/postal", by_code.merge_postal, ("country", "code"))
        self._prefixes_added: tuple[int, DataFrame] | None = None

    @classmethod
    def build(cls, spark: SparkSession, config: Config) -> Finder:
        """Reads dumps, writes the tables of a build to config.output, and opens them."""
        made = {
            "places": dumps.load_places(spark, config.places, config.limit, feature_classes(config.include_feature_classes), config.exclude_admin_divisions),
            "postal": dumps.load_postal(spark, config.postal),
        }
        if config.admin1:
            made["admin1"] = dumps.load_admin1(spark, config.admin1)
        made["places"] = tables.cut(made["places"], "places")
        tables.save(made | prepare(made["places"]), config.output)
        return cls.open(spark, config.output)

    @classmethod
    def open(cls, spark: SparkSession, path: str, additions: str | None = None, verify: bool = True) -> Finder:
        found = tables.load(spark, path, verify)
        return cls(found["places"], found.get("postal"), found.get("admin1"), {k: found[k] for k in PREPARED}, additions)

    def _prepared(self, name: str) -> DataFrame:
        if name not in self.prepared:
            self.prepared |= {k: v for k, v in prepare(self.places, name).items() if k not in self.prepared}
        return self.prepared[name]

    def names(self) -> DataFrame:
        built, added = self._prepared("names"), self._names_added.read()
        return built if added is None else by_name.with_runs(built, added)

    def _rows(self, found: DataFrame) -> DataFrame:
        """Adds the place that a found (tier, row_id) stands for."""
        columns = ["row_id", "name", "country", "lat", "lon", "population"]
        rows, added = self.places.select(F.lit(0).alias("tier"), *columns), self._places_added.read()
        if added is not None:
            rows = rows.unionByName(added.select(F.lit(1).alias("tier"), *columns))
        return found.join(rows, ["tier", "row_id"])

    def nearest(self, queries: DataFrame, rank: str = "distance", admin: bool = False) -> DataFrame:
        if rank not in ("distance", "population"):
            raise ValueError(f"no rank: {rank}")
        search = by_point.nearest if rank == "distance" else by_point.nearest_by_gravity
        # divisions are joined to places, of which there may be far fewer than queries
        places = by_point.with_admin(self.places, self.admin1) if admin else self.places
        return search(queries, places, (self._prepared("cubes"), self._prepared("leaves")))

    def batch(self, batches: DataFrame) -> DataFrame:
        """(batch_id, idx, error, body) of batches (batch_id, body): the answers of its points, each by its own rank and with what it asks to include, in their
        order, null for a point without one; or, if a point can't be used, which one is the first (idx; -1 for the body itself) and why, and no body.

        Points are read once; those of each rank are looked up together, and carry their batch, their place in it and what they ask along, so that
        answers meet nothing but the number of their batch's points.
        """
        points = tables.cut(requests.read_batches(batches), "points")
        errors = points.where("idx = failed").select("batch_id", "idx", "error", F.lit(None).cast("string").alias("body"))
        weighed_ = F.coalesce(F.col("rank") == "population", F.lit(False))
        asked = points.where("failed IS NULL").withColumn("qid", F.struct("batch_id", "idx", F.coalesce(F.col("include") == "admin", F.lit(False)).alias("admin")))
        answers = None
        for weighed in (False, True):
            own = asked.where(weighed_ == weighed)
            if not own.isEmpty():
                found = self.nearest(own, "population" if weighed else "distance", admin=True)
                part = found.select("qid.batch_id", "qid.idx", requests.response(F.lit(weighed), F.col("qid.admin")).alias("answer"))
                answers = part if answers is None else answers.unionByName(part)
        if answers is None:
            return errors
        results = requests.gather(answers, "answer", asked.groupBy("batch_id").agg((F.max("idx") + 1).alias("size")))
        whole = results.select("batch_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("error"), requests.batch_body(F.col("results")).alias("body"))
        return whole.unionByName(errors)

    def find_by_name(self, queries: DataFrame) -> DataFrame:
        return self._rows(by_name.find(queries, self.names(), self._prepared("grams"), self._prepared("gram_counts")))

    def prefixes(self, queries: DataFrame) -> DataFrame:
        """(qid, rank, name, tier, row_id) with the place that each name stands for, as place, country, lat, lon and population."""
        names, table = self.names(), self._prepared("prefixes")
        version = self._names_added.log.read()[0]
        if version:
            if self._prefixes_added is None or self._prefixes_added[0] != version:  # additions alone are looked through again
                self._prefixes_added = version, by_name.prefix_table(names.where("tier = 1"))
            table = table.unionByName(self._prefixes_added[1])
        found = by_name.prefixes(queries, names, table=table).withColumnRenamed("name", "_name")
        return self._rows(found).withColumnsRenamed({"name": "place", "_name": "name"})

    def find_by_postal_code(self, queries: DataFrame) -> DataFrame:
        if self.postal is None:
            raise ValueError("this build has no postal codes")
        return by_code.by_postal_code(queries, by_code.postal_table(self.postal, self._postal_added.read()))

    def add_places(self, rows: DataFrame, source: str = "calls", batch: int | None = None) -> bool:
        """Adds places (row_id, name, alt_names, country, lat, lon, population). A batch of a source that was added before changes nothing and gives False.

        Names are compared with those of the build once, here; lookups meet a few sorted runs of them.
        """
        rows = tables.cut(rows, "added")
        batch = self._next(self._names_added, source) if batch is None else batch
        # places first: a name whose place isn't there yet would find nothing
        self._places_added.add(rows.select("row_id", "name", "country", "lat", "lon", "population"), source, batch)
        return self._names_added.add(by_name.new_names(self._prepared("names"), rows), source, batch)

    def add_postal(self, rows: DataFrame, source: str = "calls", batch: int | None = None) -> bool:
        """Adds postal rows (row_id, country, code, place, lat, lon); of each key the row with the largest row_id holds, however late others come."""
        batch = self._next(self._postal_added, source) if batch is None else batch
        return self._postal_added.add(rows.select("row_id", "country", "code", "place", "lat", "lon"), source, batch)

    @staticmethod
    def _next(runs: Runs, source: str) -> int:
        return runs.log.read()[1].get("batches", {}).get(source, -1) + 1
