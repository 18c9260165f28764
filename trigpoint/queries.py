"""Queries over the test tables, each with DuckDB SQL for the same rows.

The tables have no coordinates; places, postal codes and queries are derived from them by integer arithmetic
that both engines do alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .finder import Finder
from .functions import geo, http, text
from .operators import metrics, names, nearest, postal, requests
from .plans import ranges, tables
from .sources import dumps, synthetic
from .streaming import live

_PLACES = """SELECT c_custkey AS row_id, p_name AS name, n_name AS country, ((c_custkey*7919)%180001)/1000.0E0-90 AS lat,
 ((c_custkey*104729)%360001)/1000.0E0-180 AS lon, CAST(CASE WHEN c_custkey%3=0 THEN 0 ELSE (c_custkey*15485863)%3000000 END AS INT) AS population,
 c_mktsegment AS admin1_code, CAST(p_size AS STRING) AS admin2_code, substr('AHLPRSTUV', CAST(c_custkey%9 AS INT)+1, 1) AS feature_class, c_name, p_brand
 FROM customer JOIN part ON p_partkey=c_custkey JOIN nation ON n_nationkey=c_nationkey"""
_ADMIN1 = "SELECT DISTINCT n_name || '.' || c_mktsegment AS key, r_name AS name FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey WHERE r_regionkey<>2"
_POSTAL = """SELECT s_suppkey AS row_id, n_name AS country, 'S' || CAST(s_suppkey%40 AS STRING) AS code, s_name AS place,
 ((s_suppkey*7919)%180001)/1000.0E0-90 AS lat, ((s_suppkey*104729)%360001)/1000.0E0-180 AS lon FROM supplier JOIN nation ON n_nationkey=s_nationkey"""
_POINTS = "SELECT event_id AS qid, ((event_id*48611)%180001)/1000.0E0-90 AS lat, ((event_id*15486719)%360001)/1000.0E0-180 AS lon FROM events"
_NAMES = """SELECT p_partkey AS qid, CASE WHEN p_partkey%5=1 THEN substr(p_name,1,2) || substr(p_name,4) WHEN p_partkey%5=2 THEN 'xx' || substr(p_name,3)
 WHEN p_partkey%5=3 THEN 'zzzz' || p_name ELSE p_name END AS name, CASE WHEN p_partkey%5=4 THEN 'ATLANTIS' ELSE n_name END AS country
 FROM part JOIN nation ON n_nationkey=p_partkey%25"""
_SAMPLES = """SELECT event_type, CAST(event_id%7 AS INT) AS step, CASE WHEN event_type='error' THEN 'failed' WHEN event_type='signup' THEN 'not_found' WHEN event_type='purchase' AND event_id%2=0 THEN 'dropped' ELSE 'served' END AS outcome,
 CAST((event_id*7919)%100000007 AS BIGINT) AS latency_ns, ((event_id*7919)%6007)/1000.0E0 AS seconds, CASE WHEN event_type='error' THEN 500 WHEN event_type='signup' THEN 404 ELSE 200 END AS status, '/' || event_type AS path FROM events"""
#: Lines of a place dump, some of which can't be used.
_LINES = """SELECT row_id + 1 AS line_no, CASE WHEN row_id%41=7 THEN '' ELSE concat_ws(chr(9), CAST(row_id AS STRING), name, name, CASE WHEN row_id%4=0 THEN '' ELSE c_name || ',' || p_brand END,
 CASE WHEN row_id%37=1 THEN '91.5' WHEN row_id%37=2 THEN 'x' ELSE CAST((row_id*7919)%90 AS STRING) END, CAST((row_id*104729)%180 AS STRING), feature_class, '', country, '', admin1_code, admin2_code, '', '',
 CASE WHEN row_id%29=0 THEN '-5' WHEN row_id%29=1 THEN 'abc' WHEN row_id%29=2 THEN '-3000000000' WHEN row_id%29=3 THEN '' ELSE CAST(population AS STRING) END, '', '', '', '') END AS line FROM places"""
_POSTAL_LINES = """SELECT row_id + 1 AS line_no, CASE WHEN row_id%31=5 THEN '' WHEN row_id%31=6 THEN 'AA' || chr(9) || 'x' ELSE concat_ws(chr(9), country, code, place, '', '', '', '', '', '', CAST(row_id%90 AS STRING), CASE WHEN row_id%31=7 THEN '200' ELSE CAST(row_id%180 AS STRING) END, CASE WHEN row_id%3=0 THEN 'z' ELSE '4' END) END AS line FROM postal"""
_KM = "2*6371.0E0*asin(least(1.0E0, sqrt(pow(sin(radians(p.lat-q.lat)/2),2)+cos(radians(q.lat))*cos(radians(p.lat))*pow(sin(radians(p.lon-q.lon)/2),2))))"


class Views:
    """The derived tables of a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def sql(self, text_: str, **more: DataFrame) -> DataFrame:
        """Runs SQL over the tables that it names, as temporary arguments rather than views of the session."""
        tables = {t: self.spark.read.parquet(f"{self.dir}/{t}.parquet") for t in ("customer", "part", "nation", "region", "supplier", "events") if f" {t}" in text_} | more
        named = {t: "{" + t + "}" for t in tables}
        out = text_
        for t in tables:
            out = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {named[t]}", out)
        return self.spark.sql(out, **tables)

    def places(self) -> DataFrame:
        return self.sql(_PLACES).withColumn("alt_names", F.array("c_name", "p_brand")).drop("c_name", "p_brand")

    def raw_places(self) -> DataFrame:
        return self.sql(_PLACES)

    def admin1(self) -> DataFrame:
        return self.sql(_ADMIN1)

    def postal(self) -> DataFrame:
        return self.sql(_POSTAL)

    def points(self) -> DataFrame:
        return self.sql(_POINTS)

    def name_queries(self) -> DataFrame:
        return self.sql(_NAMES)

    def samples(self) -> DataFrame:
        return self.sql(_SAMPLES)

    def lines(self) -> DataFrame:
        return self.sql(_LINES, places=self.raw_places())

    def postal_lines(self) -> DataFrame:
        return self.sql(_POSTAL_LINES, postal=self.postal())


QUERIES, ORACLE_SQL = {}, {}
_WITH = {"places": _PLACES, "admin1": _ADMIN1, "postal": _POSTAL, "points": _POINTS, "name_queries": _NAMES, "samples": _SAMPLES, "lines": _LINES, "postal_lines": _POSTAL_LINES}
_NEEDS = {"lines": ("places",), "postal_lines": ("postal",)}


def query(sql: str | None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            own = list(dict.fromkeys(x for n in needs for x in (*_NEEDS.get(n, ()), n)))
            body = sql.strip()
            ctes = ", ".join(f"{n} AS ({_WITH[n]})" for n in own)
            ORACLE_SQL[f.__name__] = f"WITH {ctes}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}" if own else body
        return f

    return add


def _won(order: str) -> str:
    return f"""WITH pairs AS (SELECT q.qid, {_KM} AS km, p.* FROM points q CROSS JOIN places p),
won AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {order}) = 1)
"""


@query(_won("km, row_id") + "SELECT qid, row_id, name, country, round(km*100)/100 AS distance_km FROM won", "places", "points")
def j1_nearest(v: Views) -> DataFrame:
    return nearest.nearest(v.points(), v.places()).select("qid", "row_id", "name", "country", geo.round2(F.col("km")).alias("distance_km"))


@query(_won("population/(km*km+1) DESC, km, row_id") + "SELECT qid, row_id, population, round(km*100)/100 AS distance_km FROM won", "places", "points")
def j2_gravity(v: Views) -> DataFrame:
    return nearest.nearest_by_gravity(v.points(), v.places()).select("qid", "row_id", "population", geo.round2(F.col("km")).alias("distance_km"))


@query(f"SELECT q.qid, p.row_id, round({_KM}*100)/100 AS distance_km FROM points q CROSS JOIN places p WHERE {_KM} <= 150", "places", "points")
def j3_radius(v: Views) -> DataFrame:
    return nearest.radius_join(v.points(), v.places(), 150.0).where("km <= 150").select("qid", "row_id", geo.round2(F.col("km")).alias("distance_km"))


@query(_won("km, row_id") + "SELECT qid, row_id, admin1_code, coalesce(a.name, '') AS admin1_name, admin2_code FROM won LEFT JOIN admin1 a ON a.key = won.country || '.' || won.admin1_code", "places", "points", "admin1")
def j7_admin(v: Views) -> DataFrame:
    return nearest.with_admin(nearest.nearest(v.points(), v.places()), v.admin1()).select("qid", "row_id", "admin1_code", "admin1_name", "admin2_code")


_TABLE = "WITH n AS (SELECT country, unnest([name, c_name, p_brand]) AS name, row_id FROM places), t AS (SELECT country, name, min(row_id) AS row_id FROM n GROUP BY ALL) "


@query(_TABLE + "SELECT qid, name AS matched, row_id FROM name_queries JOIN t USING (country, name)", "places", "name_queries")
def j8_exact_name(v: Views) -> DataFrame:
    return names.exact(v.name_queries(), names.name_table(v.places())).select("qid", "matched", "row_id")


def _fuzzy(edits: int) -> str:
    return _TABLE + f"""SELECT qid, t.name AS matched, CAST(levenshtein(q.name, t.name) AS INT) AS distance, row_id FROM name_queries q JOIN t USING (country) WHERE levenshtein(q.name, t.name) <= {edits}
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY levenshtein(q.name, t.name), t.name) = 1"""


@query(_fuzzy(1), "places", "name_queries")
def j9_fuzzy_one(v: Views) -> DataFrame:
    return names.fuzzy(v.name_queries(), names.name_table(v.places()), 1).select("qid", "matched", "distance", "row_id")


@query(_fuzzy(2), "places", "name_queries")
def j10_find_by_name(v: Views) -> DataFrame:
    return names.find(v.name_queries(), names.name_table(v.places())).select("qid", "matched", "distance", "row_id")


@query(_TABLE + """, q AS (SELECT p_partkey AS qid, substr(p_name, 1, 1 + p_partkey%4) AS prefix, n_name AS country, CASE WHEN p_partkey%3=0 THEN 3 END AS k FROM part JOIN nation ON n_nationkey=p_partkey%25)
SELECT qid, CAST(rank AS INT) AS rank, name, row_id FROM (SELECT qid, k, t.name, t.row_id, row_number() OVER (PARTITION BY qid ORDER BY t.name) AS rank FROM q JOIN t ON t.country=q.country AND starts_with(t.name, q.prefix)) WHERE rank <= coalesce(k, 10)""", "places")  # fmt: skip
def j14_prefix(v: Views) -> DataFrame:
    q = v.sql("SELECT p_partkey AS qid, substr(p_name, 1, CAST(1 + p_partkey%4 AS INT)) AS prefix, n_name AS country, CASE WHEN p_partkey%3=0 THEN 3 END AS limit FROM part JOIN nation ON n_nationkey=p_partkey%25")
    return names.prefixes(q, names.name_table(v.places())).select("qid", "rank", "name", "row_id")


@query("""WITH t AS (SELECT country, code, arg_max(place, row_id) AS place, arg_max(lat, row_id) AS lat, arg_max(lon, row_id) AS lon FROM postal GROUP BY ALL)
SELECT event_id AS qid, place AS name, country, lat, lon, 0 AS population FROM events JOIN nation ON n_nationkey=event_id%25 JOIN t ON t.country=n_name AND t.code='S' || CAST(event_id%50 AS STRING)""", "postal")  # fmt: skip
def j15_postal(v: Views) -> DataFrame:
    q = v.sql("SELECT event_id AS qid, n_name AS country, 'S' || CAST(event_id%50 AS STRING) AS code FROM events JOIN nation ON n_nationkey=event_id%25")
    return postal.by_postal_code(q, postal.postal_table(v.postal()))


_BATCHES = """SELECT event_id//20 AS batch_id, list({'idx': event_id%20, 'lat': CASE WHEN event_id%503=0 THEN 95.5E0 ELSE ((event_id*48611)%180001)/1000.0E0-90 END, 'lon': ((event_id*15486719)%360001)/1000.0E0-180}) AS p FROM events GROUP BY 1"""


@query("""WITH b AS (SELECT event_id//20 AS batch_id, event_id%20 AS idx, event_id AS qid, event_id%503=0 AS bad FROM events), e AS (SELECT batch_id, min(idx) AS bad FROM b WHERE bad GROUP BY 1),
pairs AS (SELECT q.qid, """ + _KM + """ AS km, p.row_id FROM points q CROSS JOIN places p), won AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY km, row_id) = 1)
SELECT b.batch_id, CAST(min(e.bad) AS INT) AS first_error, CASE WHEN min(e.bad) IS NULL THEN string_agg(CAST(won.row_id AS VARCHAR), ',' ORDER BY idx) END AS answers FROM b LEFT JOIN e USING (batch_id) LEFT JOIN won USING (qid) GROUP BY b.batch_id""", "places", "points")  # fmt: skip
def j16_batch(v: Views) -> DataFrame:
    rows = v.sql("SELECT event_id DIV 20 AS batch_id, event_id%20 AS idx, CASE WHEN event_id%503=0 THEN 95.5E0 ELSE ((event_id*48611)%180001)/1000.0E0-90 END AS lat, ((event_id*15486719)%360001)/1000.0E0-180 AS lon FROM events")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    bodies = rows.groupBy("batch_id").agg(F.to_json(F.struct(ordered.alias("points"))).alias("body"))
    points = tables.cut(requests.read_batches(bodies), "points")
    places = v.places()
    asked = points.where("failed IS NULL").withColumn("qid", F.struct("batch_id", "idx"))
    found = nearest.nearest(asked, places.select("row_id"), nearest.cube_tables(places))
    answers = requests.gather(found.select("qid.batch_id", "qid.idx", F.col("row_id").cast("string").alias("answer")), "answer")
    batches = points.where("idx = coalesce(failed, 0)").select("batch_id", F.col("failed").alias("first_error"))
    return batches.join(answers, "batch_id", "left").select("batch_id", "first_error", F.array_join("results", ",").alias("answers"))


@query("""WITH a AS (SELECT name, country, population FROM places), b AS (SELECT name, country, population + CAST(row_id%5=0 AS INT) AS population FROM places)
SELECT 'left' AS side, count(*) AS rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""", "places")  # fmt: skip
def j17_difference(v: Views) -> DataFrame:
    p = v.places()
    return metrics.difference(p.select("name", "country", "population"), p.select("name", "country", (F.col("population") + (F.col("row_id") % 5 == 0).cast("int")).alias("population")))


@query("""WITH p AS (SELECT *, CASE WHEN row_id%7 = 0 THEN NULL ELSE population // 1000000 END AS size FROM places),
a AS (SELECT row_id, row_number() OVER (PARTITION BY country, size ORDER BY row_id) AS nth, country, size FROM p), b AS (SELECT row_id * 3 % 1000003 AS row_id, row_number() OVER (PARTITION BY country, size ORDER BY row_id * 3 % 1000003) AS nth, country, size FROM p)
SELECT a.row_id AS old_id, b.row_id AS new_id FROM a JOIN b ON a.country = b.country AND a.size IS NOT DISTINCT FROM b.size AND a.nth = b.nth""", "places")  # fmt: skip
def j17_remap(v: Views) -> DataFrame:
    """Rows of which many are alike, with new ids in another order."""
    rows = v.places().select("row_id", "country", F.expr("CASE WHEN row_id%7 = 0 THEN NULL ELSE population DIV 1000000 END").alias("size"))
    return metrics.remap(rows, rows.withColumn("row_id", F.col("row_id") * 3 % 1_000_003), ["country", "size"])


_PARSED = """WITH f AS (SELECT line_no, string_split(line, chr(9)) AS f FROM lines), g AS (SELECT line_no, f[2] AS name, f[4] AS alts, f[5] AS lat, f[6] AS lon, f[7] AS fc, f[9] AS country, coalesce(f[15], '') AS pop FROM f),
r AS (SELECT *, CASE WHEN fc NOT IN ('P', 'A', 'H', 'T', 'V') OR fc IS NULL THEN 'feature class' WHEN fc = 'A' THEN 'feature class' WHEN coalesce(name,'')='' OR coalesce(lat,'')='' OR coalesce(lon,'')='' OR coalesce(country,'')='' THEN 'field missing'
 WHEN try_cast(lat AS DOUBLE) IS NULL THEN 'coordinate can''t be read' WHEN abs(try_cast(lat AS DOUBLE)) > 90 THEN 'coordinate out of range' WHEN try_cast(pop AS INT) < 0 THEN 'population negative' END AS reason FROM g)
"""
_CLASSES = ["P", "A", "H", "T", "V"]


@query(_PARSED + "SELECT line_no AS row_id, name, country, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, coalesce(try_cast(pop AS INT), 0) AS population, CASE WHEN alts='' THEN 0 ELSE len(string_split(alts, ',')) END AS n_alts FROM r WHERE reason IS NULL", "lines")
def s4_place_scan(v: Views) -> DataFrame:
    rows = dumps.kept(dumps.parse_places(v.lines(), _CLASSES, True))
    return rows.select("row_id", "name", "country", "lat", "lon", "population", F.size("alt_names").cast("long").alias("n_alts"))


@query("""WITH f AS (SELECT line_no, string_split(line, chr(9)) AS f FROM postal_lines), g AS (SELECT line_no, f[1] AS country, f[2] AS code, f[3] AS place, try_cast(f[10] AS DOUBLE) AS lat, try_cast(f[11] AS DOUBLE) AS lon, coalesce(try_cast(f[12] AS INT), 0) AS accuracy FROM f WHERE len(f) >= 12)
SELECT country, code, place, lat, lon, accuracy FROM g WHERE abs(lat) <= 90 AND abs(lon) <= 180 QUALIFY row_number() OVER (PARTITION BY country, code ORDER BY line_no DESC) = 1""", "postal_lines")  # fmt: skip
def s5_postal_scan(v: Views) -> DataFrame:
    return dumps.keep_last(dumps.kept(dumps.parse_postal(v.postal_lines())), "country", "code").select("country", "code", "place", "lat", "lon", "accuracy")


@query("SELECT key, name FROM admin1", "admin1")
def s6_admin1_scan(v: Views) -> DataFrame:
    lines = v.admin1().select(F.xxhash64("key").alias("line_no"), F.concat_ws("\t", "key", "name", "name", F.lit("1")).alias("line"))
    return dumps.keep_last(dumps.kept(dumps.parse_admin1(lines)), "key").select("key", "name")


@query(_PARSED + "SELECT reason, count(*) AS skipped, array_to_string(list_sort(list(line_no))[1:5], ',') AS first_lines FROM r WHERE reason IS NOT NULL AND reason <> 'feature class' GROUP BY reason", "lines")
def a4_skip_report(v: Views) -> DataFrame:
    return dumps.skip_report(dumps.parse_places(v.lines(), _CLASSES, True)).withColumn("first_lines", F.array_join(F.col("first_lines").cast("array<string>"), ","))


@query(_PARSED + "SELECT count(*) AS seen, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'feature class') AS by_class, count(*) FILTER (reason IS NOT NULL AND reason <> 'feature class') AS skipped FROM r", "lines")
def a5_class_counts(v: Views) -> DataFrame:
    return dumps.class_counts(dumps.parse_places(v.lines(), _CLASSES, True))


@query(_TABLE + "SELECT country, name, row_id FROM t", "places")
def a1_name_table(v: Views) -> DataFrame:
    return names.name_table(v.places()).select("country", "name", "row_id")


@query(_TABLE + "SELECT country, count(*) AS keys, min(name) AS first_name, (SELECT max(population) FROM places p WHERE p.country = t.country) AS max_population FROM t GROUP BY country", "places")
def a6_totals(v: Views) -> DataFrame:
    """Keys per country, with the first name in byte order and (A3) the largest population."""
    most = v.places().groupBy("country").agg(F.max("population").alias("max_population"))
    keys = names.name_table(v.places()).groupBy("country").agg(F.count(F.lit(1)).alias("keys"), F.min("name").alias("first_name"))
    return keys.join(most, "country")


@query(_TABLE + ", d AS (SELECT DISTINCT name, chr(1) || chr(1) || name || chr(1) || chr(1) AS p FROM t), g AS (SELECT name, unnest(list_distinct(list_transform(range(1, len(name) + 3), lambda i: substr(p, i, 3)))) AS gram FROM d) SELECT replace(gram, chr(1), '_') AS gram, count(*) AS postings FROM g GROUP BY 1", "places")
def a7_gram_counts(v: Views) -> DataFrame:
    return names.gram_counts(names.name_table(v.places())).select(F.replace("gram", F.chr(F.lit(0)), F.lit("_")).alias("gram"), "postings")


@query("SELECT path, status, count(*) AS requests FROM samples GROUP BY ALL", "samples")
def a8_request_counts(v: Views) -> DataFrame:
    return metrics.request_counts(v.samples())


@query("SELECT path, " + ", ".join(f"count(*) FILTER (seconds <= {b}) AS le_{str(b).replace('.', '_')}" for b in metrics.BOUNDS) + ", count(*) AS le_inf, round(sum(seconds)*100)/100 AS sum_seconds FROM samples GROUP BY path", "samples")
def a8_histogram(v: Views) -> DataFrame:
    return metrics.histogram(v.samples()).withColumn("sum_seconds", geo.round2(F.col("sum_seconds")))


@query("SELECT step, count(*) AS scheduled, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("served", "not_found", "failed", "dropped")) + """, count(*) FILTER (outcome = 'served') / 30.0E0 AS achieved, count(*) FILTER (outcome IN ('failed', 'dropped')) / CAST(count(*) AS DOUBLE) AS error_share,
""" + ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ns) FILTER (outcome = 'served') AS {n}" for n, p in metrics.PERCENTILES.items()) + ", max(latency_ns) FILTER (outcome = 'served') AS slowest FROM samples GROUP BY step", "samples")  # fmt: skip
def a9_sweep(v: Views) -> DataFrame:
    return metrics.sweep(v.samples(), 30)


@query("SELECT path, CASE WHEN status BETWEEN 200 AND 299 THEN 'served' WHEN status = 404 THEN 'not_found' ELSE 'failed' END AS outcome, count(*) AS n FROM samples GROUP BY ALL", "samples")
def a11_outcomes(v: Views) -> DataFrame:
    return v.samples().withColumn("outcome", metrics.outcome(F.col("status"), F.lit(None))).groupBy("path", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT country || '.' || admin1_code AS key, min(row_id) AS first FROM places GROUP BY 1)", "places")
def a12_admin_ids(v: Views) -> DataFrame:
    """Ids by first encounter."""
    keys = v.places().groupBy(F.concat_ws(".", "country", "admin1_code").alias("key")).agg(F.min("row_id").alias("first"))
    return ranges.dense_ids(keys, "first").select("key", "id")


@query("SELECT row_id, population FROM places WHERE population > 0 ORDER BY population DESC, row_id LIMIT 4096", "places")
def o1_top_population(v: Views) -> DataFrame:
    return nearest.top_populations(v.places()).select("row_id", "population")


@query("SELECT country, lat, population, name, lon FROM places ORDER BY name, country, lat, lon, population", "places")
def o5_total_order(v: Views) -> DataFrame:
    return v.places().select("country", "lat", "population", "name", "lon").orderBy("name", "country", "lat", "lon", "population")


@query("""SELECT qid, CASE WHEN lat2 IS NULL THEN 'lat' WHEN abs(lat2) > 90 THEN 'lat range' WHEN abs(lon2) > 180 THEN 'lon range' WHEN rank NOT IN ('', 'distance', 'population') THEN 'rank' WHEN include NOT IN ('', 'admin') THEN 'include' END AS error
FROM (SELECT qid, CASE WHEN qid%11=0 THEN NULL ELSE lat*1.2E0 END AS lat2, lon*1.1E0 AS lon2, CASE WHEN qid%3=0 THEN 'distance' WHEN qid%3=1 THEN '' ELSE 'Population' END AS rank, CASE WHEN qid%5=0 THEN 'x' ELSE 'admin' END AS include FROM points)""", "points")  # fmt: skip
def f11_validate(v: Views) -> DataFrame:
    q = v.points().selectExpr("qid", "CASE WHEN qid%11=0 THEN NULL ELSE lat*1.2E0 END AS lat", "lon*1.1E0 AS lon", "CASE WHEN qid%3=0 THEN 'distance' WHEN qid%3=1 THEN '' ELSE 'Population' END AS rank", "CASE WHEN qid%5=0 THEN 'x' ELSE 'admin' END AS include")
    return q.select("qid", requests.point_error().alias("error"))


@query("SELECT qid, CASE WHEN qid%7=0 THEN '' ELSE name END AS name, upper(country) AS country, CASE WHEN qid%7=0 THEN 'name' END AS error FROM name_queries", "name_queries")
def f13_name_request(v: Views) -> DataFrame:
    q = v.name_queries().selectExpr("qid", "CASE WHEN qid%7=0 THEN ' \t\u3000' ELSE '\t\u00a0 ' || name || '\u2003' END AS name", "lower(country) || '\r\u3000 ' AS country")
    n, c, e = requests.name_request(F.col("name"), F.col("country"))
    return q.select("qid", n.alias("name"), c.alias("country"), e.alias("error"))


@query(_won("km, row_id") + """SELECT qid, name || '|' || country || '|' || CAST(row_id AS VARCHAR) AS value FROM won""", "places", "points")
def k7_transcript(v: Views) -> DataFrame:
    return nearest.nearest(v.points(), v.places()).select("qid", F.concat_ws("|", "name", "country", F.col("row_id").cast("string")).alias("value")).orderBy("qid")


_Q = "http_request_duration_seconds"


@query("WITH g AS (SELECT path, status, count(*) AS n FROM samples GROUP BY ALL), h AS (SELECT path, " + ", ".join(f"count(*) FILTER (seconds <= {b}) AS b{i}" for i, b in enumerate(metrics.BOUNDS)) + """, count(*) AS n, CAST(sum(CAST(seconds * 1000 AS BIGINT)) AS BIGINT) AS s FROM samples GROUP BY path)
SELECT '# HELP http_requests_total Completed HTTP requests.' AS line UNION ALL SELECT '# TYPE http_requests_total counter' UNION ALL SELECT 'http_requests_total{path="' || path || '",status="' || status || '"} ' || n FROM g
UNION ALL SELECT '# HELP http_request_duration_seconds Handler latency by route.' UNION ALL SELECT '# TYPE http_request_duration_seconds histogram'
""" + "".join(f"""UNION ALL SELECT '{_Q}_bucket{{path="' || path || '",le="{b:g}"}} ' || b{i} FROM h """ for i, b in enumerate(metrics.BOUNDS)) + f"""UNION ALL SELECT '{_Q}_bucket{{path="' || path || '",le="+Inf"}} ' || n FROM h
UNION ALL SELECT '{_Q}_sum{{path="' || path || '"}} ' || s FROM h UNION ALL SELECT '{_Q}_count{{path="' || path || '"}} ' || n FROM h
UNION ALL SELECT unnest(['# TYPE places gauge', 'places 12', '# TYPE load gauge', 'load 0.5', '# TYPE trips counter', 'trips 3'])""", "samples")
def k6_exposition(v: Views) -> DataFrame:
    """Whole milliseconds instead of seconds as sums, which both engines write alike."""
    rows = v.samples()
    sums = rows.groupBy("path").agg(F.sum(F.round(F.col("seconds") * 1000).cast("long")).alias("sum_seconds"))
    durations = metrics.histogram(rows).drop("sum_seconds").join(sums, "path")
    gauges, counters = v.spark.createDataFrame([("places", 12.0), ("load", 0.5)], "name string, value double"), v.spark.createDataFrame([("trips", 3)], "name string, value long")
    return metrics.exposition(metrics.request_counts(rows), durations, gauges, counters)


@query(_fuzzy(2).replace("SELECT qid, t.name AS matched, CAST(levenshtein(q.name, t.name) AS INT) AS distance, row_id", "SELECT qid, q.name AS asked, q.country AS country, t.name AS t_name, row_id").replace(_TABLE, _TABLE + ", f AS (")
+ """) SELECT 'name "' || asked || '" ' || f.country || ' -> "' || p.name || '"|"' || p.country || '"|' || format('{:.9f}', p.lat) || '|' || format('{:.9f}', p.lon) || '|' || p.population AS value FROM f JOIN places p USING (row_id)
UNION ALL SELECT 'name "' || q.name || '" ' || q.country || ' -> nil' FROM name_queries q WHERE q.qid NOT IN (SELECT qid FROM f)""", "places", "name_queries")
def k7_name_transcript(v: Views) -> DataFrame:
    found = names.find(v.name_queries(), names.name_table(v.places())).select("qid", "row_id")
    place = v.places().select("row_id", F.col("name").alias("place"), F.col("country").alias("place_country"), "lat", "lon", "population")
    rows = v.name_queries().join(found, "qid", "left").join(place, "row_id", "left")
    return metrics.transcript(rows, "qid", metrics.lookup_line("name", "name", "country", metrics.place_line("place", "place_country")))


@query("""WITH t AS (SELECT country, code, arg_max(place, row_id) AS place, arg_max(lat, row_id) AS lat, arg_max(lon, row_id) AS lon FROM postal GROUP BY ALL), q AS (SELECT event_id AS qid, n_name AS country, 'S' || CAST(event_id%50 AS STRING) AS code FROM events JOIN nation ON n_nationkey=event_id%25)
SELECT 'postal "' || q.code || '" ' || q.country || ' -> ' || coalesce('"' || place || '"|"' || t.country || '"|' || format('{:.9f}', lat) || '|' || format('{:.9f}', lon) || '|0', 'nil') AS value FROM q LEFT JOIN t ON t.country=q.country AND t.code=q.code""", "postal")  # fmt: skip
def k7_postal_transcript(v: Views) -> DataFrame:
    q = v.sql("SELECT event_id AS qid, n_name AS country, 'S' || CAST(event_id%50 AS STRING) AS code FROM events JOIN nation ON n_nationkey=event_id%25")
    found = postal.by_postal_code(q, postal.postal_table(v.postal())).withColumnRenamed("country", "place_country")
    rows = q.join(found, "qid", "left")
    return metrics.transcript(rows, "qid", metrics.lookup_line("postal", "code", "country", metrics.place_line("name", "place_country")))


@query(_won("population/(km*km+1) DESC, km, row_id") + """SELECT '"' || name || '"|"' || country || '"|' || format('{:.9f}', lat) || '|' || format('{:.9f}', lon) || '|' || population || ' ' || format('{:.3f}', km) AS value FROM won""", "places", "points")
def k7_gravity_transcript(v: Views) -> DataFrame:
    """Kilometres to three places instead of nine, which both engines give alike."""
    rows = nearest.nearest_by_gravity(v.points(), v.places())
    return metrics.transcript(rows, "qid", F.concat(metrics.place_line(), F.lit(" "), F.format_string("%.3f", "km")))


@query(_TABLE + """, q AS (SELECT p_partkey AS qid, substr(p_name, 1, 2) AS prefix, n_name AS country FROM part JOIN nation ON n_nationkey=p_partkey%25),
r AS (SELECT qid, t.name, row_number() OVER (PARTITION BY qid ORDER BY t.name) AS rank FROM q JOIN t ON t.country=q.country AND starts_with(t.name, q.prefix))
SELECT 'prefix "' || prefix || '" ' || country || ' -> ' || coalesce((SELECT string_agg('"' || name || '";', '' ORDER BY rank) FROM r WHERE r.qid = q.qid AND rank <= 10), '') AS value FROM q""", "places")  # fmt: skip
def k7_prefix_transcript(v: Views) -> DataFrame:
    q = v.sql("SELECT p_partkey AS qid, substr(p_name, 1, 2) AS prefix, n_name AS country, CAST(NULL AS INT) AS limit FROM part JOIN nation ON n_nationkey=p_partkey%25")
    rows = q.join(metrics.prefix_lines(names.prefixes(q, names.name_table(v.places()))), "qid", "left")
    return metrics.transcript(rows, "qid", metrics.lookup_line("prefix", "prefix", "country", F.coalesce("names", F.lit(""))))


_STEPS = "SELECT step, CAST(1000 + step * 38 AS BIGINT) AS scheduled, (1000 + step) / 7.0E0 AS achieved, step / 61.0E0 AS error_share, CAST(step AS BIGINT) AS dropped, CAST(step * 2 AS BIGINT) AS not_found, CAST(500 + step AS BIGINT) AS p50, CAST(1500000 + step * 10000 AS BIGINT) AS p90, CAST(12000 + step * 1000 AS BIGINT) AS p99, CAST(2500000000 + step * 1000000 AS BIGINT) AS p999, CAST(3000000000 AS BIGINT) AS slowest FROM (SELECT DISTINCT CAST(event_id%7 AS INT) AS step FROM events)"


@query("""SELECT step, lpad(format('{:.0f}', scheduled / 10.0E0), 11, ' ') || lpad(format('{:.1f}', achieved), 12, ' ') || lpad(format('{:.2f}', 100 * error_share), 6, ' ') || lpad(CAST(dropped AS VARCHAR), 9, ' ') || lpad(CAST(not_found AS VARCHAR), 6, ' ') ||
 lpad('1µs', 5, ' ') || lpad(rtrim(rtrim(format('{:.2f}', (1500000 + step * 10000) / 1000000.0E0), '0'), '.') || 'ms', 8, ' ') || lpad(CAST(12 + step AS VARCHAR) || 'µs', 6, ' ') || lpad(rtrim(format('{:.3f}', (2500 + step) / 1000.0E0), '0') || 's', 8, ' ') || lpad('3s', 5, ' ') AS line FROM (""" + _STEPS + """)
UNION ALL SELECT NULL, '  offered/s  achieved/s  err%  dropped  404s  p50     p90   p99   p99.9  max'""")
def k8_sweep_table(v: Views) -> DataFrame:
    return metrics.sweep_table(v.sql(_STEPS), 10)


@query("SELECT step, scheduled, achieved, error_share, p50, slowest FROM (" + _STEPS + ")")
def k8_sweep_json(v: Views) -> DataFrame:
    """Steps as JSON, read again."""
    read = metrics.sweep_json(v.sql(_STEPS)).select(F.from_json("body", "step int, scheduled long, achieved double, error_share double, p50 long, slowest long").alias("r"))
    return read.select("r.*")


@query(_won("km, row_id") + """SELECT qid, CAST(lat AS VARCHAR) || '|' || CAST(lon AS VARCHAR) AS place, won.name || '|' || country AS name, round(km*100)/100 AS distance_km, CASE WHEN qid%2=0 THEN population END AS population,
CASE WHEN qid%3=0 THEN admin1_code || '|' || coalesce(a.name, '') || '|' || admin2_code END AS admin FROM won LEFT JOIN admin1 a ON a.key = won.country || '.' || won.admin1_code""", "places", "points", "admin1")
def k5_response(v: Views) -> DataFrame:
    """Responses as JSON, read again: a field that isn't there is null."""
    found = nearest.with_admin(nearest.nearest(v.points(), v.places()), v.admin1())
    body = found.select("qid", requests.response(F.col("qid") % 2 == 0, F.col("qid") % 3 == 0).alias("body"))
    kinds = "Latitude double, Longitude double, Population long, Name string, Country string, distance_km double, admin1_code string, admin1_name string, admin2_code string"
    read = body.select("qid", F.from_json("body", kinds).alias("r")).select("qid", "r.*")
    admin = F.when(F.col("admin1_code").isNotNull(), F.concat("admin1_code", F.lit("|"), F.coalesce("admin1_name", F.lit("")), F.lit("|"), "admin2_code"))
    return read.select("qid", F.concat_ws("|", F.col("Latitude").cast("string"), F.col("Longitude").cast("string")).alias("place"), F.concat_ws("|", "Name", "Country").alias("name"), "distance_km", F.col("Population").cast("int").alias("population"), admin.alias("admin"))


@query(_TABLE + """, n1 AS (SELECT country, unnest([s_name, place]) AS name, row_id FROM (SELECT country, place, place AS s_name, row_id FROM postal) UNION ALL SELECT country, name, 100000000 + row_id FROM places),
u AS (SELECT country, name, 0 AS tier, row_id FROM t UNION ALL SELECT country, name, 1, row_id FROM n1)
SELECT country, name, CAST(min(tier) AS INT) AS tier, arg_min(row_id, tier * 1000000000000 + row_id) AS row_id FROM u GROUP BY ALL""", "places", "postal")  # fmt: skip
def u3_added_places(v: Views) -> DataFrame:
    """Names after additions: those of the build come first, whatever their row ids."""
    none = F.array().cast("array<string>")
    more = v.postal().select("country", F.col("place").alias("name"), none.alias("alt_names"), "row_id")
    again = v.places().select("country", "name", none.alias("alt_names"), (F.col("row_id") + 100_000_000).alias("row_id"))
    return names.name_table(v.places(), more.unionByName(again)).select("country", "name", "tier", "row_id")


@query("""WITH a AS (SELECT country, code, 'new ' || place AS place, row_id FROM postal WHERE row_id < 50), u AS (SELECT country, code, place, row_id FROM postal UNION ALL SELECT country, code, place, 1000000000 + row_id FROM a)
SELECT country, code, arg_max(place, row_id) AS place FROM u GROUP BY ALL""", "postal")  # fmt: skip
def t2_postal_upsert(v: Views) -> DataFrame:
    added = v.postal().where("row_id < 50").withColumn("place", F.concat(F.lit("new "), "place"))
    return postal.postal_table(v.postal(), added).select("country", "code", "place")


@query(_TABLE + """, n1 AS (SELECT country, unnest([s_name, place]) AS name, row_id FROM (SELECT country, place, place AS s_name, row_id FROM postal) UNION ALL SELECT country, name, 100000000 + row_id FROM places),
u AS (SELECT country, name, 0 AS tier, row_id FROM t UNION ALL SELECT country, name, 1, row_id FROM n1)
SELECT country, name, CAST(min(tier) AS INT) AS tier, arg_min(row_id, tier * 1000000000000 + row_id) AS row_id FROM u GROUP BY ALL""", "places", "postal")  # fmt: skip
def u3_runs(v: Views) -> DataFrame:
    """The same additions in five batches, one of them twice, over runs that have been merged and one that hasn't."""
    none = F.array().cast("array<string>")
    more = v.postal().select("country", F.col("place").alias("name"), none.alias("alt_names"), "row_id", "lat", "lon", F.lit(0).alias("population"))
    again = v.places().select("country", "name", none.alias("alt_names"), (F.col("row_id") + 100_000_000).alias("row_id"), "lat", "lon", "population")
    finder, added = Finder(v.places()), more.unionByName(again)
    for batch in (0, 1, 2, 2, 3, 4):
        finder.add_places(added.where(F.col("row_id") % 5 == batch), "batches", batch)
    return finder.names().select("country", "name", "tier", "row_id")


@query("""WITH u AS (SELECT n_name AS country, 'S' || CAST(s_suppkey%40 AS STRING) AS code, s_name AS place, s_suppkey AS version FROM supplier JOIN nation ON n_nationkey=s_nationkey
UNION ALL SELECT country, code, 'built', -1 FROM (SELECT DISTINCT country, code FROM postal WHERE row_id%2=0)), t AS (SELECT country, code, arg_max(place, version) AS place FROM u GROUP BY ALL)
SELECT event_id AS qid, place AS name FROM events JOIN nation ON n_nationkey=event_id%25 JOIN t ON t.country=n_name AND t.code='S' || CAST(event_id%50 AS STRING)""", "postal")  # fmt: skip
def t2_postal_stream(v: Views) -> DataFrame:
    """Postal rows come as a stream, their batch once more, then rows that are late; lookups see the last row of each key."""
    built = v.postal().where("row_id%2=0").withColumn("place", F.lit("built"))
    finder = Finder(v.places(), built)
    rows = v.spark.readStream.schema("s_suppkey long, s_name string, s_nationkey int").parquet(f"{v.dir}/supplier*.parquet")  # a stream takes a single file by a pattern alone
    nation = v.spark.read.parquet(f"{v.dir}/nation.parquet")
    code = F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string"))
    rows = rows.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("row_id"), F.col("n_name").alias("country"), code.alias("code"), F.col("s_name").alias("place"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    live.stream_postal(rows, finder, tables.scratch(v.spark, "checkpoint")).awaitTermination()
    finder.add_postal(v.postal().withColumn("place", F.lit("repeated")), "postal", 0)
    finder.add_postal(v.postal().where("row_id < 40").withColumn("place", F.lit("late")).withColumn("row_id", F.col("row_id") - 1000), "late", 0)
    q = v.sql("SELECT event_id AS qid, n_name AS country, 'S' || CAST(event_id%50 AS STRING) AS code FROM events JOIN nation ON n_nationkey=event_id%25")
    return finder.find_by_postal_code(q).select("qid", "name")


@query("""WITH b AS (SELECT event_id//20 AS batch_id, event_id%20 AS idx, event_id AS qid, event_id%503=0 AS bad FROM events), e AS (SELECT batch_id, min(idx) AS bad FROM b WHERE bad GROUP BY 1),
pairs AS (SELECT q.qid, """ + _KM + """ AS km, p.* FROM points q CROSS JOIN places p),
won AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN qid%2=0 THEN -population/(km*km+1) ELSE 0 END, km, row_id) = 1),
a AS (SELECT qid, name || '|' || CASE WHEN qid%2=0 THEN CAST(population AS VARCHAR) ELSE '' END || '|' || CASE WHEN qid%3=0 THEN admin1_code ELSE '' END AS answer FROM won)
SELECT b.batch_id, CAST(min(e.bad) AS INT) AS idx, CASE WHEN min(e.bad) IS NOT NULL THEN 'lat range' END AS error, CASE WHEN min(e.bad) IS NULL THEN string_agg(answer, ',' ORDER BY idx) END AS answers FROM b LEFT JOIN e USING (batch_id) LEFT JOIN a USING (qid) GROUP BY b.batch_id""", "places", "points")  # fmt: skip
def j16_mixed_batch(v: Views) -> DataFrame:
    """Batches whose points have ranks and includes of their own."""
    rows = v.sql("SELECT event_id DIV 20 AS batch_id, event_id%20 AS idx, CASE WHEN event_id%503=0 THEN 95.5E0 ELSE ((event_id*48611)%180001)/1000.0E0-90 END AS lat, ((event_id*15486719)%360001)/1000.0E0-180 AS lon, CASE WHEN event_id%2=0 THEN 'population' WHEN event_id%5=0 THEN 'distance' END AS rank, CASE WHEN event_id%3=0 THEN 'admin' END AS include FROM events")
    fields = ("lat", "lon", "rank", "include")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", *fields))), lambda p: F.struct(*(p[f].alias(f) for f in fields)))
    bodies = rows.groupBy("batch_id").agg(F.to_json(F.struct(ordered.alias("points"))).alias("body"))
    answers = Finder(v.places(), admin1=v.admin1()).batch(bodies)
    read = F.from_json("body", "results array<struct<Name string, Population long, admin1_code string>>")["results"]
    line = lambda x: F.concat(x["Name"], F.lit("|"), F.coalesce(x["Population"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(x["admin1_code"], F.lit("")))
    return answers.select("batch_id", "idx", "error", F.array_join(F.transform(read, line), ",").alias("answers"))


@query("SELECT reason, count(*) AS skipped, array_to_string(list_sort(list(line_no))[1:5], ',') AS first_lines FROM (SELECT line_no, CASE WHEN len(string_split(line, chr(9))) < 12 THEN 'too few fields' WHEN abs(try_cast(string_split(line, chr(9))[11] AS DOUBLE)) > 180 THEN 'coordinate out of range' END AS reason FROM (SELECT line_no, CASE WHEN line = '' AND line_no%2=0 THEN '   ' ELSE line END AS line FROM postal_lines) WHERE line <> '') WHERE reason IS NOT NULL GROUP BY reason", "postal_lines")
def a4_postal_skips(v: Views) -> DataFrame:
    """Empty lines are no rows; lines of spaces are short ones."""
    lines = tables.cut(v.postal_lines().withColumn("line", F.expr("CASE WHEN line = '' AND line_no%2=0 THEN '   ' ELSE line END")), "lines")
    return dumps.skip_report(dumps.parse_postal(lines)).withColumn("first_lines", F.array_join(F.col("first_lines").cast("array<string>"), ","))


@query("SELECT country || '.' || admin1_code AS key, arg_max(c_name, row_id) AS name FROM places WHERE row_id%7 <> 3 GROUP BY 1", "places")
def s6_admin1_last(v: Views) -> DataFrame:
    """Keys that come many times: the last line of each holds; lines without a name, or of spaces, are none."""
    lines = v.raw_places().select(F.col("row_id").alias("line_no"), F.when(F.col("row_id") % 7 == 3, F.when(F.col("row_id") % 2 == 0, "  ").otherwise(F.concat("country", F.lit("."), "admin1_code"))).otherwise(F.concat_ws("\t", F.concat_ws(".", "country", "admin1_code"), "c_name", "c_name", F.lit("1"))).alias("line"))
    return dumps.keep_last(dumps.kept(dumps.parse_admin1(lines)), "key").select("key", "name")


@query("SELECT qid, 'invalid coordinate' AS error FROM points WHERE qid%11=0 OR qid%13=0 OR abs(lat*1.2E0) > 90", "points")
def f12_invalid_points(v: Views) -> DataFrame:
    q = v.points().selectExpr("qid", "CASE WHEN qid%11=0 THEN NULL ELSE lat*1.2E0 END AS lat", "CASE WHEN qid%13=0 THEN CASE WHEN qid%2=0 THEN double('NaN') ELSE double('-Infinity') END ELSE lon*3 END AS lon")
    return nearest.invalid_points(q)


@query("SELECT p_partkey AS qid, CASE WHEN p_partkey%3 < 2 THEN substr(p_name, 1, p_partkey%3) || 'a' ELSE 'x' || substr(p_name, 2, 1) END AS mutated FROM part")
def x9_short_typo(v: Views) -> DataFrame:
    """Names of no, one and two characters."""
    rows = v.sql("SELECT p_partkey AS qid, substr(p_name, 1, CAST(p_partkey%3 AS INT)) AS name FROM part")
    return rows.select("qid", text.typo(F.col("name"), F.lit(0), F.lit(1)).alias("mutated"))


@query("""WITH b AS (SELECT event_id, props, list_reduce(list_transform(range(0, CAST(octet_length(encode(props)) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(props)), 2 * i + 1, 2)) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3582100097) ELSE r // 2 END, xor(c, b)), CAST(4294967295 AS BIGINT)) AS crc FROM events),
t AS (SELECT *, '"' || octet_length(encode(props)) || '-' || xor(crc, 4294967295) || '"' AS tag FROM b)
SELECT event_id AS qid, tag AS etag, event_id%4 IN (0, 1) AS unchanged FROM t""")
def x12_etag(v: Views) -> DataFrame:
    """Tags of JSON bodies, and whether clients that have them, weak or among others, or that have another one, need the body."""
    tag = http.etag(F.col("props"), F.lit(200), F.lit("GET"))
    rows = v.sql("SELECT event_id AS qid, props FROM events").withColumn("etag", tag)
    sent = F.when(F.col("qid") % 4 == 0, F.concat(F.lit("W/"), "etag")).when(F.col("qid") % 4 == 1, F.concat(F.lit('"x", '), "etag")).when(F.col("qid") % 4 == 2, F.lit('"1-2"'))
    return rows.select("qid", "etag", http.not_modified(F.col("etag"), sent).alias("unchanged"))


@query(_TABLE + "SELECT DISTINCT name FROM t", "places")
def u1_distinct_names(v: Views) -> DataFrame:
    return names.name_table(v.places()).select("name").distinct()


@query("SELECT p_partkey AS qid, CASE WHEN p_partkey%3=0 THEN substr(p_name,1,2) || 'x' || substr(p_name,4) WHEN p_partkey%3=1 THEN substr(p_name,1,2) || substr(p_name,4) ELSE substr(p_name,1,2) || 'q' || substr(p_name,3) END AS mutated FROM part", "places")
def x9_typo(v: Views) -> DataFrame:
    return v.sql("SELECT p_partkey AS qid, p_name FROM part").select("qid", text.typo(F.col("p_name"), F.col("qid") % 3, F.lit(3)).alias("mutated"))


@query("""SELECT qid, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f}', n/1024.0E0) || ' KiB' WHEN n < 1073741824 THEN format('{:.1f}', n/1048576.0E0) || ' MiB' ELSE format('{:.1f}', n/1073741824.0E0) || ' GiB' END AS size, format('{:,}', n) AS grouped
FROM (SELECT c_custkey AS qid, 1000 + c_custkey * 1048576 // 8 AS n FROM customer)""", "places")  # fmt: skip
def x10_formats(v: Views) -> DataFrame:
    n = v.sql("SELECT c_custkey AS qid, 1000 + c_custkey * 1048576 DIV 8 AS n FROM customer")
    return n.select("qid", text.byte_size(F.col("n")).alias("size"), text.thousands(F.col("n")).alias("grouped"))


@query(f"SELECT q.qid, p.row_id, round(({_KM})*100)/100 AS km, round(population/(pow({_KM},2)+1)*100)/100 AS score FROM points q JOIN places p ON p.row_id = q.qid%1500", "places", "points")
def x1_distance_and_score(v: Views) -> DataFrame:
    p = v.places().select("row_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "population")
    j = v.points().withColumn("row_id", F.col("qid") % 1500).join(p, "row_id").withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
    return j.select("qid", "row_id", geo.round2(F.col("km")).alias("km"), geo.round2(geo.gravity(F.col("population"), F.col("km"))).alias("score"))


@query(f"SELECT row_id, name, country, population FROM places ORDER BY {synthetic.uniform_sql(1, 'sample', 'row_id')}, row_id LIMIT 100", "places")
def s12_sample(v: Views) -> DataFrame:
    return synthetic.sample(v.places(), "row_id", 100).select("row_id", "name", "country", "population")


_U = lambda name: synthetic.uniform_sql(1, name)
_LIST = lambda values, u: f"[{', '.join(map(repr, values))}][CAST(floor({u} * {len(values)}) AS INT) + 1]"
_WORD = lambda p: "upper(substr(" + "||".join(_LIST(synthetic._SYLLABLES, _U(f"{p}{i}")) for i in range(3)) + ",1,1)) || substr(" + "||".join(_LIST(synthetic._SYLLABLES, _U(f"{p}{i}")) for i in range(3)) + ",2)"
_GAUSS = lambda a: f"sqrt(-2 * ln(1 - {_U(a + 'r')})) * cos(2 * pi() * {_U(a + 'a')})"
_CENTRE = lambda k, u: _LIST([float(c[k]) for c in synthetic._CENTRES], u)


@query(f"""SELECT id AS row_id, CASE WHEN {_U('homonym')} < 0.15 THEN 'Santa ' || {_LIST([x.title() for x in synthetic._SYLLABLES], _U('common'))} ELSE {_WORD('name')} END AS name, CASE WHEN {_U('alt')} < 0.25 THEN {_WORD('alt')} ELSE '' END AS alt,
 chr(CAST(65 + c // 26 AS INT)) || chr(CAST(65 + c % 26 AS INT)) AS country, round(CASE WHEN {_U('anywhere')} < 0.02 THEN degrees(asin(2 * {_U('wlat')} - 1)) ELSE greatest(-89.9, least(89.9, {_CENTRE(0, _U('centre'))} + {_GAUSS('lat')} * ({_CENTRE(2, _U('centre'))} / 3))) END, 6) AS lat,
 round(CASE WHEN {_U('anywhere')} < 0.02 THEN {_U('wlon')} * 360 - 180 ELSE {_CENTRE(1, _U('centre'))} + {_GAUSS('lon')} * ({_CENTRE(2, _U('centre'))} / 2) END, 6) AS lon, CAST(CASE WHEN {_U('empty')} < 1.0E0 / 3 THEN 0 ELSE trunc(least(3e7, 200 / pow(1 - {_U('pop')}, 1.1))) END AS INT) AS population
FROM (SELECT range AS id, CAST(floor({_U('country').replace('(id +', '(range +')} * {_U('country2').replace('(id +', '(range +')} * 250) AS INT) AS c FROM range(10000))""")
def s13_synthetic(v: Views) -> DataFrame:
    rows = synthetic.places(v.spark, 10_000)
    return rows.select("row_id", "name", F.coalesce(F.get("alt_names", F.lit(0)), F.lit("")).alias("alt"), "country", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "population")


@query(f"""SELECT range AS id, CASE WHEN u < 0.80 THEN 'nearest' WHEN u < 0.85 THEN 'gravity' WHEN u < 0.95 THEN 'name' ELSE 'postal' END AS kind, round(degrees(asin(2 * a - 1)), 6) AS lat, round(o * 360 - 180, 6) AS lon
FROM (SELECT range, {_U('kind').replace('(id +', '(range +')} AS u, {_U('lat').replace('(id +', '(range +')} AS a, {_U('lon').replace('(id +', '(range +')} AS o FROM range(10000))""")
def s14_workload(v: Views) -> DataFrame:
    return synthetic.workload(v.spark, 10_000).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


#: Bodies of batches, all but one in nine of them wrong in some way.
_BODY = """CASE event_id%9 WHEN 0 THEN good WHEN 1 THEN good || ' junk' WHEN 2 THEN good || good WHEN 3 THEN '{"points":[{"lat":"1","lon":2}]}' WHEN 4 THEN '{"points":[{"lat":1,"lon":2,"rank":5}]}' WHEN 5 THEN '{"points":[{"lat":1,"lon":2}],"limit":2}'
 WHEN 6 THEN '{"points":[]}' WHEN 7 THEN '{"points":[{"lat":1,"lon":2,"rankk":"distance"}]}' ELSE '{"points":[{"lat":1,"lon":2},{"lat":95,"lon":2},null]}' END"""


@query("""SELECT event_id AS batch_id, i AS idx, CASE WHEN i >= 0 THEN CASE WHEN event_id%9=0 THEN event_id%90 + 0.5E0 WHEN i=0 THEN 1E0 WHEN i=1 THEN 95E0 END END AS lat, CASE WHEN i < 0 THEN 'body' WHEN event_id%9=8 AND i=1 THEN 'lat range' WHEN event_id%9=8 AND i=2 THEN 'lat' END AS error
FROM (SELECT event_id, unnest(CASE event_id%9 WHEN 0 THEN [0] WHEN 8 THEN [0, 1, 2] ELSE [-1] END) AS i FROM events)""")
def s11_batch_bodies(v: Views) -> DataFrame:
    rows = v.sql("SELECT event_id FROM events").withColumn("good", F.expr("""'{"points":[{"LAT":' || CAST(event_id%90 AS STRING) || '.5,"lon":2,"rank":null}]}'"""))
    return requests.parse_batches(rows.select(F.col("event_id").alias("batch_id"), F.expr(_BODY).alias("body"))).select("batch_id", "idx", "lat", "error")


@query("SELECT qid, CASE WHEN qid%5=0 THEN '' ELSE 'S W' || qid END AS code, upper(country) AS country, CASE WHEN qid%5=0 THEN 'code' END AS error FROM name_queries", "name_queries")
def f14_postal_request(v: Views) -> DataFrame:
    q = v.name_queries().selectExpr("qid", "CASE WHEN qid%5=0 THEN '\u2028 ' ELSE '\u3000S W' || CAST(qid AS STRING) || '\t' END AS code", "'\t' || lower(country) AS country")
    k, c, e = requests.postal_request(F.col("code"), F.col("country"))
    return q.select("qid", k.alias("code"), c.alias("country"), e.alias("error"))


@query(_TABLE + """, q AS (SELECT p_partkey AS qid, substr(p_name, 1, 2) AS prefix, n_name AS country, p_partkey%5 AS raw FROM part JOIN nation ON n_nationkey=p_partkey%25)
SELECT qid, CAST(rank AS INT) AS rank, name FROM (SELECT qid, raw, t.name, row_number() OVER (PARTITION BY qid ORDER BY t.name) AS rank FROM q JOIN t ON t.country=q.country AND starts_with(t.name, q.prefix)) WHERE raw <> 0 AND rank <= CASE raw WHEN 1 THEN 10 ELSE raw END""", "places")  # fmt: skip
def f13_prefix_limit(v: Views) -> DataFrame:
    """Limits as text: none, numbers, and ones that a request can't have, which are answered with an error instead of names."""
    q = v.sql("SELECT p_partkey AS qid, substr(p_name, 1, 2) AS prefix, n_name AS country, CASE p_partkey%5 WHEN 0 THEN '51' WHEN 1 THEN '' ELSE CAST(p_partkey%5 AS STRING) END AS raw FROM part JOIN nation ON n_nationkey=p_partkey%25")
    k, e = requests.prefix_limit(F.col("raw"))
    return names.prefixes(q.withColumn("limit", k).where(e.isNull()), names.name_table(v.places())).select("qid", "rank", "name")


_ADDED = "SELECT row_id + 100000000 AS row_id, 'q' || substr(name, 2) AS name, 'yy' || substr(name, 3) AS alt, country FROM places WHERE row_id%3=0"


@query(_TABLE + f""", a AS ({_ADDED}), an AS (SELECT country, unnest([alt, name]) AS name, row_id, unnest([0, 1]) AS pos FROM a),
o AS (SELECT name, min(row_id * 2 + pos) AS since FROM an WHERE name NOT IN (SELECT name FROM t) GROUP BY name), u AS (SELECT country, name, 0 AS tier, row_id FROM t UNION ALL SELECT country, name, 1, row_id FROM an),
n2 AS (SELECT country, name, min(tier) AS tier, min(tier * 1000000000000 + row_id) % 1000000000000 AS row_id FROM u GROUP BY ALL), q AS (SELECT qid, CASE WHEN qid%2=0 THEN 'z' || substr(name, 2) ELSE substr(name, 1, 1) || 'yy' || substr(name, 4) END AS name, country FROM name_queries),
c AS (SELECT qid, n2.name AS matched, CAST(levenshtein(q.name, n2.name) AS INT) AS distance, CAST(tier AS INT) AS tier, row_id, coalesce(since, 0) AS since FROM q JOIN n2 USING (country) LEFT JOIN o ON o.name = n2.name WHERE levenshtein(q.name, n2.name) <= 2)
SELECT qid, matched, distance, tier, row_id FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, since, matched) = 1""", "places", "name_queries")
def u4_fuzzy_added(v: Views) -> DataFrame:
    """Typos of names of the build and of added ones: of equally near names those of the build come first, then added ones in their order."""
    added = v.sql(_ADDED, places=v.raw_places()).select("row_id", "name", F.array("alt").alias("alt_names"), "country")
    q = v.name_queries().selectExpr("qid", "CASE WHEN qid%2=0 THEN 'z' || substr(name, 2) ELSE substr(name, 1, 1) || 'yy' || substr(name, 4) END AS name", "country")
    return names.find(q, names.name_table(v.places(), added)).select("qid", "matched", "distance", "tier", "row_id")


@query("SELECT qid, CASE WHEN n = 0 THEN '0s' WHEN n < 1000 THEN n || 'ns' WHEN n < 1000000 THEN CAST(n // 1000 AS VARCHAR) || '.125µs' ELSE CAST(n // 1000000 AS VARCHAR) || '.5ms' END AS text FROM (SELECT event_id AS qid, CASE event_id%4 WHEN 0 THEN 0 WHEN 1 THEN event_id%999 + 1 WHEN 2 THEN (event_id%999 + 1) * 1000 + 125 ELSE (event_id%999 + 1) * 1000000 + 500000 END AS n FROM events)")
def x10_durations(v: Views) -> DataFrame:
    n = v.sql("SELECT event_id AS qid, CASE event_id%4 WHEN 0 THEN 0 WHEN 1 THEN event_id%999 + 1 WHEN 2 THEN (event_id%999 + 1) * 1000 + 125 ELSE (event_id%999 + 1) * 1000000 + 500000 END AS n FROM events")
    return n.select("qid", text.duration(F.col("n")).alias("text"))


@query("SELECT qid, round(2 * sin(least(qid * 20.0E0, pi() * 6371.0E0) / 12742.0E0), 9) AS chord FROM points", "points")
def x2_chord(v: Views) -> DataFrame:
    return v.points().select("qid", F.round(geo.chord(F.col("qid") * 20.0), 9).alias("chord"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["j7_admin"](spark, sf_dir)
