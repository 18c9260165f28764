"""Requests, responses and metrics at their edges."""

import json
import math
import random

from pyspark.sql import functions as F

from trigpoint.finder import Finder
from trigpoint.functions import http, text
from trigpoint.operators import metrics, nearest, requests
from trigpoint.sources import dumps

PLACE = "row_id long, name string, alt_names array<string>, country string, lat double, lon double, population int, admin1_code string, admin2_code string"


def test_ranks_by_selection(spark):
    r = random.Random(1)
    make = {1: lambda: r.randint(0, 9), 2: lambda: r.getrandbits(62), 3: lambda: -r.getrandbits(40), 4: lambda: 70_000 + r.randint(0, 3), 5: lambda: r.choice([0, 65_535, 65_536, 1 << 32])}
    rows = [(k, f()) for k, f in make.items() for _ in range(r.randint(1, 400))] + [(1, None), (None, 5), (6, 42)]
    shares = {"p50": (500, 1000), "p95": (950, 1000), "p999": (999, 1000), "least": (0, 1), "most": (1, 1)}
    got = {x.k2: x for x in metrics.nearest_ranks(spark.createDataFrame(rows, "k2 long, x long").repartition(5), "k2", "x", shares).collect()}
    for k in (*make, 6):
        own = sorted(x for j, x in rows if j == k and x is not None)
        for name, (a, b) in shares.items():
            assert got[k][name] == own[max(1, -(-len(own) * a // b)) - 1], (k, name)
    assert set(got) == {*make, 6} and metrics.nearest_ranks(spark.createDataFrame([], "k2 long, x long"), "k2", "x", shares).collect() == []


def test_ranks_of_many_values_hold_few_counts(spark):
    """Two hundred thousand different values: no pass has more than 65,536 counts of a step and share together."""
    rows = spark.range(200_000).select(F.lit(1).alias("step"), F.lit("served").alias("outcome"), (F.col("id") * 7_919_000_003 % 1_000_000_007_000).alias("latency_ns"))
    own = sorted(i * 7_919_000_003 % 1_000_000_007_000 for i in range(200_000))
    got = metrics.sweep(rows, 1).first()
    assert (got.p50, got.p99, got.p999, got.slowest) == (own[99_999], own[197_999], own[199_799], own[-1])


def plain_crc(body):
    crc = 0xFFFFFFFF
    for b in body:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xD5828281 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_tags(spark):
    bodies = ["", None, "a", '{"é": "日本"}', "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = [x.tag for x in rows.orderBy("i").select(http.etag(F.col("body")).alias("tag")).collect()]
    assert got == [f'"{len(b.encode())}-{plain_crc(b.encode())}"' if b else None for b in bodies]
    tag = '"3-17"'
    cases = [(tag, True), (f"W/{tag}", True), ("W/" + tag[2:], True), (f'"1-1", {tag}', True), ('"1-1"', False), (None, False), ("W/" + tag[1:], False), ("*", False)]
    sent = spark.createDataFrame([(i, tag, c) for i, (c, _) in enumerate(cases)], "i int, tag string, sent string")
    assert [x[0] for x in sent.orderBy("i").select(http.not_modified(F.col("tag"), F.col("sent"))).collect()] == [w for _, w in cases]
    other = rows.select(http.etag(F.col("body"), F.lit(404)).alias("a"), http.etag(F.col("body"), F.lit(200), F.lit("POST")).alias("b")).collect()
    assert {x for row in other for x in row} == {None}


def test_white_space_around_requests(spark):
    space = [chr(c) for c in range(0x3100) if chr(c).isspace() and c not in range(0x1C, 0x20)]
    rows = spark.createDataFrame([(i, f"{c}{c}a{c}b{c}") for i, c in enumerate(space)] + [(900, "\x1c a​"), (901, "　\t"), (902, None)], "i int, raw string")
    got = {x.i: x.t for x in rows.select("i", text.trimmed(F.col("raw")).alias("t")).collect()}
    assert [got[i] for i in range(len(space))] == [f"a{c}b" for c in space] and got[900] == "\x1c a​" and got[901] == "" and got[902] is None
    n, c, e = requests.name_request(F.col("raw"), F.lit(" fr\t"))
    assert {(x.n, x.c, x.e) for x in rows.where("i > 900").select(n.alias("n"), c.alias("c"), e.alias("e")).collect()} == {("", "FR", "name")}


def test_lines_of_spaces_are_short_rows(spark):
    lines = spark.createDataFrame([(1, ""), (2, "   "), (3, "AA\tx")], "line_no long, line string")
    assert [(x.row_id, x.reason) for x in dumps.parse_postal(lines).orderBy("row_id").collect()] == [(1, "blank"), (2, "too few fields"), (3, "too few fields")]
    assert [(x.row_id, x.reason) for x in dumps.parse_admin1(lines).orderBy("row_id").collect()] == [(1, "blank"), (2, "malformed"), (3, None)]


def test_typos_of_short_names(spark):
    rows = spark.createDataFrame([("",), ("é",), ("ab",)], "n string").select(text.typo(F.col("n"), F.lit(1), F.lit(1)))
    assert [x[0] for x in rows.collect()] == ["a", "éa", "b"]


def test_points_that_cannot_be_looked_up(spark):
    points = [(1, 90.0, 720.0), (2, 90.1, 0.0), (3, math.nan, 0.0), (4, 0.0, math.inf), (5, None, 1.0), (6, 1.0, None), (7, -90.0, -181.0)]
    q = spark.createDataFrame(points, "qid long, lat double, lon double")
    places = spark.createDataFrame([(0, "N", [], "AA", 1.0, 2.0, 5, "", "")], PLACE)
    bad = {x.qid for x in nearest.invalid_points(q).collect()}
    assert bad == {2, 3, 4, 5, 6} and {x.qid for x in nearest.nearest(q, places).collect()} == {1, 7}


def test_places_with_columns_of_results(spark):
    places = spark.createDataFrame([(0, "N", [], "AA", 1.0, 2.0, 5, "", "")], PLACE).withColumn("QID", F.lit(9)).withColumn("km", F.lit(8))
    q = spark.createDataFrame([(4, 1.0, 2.0)], "qid long, lat double, lon double")
    assert [(x.qid, x.km) for x in nearest.nearest(q, places).collect()] == [(4, 0.0)]
    assert [(x.qid, x.km) for x in nearest.nearest_by_gravity(q, places).collect()] == [(4, 0.0)]
    assert [(x.qid, x.km) for x in nearest.radius_join(q, places, 5.0).collect()] == [(4, 0.0)]


def test_batches(spark):
    places = spark.createDataFrame([(0, "Near", [], "AA", 1.0, 2.0, 0, "01", "2"), (1, "Big", [], "AA", 3.0, 2.0, 900_000, "", "")], PLACE)
    admin = spark.createDataFrame([("AA.01", "North")], "key string, name string")
    point = {"lat": 1.0, "lon": 2.1}
    good = [point, point | {"rank": "population"}, point | {"include": "admin"}, point | {"rank": "distance", "include": ""}]
    bodies = [(1, json.dumps({"points": good})), (2, json.dumps({"points": [point, {"lat": 99, "lon": 1}, {"lat": 1}]})), (3, "{"), (4, None), (5, json.dumps({"points": [point]}))]
    rows = spark.createDataFrame(bodies, "batch_id long, body string")
    got = {x.batch_id: x for x in Finder(places, admin1=admin).batch(rows).collect()}
    answers = json.loads(got[1].body)["results"]
    assert [(a["Name"], a.get("Population"), a.get("admin1_name")) for a in answers] == [("Near", None, None), ("Big", 900_000, None), ("Near", None, "North"), ("Near", None, None)]
    assert [(got[i].idx, got[i].error, got[i].body) for i in (2, 3, 4)] == [(1, "lat range", None), (-1, "body", None), (-1, "body", None)]
    none = {x.batch_id: x.body for x in Finder(places.limit(0)).batch(rows.where("batch_id IN (1, 3)")).collect()}
    assert none == {1: '{"results":[null,null,null,null]}', 3: None}
    assert {x.batch_id for x in Finder(places).batch(rows.where("batch_id = 3")).collect()} == {3}


def test_lines_have_an_order(spark):
    log = spark.createDataFrame([("/b", 200, 0.5), ("/a", 404, 0.25), ("/b", 500, 7.0), ("/a", 200, 0.125)], "path string, status int, seconds double").repartition(4)
    gauges = spark.createDataFrame([("z", 1.0), ("a", 2.0)], "name string, value double")
    lines = [x.line for x in metrics.exposition(metrics.request_counts(log), metrics.histogram(log), gauges).collect()]
    keys = [x for x in lines if not x.startswith("#") and "_bucket" not in x]
    assert keys == ['http_requests_total{path="/a",status="200"} 1', 'http_requests_total{path="/a",status="404"} 1', 'http_requests_total{path="/b",status="200"} 1', 'http_requests_total{path="/b",status="500"} 1',
        'http_request_duration_seconds_sum{path="/a"} 0.375', 'http_request_duration_seconds_count{path="/a"} 2', 'http_request_duration_seconds_sum{path="/b"} 7.5', 'http_request_duration_seconds_count{path="/b"} 2', "a 2", "z 1"]
    answers = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "qid long, v string").repartition(5)
    assert [x.value for x in metrics.transcript(answers, "qid", F.col("v")).collect()] == [f"v{i}" for i in range(50)]


def test_bodies_are_read_once_and_alike_however_they_are_written(spark, monkeypatch):
    """Bodies that are written plainly are read by their schema; the same come out as of others, which are taken apart."""
    n = ["0", "-0", "0.0", "-0.0", "90", "-90.5", "90.001", "12.3456789012345678", "95.5", "180.5", "007", "1.", ".5", "+1", "1e1", "1E400", "999", "1000", "null", '"1"', "true", "NaN"]
    points = [f'{{"lat":{a},"lon":{b}}}' for a in n for b in ("1.5", "-0.0")] + [f'{{"lat": 1.5, "lon": {b}}}' for b in n]
    points += [f'{{"lat":1,"lon":2{more}}}' for more in (',"rank":"population"', ', "rank": "x", "include": "admin"', ',"include":""', ',"include":"admin","rank":""', ',"rank":null', ',"rank":"a","rank":"a"', ',"Rank":"a"', ',"x":1', ',"rank":"\\u0061"', ",")]
    points += ['{"lon":1,"lat":2}', '{"lat":1}', "{}", "null", "1", '"x"', "\x01", '{"lat":1,"lon":2}\x01', '{"lat":1,"lat":1,"lon":2}', '{"LAT":1,"lon":2}', ""]
    good = '{"lat":1.25,"lon":-2.5}'
    bodies = [f'{{"points":[{p}]}}' for p in points] + [f'{{"points":[{good},{p},{good}]}}' for p in points] + [f'{{"points":[{",".join([good] * k)}]}}' for k in (0, 1, 99, 100, 101, 5000)]
    whole = f'{{"points":[{good}]}}'
    bodies += [None, "", "x", "\x01", f"{whole}\n", f" {whole}", whole + whole, whole + "x", whole[:-1] + ',"a":1}', f'{{"points":{good}}}', f'{{"Points":[{good}]}}', f"[{good}]", '{"points":[\x01]}', '{"points":null}', "null", f'{{"points":[{good}],"points":[{good}]}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "batch_id long, body string")
    read = requests.read_batches(rows)
    assert read._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    found = sorted(map(repr, read.collect()))
    plain = rows.where(requests._plain(F.col("body"))).count()
    assert 20 < plain < len(bodies) // 2
    monkeypatch.setattr(requests, "_plain", lambda body: F.lit(False))
    assert sorted(map(repr, requests.read_batches(rows).collect())) == found
