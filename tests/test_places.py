"""Lookups against brute force in plain Python, and the rules of dumps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trigpoint.finder import Finder
from trigpoint.operators import metrics, names, nearest, postal, requests
from trigpoint.plans import tables
from trigpoint.plans.config import Config, feature_classes, load_config
from trigpoint.plans.log import Log
from trigpoint.sources import dumps, synthetic
from trigpoint.streaming import live

PLACE = "row_id long, name string, alt_names array<string>, country string, lat double, lon double, population int, admin1_code string, admin2_code string"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def some_places(spark, n=400, zero=0.3, seed=5):
    r = random.Random(seed)
    edge = [(90, 0), (-90, 10), (0, 180), (0, -180), (0, 179.5), (0, -179.5), (10, 20), (10, 20), (89.9, -90)]
    points = edge + [(math.degrees(math.asin(2 * r.random() - 1)), r.uniform(-180, 180)) for _ in range(n)]
    rows = [(i, f"p{i}", [], "AA", float(a), float(b), 0 if r.random() < zero else int(200 / (1 - r.random()) ** 1.1), "01", "") for i, (a, b) in enumerate(points)]
    return rows, spark.createDataFrame(rows, PLACE)


def some_points(spark, n=60, seed=6):
    r = random.Random(seed)
    edge = [(90, 77), (-90, 0), (0, 180), (0, -179.9), (10, 20), (85, 179)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(edge + [(math.degrees(math.asin(2 * r.random() - 1)), r.uniform(-180, 180)) for _ in range(n)])]
    return points, spark.createDataFrame(points, "qid long, lat double, lon double")


@pytest.mark.parametrize("crowd", [2, 24])
def test_nearest_is_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(nearest, "CROWD", crowd)
    rows, places = some_places(spark)
    points, queries = some_points(spark)
    got = {r.qid: (r.row_id, r.km) for r in nearest.nearest(queries, places).collect()}
    for qid, lat, lon in points:
        d, row = min((km((lat, lon), (p[4], p[5])), p[0]) for p in rows)
        assert abs(got[qid][1] - d) < 1e-6
        assert got[qid][0] == row or abs(km((lat, lon), rows[got[qid][0]][4:6]) - d) < 1e-6


@pytest.mark.parametrize("sent", [0, 300])
def test_search_over_shuffled_cubes(spark, monkeypatch, sent):
    """Levels that aren't sent: the same winners, and few cubes of a query are shuffled."""
    _, places = some_places(spark, 3000)
    _, queries = some_points(spark)
    made = nearest.cube_tables(places)
    want = [sorted(map(tuple, f(queries, places, made).select("qid", "row_id", "km").collect())) for f in (nearest.nearest, nearest.nearest_by_gravity)]
    monkeypatch.setattr(nearest, "SENT", sent)
    for f, rows in zip((nearest.nearest, nearest.nearest_by_gravity), want, strict=True):
        assert sorted(map(tuple, f(queries, places, made).select("qid", "row_id", "km").collect())) == rows
    plan = nearest.nearest(queries, places, made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") + plan.count("Window(") <= (sent > 0) * 2


@pytest.mark.parametrize(("zero", "crowd"), [(0.3, 3), (1.0, 24), (0.97, 24)])
def test_gravity_is_brute_force(spark, monkeypatch, zero, crowd):
    monkeypatch.setattr(nearest, "CROWD", crowd)
    rows, places = some_places(spark, zero=zero)
    points, queries = some_points(spark)
    got = {r.qid: r.row_id for r in nearest.nearest_by_gravity(queries, places).collect()}
    for qid, lat, lon in points:
        want = min((-p[6] / (km((lat, lon), p[4:6]) ** 2 + 1), km((lat, lon), p[4:6]), p[0]) for p in rows)
        own = rows[got[qid]]
        assert got[qid] == want[2] or math.isclose(-own[6] / (km((lat, lon), own[4:6]) ** 2 + 1), want[0], rel_tol=1e-9)


def test_radius_is_brute_force(spark):
    rows, places = some_places(spark)
    points, queries = some_points(spark)
    queries = queries.withColumn("reach", F.when(F.col("qid") % 3 == 0, 300.0).when(F.col("qid") % 3 == 1, 3000.0).otherwise(25000.0))
    got = {(r.qid, r.row_id) for r in nearest.radius_join(queries, places, "reach").collect()}
    want = {(q, p[0]) for q, lat, lon in points for p in rows if km((lat, lon), p[4:6]) <= (300, 3000, 25000)[q % 3]}
    assert got == want


def test_radius_sends_no_exploded_queries(spark):
    """Queries that Spark takes for small ones aren't small once they stand in the cubes around them."""
    rows, places = some_places(spark)
    points, queries = some_points(spark)
    for km_ in (0.5, 700.0, 19000.0):
        found = nearest.radius_join(queries, places, km_)
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.qid, r.row_id) for r in found.collect()} == {(q, p[0]) for q, lat, lon in points for p in rows if km((lat, lon), p[4:6]) <= km_}


def test_top_populations_has_the_whole_table(spark):
    rows, places = some_places(spark, 7000)
    want = sorted((-p[6], p[0]) for p in rows if p[6] > 0)[:4096]
    assert [(-r.population, r.row_id) for r in nearest.top_populations(places).collect()] == want and len(want) == 4096


def test_empty_places_and_bad_points(spark):
    _, places = some_places(spark)
    bad = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 91.0, 0.0), (4, 0.0, float("inf"))], "qid long, lat double, lon double")
    assert nearest.nearest(bad, places).count() == 0
    _, queries = some_points(spark, 3)
    assert nearest.nearest(queries, places.limit(0)).count() == 0
    assert nearest.nearest_by_gravity(queries, places.limit(0)).count() == 0


def test_cubes_of_crowded_places(spark):
    rows = [(i, 48.0 + i % 50 * 1e-3, 11.0 + i // 50 * 1e-3, i) for i in range(400)] + [(400 + i, 10.0, 10.0, 1) for i in range(40)] + [(500, -80.0, 100.0, 0)]
    places = spark.createDataFrame(rows, "row_id long, lat double, lon double, population int")
    cubes, leaves = nearest.cube_tables(places)
    counts = {r.cube: r["count"] for r in leaves.groupBy("cube").count().collect()}
    assert sum(counts.values()) == len(rows) and sorted(counts.values())[-1] == 40 and sorted(counts.values())[-2] <= nearest.CROWD
    q = spark.createDataFrame([(1, 48.0251, 11.0031), (2, 10.0, 10.0), (3, -10.0, -100.0), (4, 48.0, 11.0)], "qid long, lat double, lon double")
    assert {r.qid: r.row_id for r in nearest.nearest(q, places, (cubes, leaves)).collect()} == {1: 175, 2: 400, 3: 500, 4: 0}
    assert {r.qid: r.row_id for r in nearest.nearest_by_gravity(q, places, (cubes, leaves)).collect()}[3] == 399


def test_admin(spark):
    rows = spark.createDataFrame([(1, "AA", "01"), (2, "AA", ""), (3, "BB", "09")], "qid long, country string, admin1_code string")
    known = spark.createDataFrame([("AA.01", "North")], "key string, name string")
    assert {r.qid: r.admin1_name for r in nearest.with_admin(rows, known).collect()} == {1: "North", 2: "", 3: ""}
    assert {r.admin1_name for r in nearest.with_admin(rows, None).collect()} == {""}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def grams(w):
    p = "\0\0" + w + "\0\0"
    return {p[i : i + 3] for i in range(len(p) - 2)}


@pytest.mark.parametrize("d", [0, 1, 2])
def test_fuzzy_is_brute_force(spark, d):
    r = random.Random(d)
    words = sorted({"".join(r.choice("abcé日") for _ in range(r.randint(1, 9))) for _ in range(150)} | {"anna", "banana", "Zürich", "東京"})
    table = spark.createDataFrame([("AA", w, 0, i) for i, w in enumerate(words)], "country string, name string, tier int, row_id long")
    asked = [r.choice(words) for _ in range(60)] + ["".join(r.choice("abcé日") for _ in range(r.randint(1, 9))) for _ in range(60)]
    queries = spark.createDataFrame([(i, w, "AA") for i, w in enumerate(asked)], "qid long, name string, country string")
    got = {x.qid: (x.distance, x.matched) for x in names.fuzzy(queries, table, d).collect()}
    for i, q in enumerate(asked):
        near = [(edits(q, w), w.encode()) for w in words if edits(q, w) <= d and grams(q) & grams(w)]
        assert got.get(i, (None,))[0] == (min(near)[0] if near else None)
        if near:
            assert got[i][1].encode() == min(near)[1]


def test_names_homonyms_additions_prefixes(spark):
    places = spark.createDataFrame([(0, "Ville", ["Town", ""], "FR", 1.0, 1.0, 5, "", ""), (1, "Town", [], "FR", 2.0, 2.0, 9, "", ""), (2, "Tower", [], "FR", 2.0, 2.0, 9, "", ""), (3, "Town", [], "GB", 2.0, 2.0, 9, "", "")], PLACE)
    added = spark.createDataFrame([(0, "Town", [], "FR", 7.0, 7.0, 1, "", ""), (1, "Tosa", [], "FR", 7.0, 7.0, 1, "", "")], PLACE)
    finder = Finder(places)
    queries = spark.createDataFrame([(1, "Town", "FR"), (2, "Tosa", "FR"), (3, "Twn", "FR"), (4, "town", "GB"), (5, "Town", "XX"), (6, "Ton", "FR")], "qid long, name string, country string")
    got = {r.qid: (r.matched, r.row_id, r.tier) for r in names.find(queries, finder.names()).collect()}
    assert got[1] == ("Town", 0, 0) and got[3] == ("Town", 0, 0) and got[4] == ("Town", 3, 0) and 5 not in got
    finder.add_places(added)
    got = {r.qid: (r.name, r.lat) for r in finder.find_by_name(queries).collect()}
    assert got[1] == ("Ville", 1.0) and got[2] == ("Tosa", 7.0)
    asked = spark.createDataFrame([(1, "To", "FR", None), (2, "Tow", "FR", 1), (3, "Towe", "FR", 99), (4, "", "FR", None), (5, "q", "FR", None)], "qid long, prefix string, country string, limit int")
    got = {}
    for r in sorted(finder.prefixes(asked).collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append(r.name)
    assert got == {1: ["Tower", "Town", "Tosa"], 2: ["Tower"], 3: ["Tower"], 4: ["", "Tower", "Town", "Ville", "Tosa"]}


def test_postal_last_row_wins(spark):
    rows = spark.createDataFrame([(0, "AA", "1", "old", 1.0, 1.0), (5, "AA", "1", "new", 2.0, 2.0)], "row_id long, country string, code string, place string, lat double, lon double")
    more = spark.createDataFrame([(0, "AA", "1", "newest", 3.0, 3.0)], rows.schema)
    q = spark.createDataFrame([(1, "1", "AA"), (2, "1", "BB")], "qid long, code string, country string")
    assert [(r.qid, r.name, r.population) for r in postal.by_postal_code(q, postal.postal_table(rows)).collect()] == [(1, "new", 0)]
    assert [r.name for r in postal.by_postal_code(q, postal.postal_table(rows, more)).collect()] == ["newest"]


def line(name="N", alts="", lat="1", lon="2", cls="P", country="AA", a1="01", a2="", pop="7"):
    return "\t".join(["1", name, "", alts, lat, lon, cls, "", country, "", a1, a2, "", "", pop, "", "", "", ""])


def test_place_dump(spark, tmp_path):
    cases = [
        (line(), 7), (line(pop=""), 0), (line(pop="abc"), 0), (line(pop="2147483648"), 0), (line(pop="-3000000000"), 0), (line(pop="-5"), "population negative"), (line(name=""), "field missing"), ("", "feature class"),
        (line(lat="91"), "coordinate out of range"), (line(lat="NaN"), "coordinate out of range"), (line(lon="inf"), "coordinate out of range"), (line(lat=" 1.5"), "coordinate can't be read"), (line(lat="1.5d"), "coordinate can't be read"),
        (line(lat="90", lon="-180"), 7), (line(name='say "x"'), 7), (line(name="bare\rreturn"), 7), (line(cls="A"), "feature class"), (line(cls="S"), "feature class"), ("x" * (1 << 20) + "y", "line too long"), (line(pop="+3"), 3),
    ]
    path = tmp_path / "places.txt"
    path.write_bytes("\r\n".join(["﻿" + cases[0][0], *(c[0] for c in cases[1:])]).encode() + b"\r\n")
    parsed = dumps.parse_places(dumps.read_lines(spark, str(path)), ["P", "A"], True)
    got = {r.row_id: r for r in parsed.collect()}
    for i, (_, want) in enumerate(cases, 1):
        assert got[i].reason == (want if isinstance(want, str) else None), (i, got[i])
        if not isinstance(want, str):
            assert got[i].population == want
    assert got[16].name == "bare\rreturn" and got[15].name == 'say "x"'
    report = dumps.skip_report(parsed).collect()
    assert [(r.reason, r.skipped, r.first_lines) for r in report][:2] == [("population negative", 1, [6]), ("field missing", 1, [7])]
    assert dumps.load_places(spark, str(path), limit=2, include=["P"]).count() == 2
    with pytest.raises(ValueError, match="feature classes"):
        dumps.load_places(spark, "/nowhere", include=["p"])
    (tmp_path / "none.txt").write_text("")
    with pytest.raises(ValueError, match="no place"):
        dumps.load_places(spark, str(tmp_path / "none.txt"))


def test_build_and_open(spark, tmp_path):
    (tmp_path / "places.txt").write_text(line(alts="B,C") + "\n" + line(name="Far", lat="50") + "\n")
    post = "\t".join(["AA", "1", "Place", *[""] * 6, "1", "2", "x"])
    (tmp_path / "postal.txt").write_text(f"{post}\textra\n\n{post.replace('Place', 'Last')}\nAA\t2\n")
    (tmp_path / "admin.txt").write_text("AA.01\tNorth\tNorth\t1\nbroken\n")
    (tmp_path / "c.json").write_text('{"places": "places.txt", "postal": "postal.txt", "admin1": "admin.txt", "output": "out", "other": 1}')
    with pytest.warns(UserWarning, match="other"):
        finder = Finder.build(spark, load_config(str(tmp_path / "c.json")))
    assert set(finder.prepared) == {"names", "grams", "gram_counts", "prefixes", "cubes", "leaves"}
    asked = spark.createDataFrame([(1, "N", "AA")], "qid long, name string, country string")
    assert [r.row_id for r in finder.find_by_name(asked).collect()] == [1]
    plan = finder.find_by_name(asked)._jdf.queryExecution().executedPlan().toString()
    assert "alt_names" not in plan  # names aren't made from places again
    q = spark.createDataFrame([(1, 2.0, 2.0)], "qid long, lat double, lon double")
    assert [(r.name, r.admin1_name) for r in finder.nearest(q, admin=True).collect()] == [("N", "North")]
    assert [r.name for r in finder.nearest(q, "population").collect()] == ["N"]
    with pytest.raises(ValueError):
        finder.nearest(q, "size")
    codes = spark.createDataFrame([(1, "1", "AA")], "qid long, code string, country string")
    assert [r.name for r in finder.find_by_postal_code(codes).collect()] == ["Last"]
    log = Log(spark, str(tmp_path / "out/_log"))
    log.commit(log.read()[0], {"format": 0, "folder": "", "tables": {}})
    with pytest.raises(ValueError, match="format"):
        tables.load(spark, str(tmp_path / "out"))


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("\n".join(f"line {i}" for i in range(1, 5001)) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = dumps.read_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3 and all(r.line == f"line {r.line_no}" for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_config():
    assert feature_classes(" p, A,,p") == ["P", "A"]
    for bad in ("PA", "x"):
        with pytest.raises(ValueError):
            feature_classes(bad)
    with pytest.raises(ValueError):
        Config("a", "a", "b")
    with pytest.raises(ValueError):
        Config("", "a", "b")


def test_requests(spark):
    bodies = [
        (1, '{"points": [{"lat": 1, "lon": 2}, {"lat": 95, "lon": 2}, {"lat": null, "lon": 2}]}'), (2, '{"points": []}'), (3, '{"points": [{"lat": 1, "lon": 2, "more": 1}]}'), (4, "nonsense"),
        (5, '{"points": [{"lat": 1, "lon": 2, "rank": "population", "include": "admin"}]}'), (6, '{"points": [{"lat": 1, "lon": 2}], "x": 1}'), (7, None), (8, '{"points": [{"lat": 1}]}'),
    ]
    points = requests.parse_batches(spark.createDataFrame(bodies, "batch_id long, body string"))
    errors = {r.batch_id: (r.idx, r.error) for r in requests.first_errors(points).collect()}
    assert errors[1] == (1, "lat range") and errors[8] == (0, "lon") and 5 not in errors
    assert {b for b, e in errors.items() if e == (-1, "body")} >= {2, 3, 4, 6, 7}
    good = '{"points":[{"lat":1,"lon":2}]}'
    wrong = [good + " x", good + good, good + "," + good, good + "],[{}", "[" + good + "]", "", "null", "[]", good[:-1], good.replace('"', "'"), good.replace("1", '"1"'), good.replace("1", "NaN"), good.replace("1", "01"), good.replace("1", "1e999"),
             good.replace("1", "true"), good.replace("1", "[1]"), good.replace("[", '"').replace("]", '"'), good.replace("2}", '2,"rank":5}'), good.replace("2}", '2,"include":{}}'), good.replace("2}", '2,"ranks":""}'), good.replace("{\"lat", "[{\"lat").replace("2}", "2}]")]
    right = [" " + good + "\n", good.replace("lat", "LAT"), good.replace("1", "1e0"), good.replace("2}", '2,"rank":null}'), good.replace("1", "100000000000000000000")]
    got = {(r.batch_id, r.idx): r.error for r in requests.parse_batches(spark.createDataFrame(list(enumerate(wrong + right)), "batch_id long, body string")).collect()}
    assert [got.get((i, -1)) for i in range(len(wrong))] == ["body"] * len(wrong) and len(got) == len(wrong) + len(right)
    assert [got[i, 0] for i in range(len(wrong), len(wrong) + len(right))] == [None] * 4 + ["lat range"]
    limits = spark.createDataFrame([("",), ("0",), ("51",), ("7",), ("x",), (None,)], "raw string").select(*(c.alias(n) for c, n in zip(requests.prefix_limit(F.col("raw")), ("k", "e"), strict=True))).collect()
    assert [(r.k if r.e is None else r.e) for r in limits] == [10, "limit", "limit", 7, "limit", 10]


def test_fuzzy_names_that_were_added(spark):
    kind = "row_id long, name string, alt_names array<string>, country string"
    built = spark.createDataFrame([(1, "Zown", [], "FR"), (2, "Aowns", [], "DE"), (3, "Other", None, "FR")], kind)
    added = spark.createDataFrame([(10, "Aown", ["Town2", "Bown"], "FR"), (11, "a", [], "FR"), (12, "Aowns", [], "FR"), (13, "Bown", [], "DE")], kind)
    asked = [("Town", "FR", "Zown"), ("b", "FR", "a"), ("Cown", "FR", "Zown"), ("Cown", "DE", "Bown"), ("Bowns", "FR", "Aowns"), ("Town21", "FR", "Town2"), ("zzzzzz", "FR", None), ("Aown", "FR", "Aown"), ("Bwn", "FR", "Bown")]
    q = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(asked)], "qid long, name string, country string")
    table = names.name_table(built, added)
    for grams in (None, names.gram_table(table)):
        got = {r.qid: r.matched for r in names.find(q, table, grams).collect()}
        assert [got.get(i) for i in range(len(asked))] == [want for *_, want in asked]


def test_metrics(spark):
    samples = spark.createDataFrame([(1, "served", i) for i in range(1, 101)] + [(1, "failed", 5), (1, "dropped", 5), (2, "failed", 1)], "step int, outcome string, latency_ns long")
    got = {r.step: r for r in metrics.sweep(samples, 10).collect()}
    assert (got[1].p50, got[1].p99, got[1].slowest, got[1].achieved) == (50, 99, 100, 10.0) and got[2].p50 is None and got[2].error_share == 1.0
    a = synthetic.places(spark, 200)
    assert metrics.fingerprint(a).collect() == metrics.fingerprint(a.repartition(7)).collect()
    assert metrics.difference(a.drop("alt_names"), a.drop("alt_names").limit(199)).collect()[0]["side"] == "left"


def test_synthetic_is_the_same_on_any_partitions(spark):
    a = sorted(map(str, synthetic.places(spark, 500).collect()))
    assert len(set(a)) == 500
    kinds = {r.kind: r["count"] for r in synthetic.workload(spark, 4000).groupBy("kind").count().collect()}
    assert 0.76 < kinds["nearest"] / 4000 < 0.84 and set(kinds) == {"nearest", "gravity", "name", "postal"}
    assert [r.row_id for r in synthetic.sample(synthetic.places(spark, 500), "row_id", 5).collect()] == [r.row_id for r in synthetic.sample(synthetic.places(spark, 500).repartition(3), "row_id", 5).collect()]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "Town", "FR"), (2, "None", "FR")], "qid long, name string, country string").write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("FR", "Town", 0, 4)], "country string, name string, tier int, row_id long")
    stream = spark.readStream.schema("qid long, name string, country string").parquet(str(tmp_path / "in"))
    q = live.answer_names(stream, table).writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.row_id for r in spark.sql("SELECT * FROM answers").collect()] == [4]
    batches = []
    stream = spark.readStream.schema("qid long, name string, country string").parquet(str(tmp_path / "in"))
    live.add_each_batch(stream, lambda rows, source, batch: batches.append((rows.count(), source, batch)), str(tmp_path / "cp"), "here").awaitTermination()
    assert batches == [(2, "here", 0)]


def test_queries_have_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"j1_nearest", "j2_gravity", "j10_find_by_name"} <= set(entry.oracle_sql())
