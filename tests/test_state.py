"""Builds, runs of additions, streams, prefix lists, numbers by range: what a table keeps, and what survives a writer that is lost."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trigpoint.finder import Finder
from trigpoint.operators import metrics, names, postal
from trigpoint.plans import ranges, tables
from trigpoint.plans.log import Conflict, Log
from trigpoint.plans.runs import Runs
from trigpoint.streaming import live

NAME = "country string, name string, tier int, row_id long"
PLACE = "row_id long, name string, alt_names array<string>, country string, lat double, lon double, population int, admin1_code string, admin2_code string"
POST = "row_id long, country string, code string, place string, lat double, lon double"


def brute_prefixes(rows, most):
    lists = defaultdict(list)
    for country, name, tier, row_id in rows:
        for n in range(len(name) + 1):
            lists[country, name[:n], tier].append((name, row_id))
    return {k: sorted(v, key=lambda x: x[0].encode())[:most] for k, v in lists.items()}


@pytest.mark.parametrize(("most", "block"), [(3, 7), (50, 64), (1, 20_000)])
def test_prefix_table_is_brute_force(spark, monkeypatch, most, block):
    monkeypatch.setattr(names, "_BLOCK", block)
    r = random.Random(most)
    rows = {(r.choice(["AA", "AA", "BB"]), "".join(r.choice("abé日") for _ in range(r.randint(0, 5))), r.choice([0, 0, 1])) for _ in range(300)}
    rows |= {("AA", f"common {i:03}", 0) for i in range(200)}  # a third of all names begin alike
    rows = [(*x, i) for i, x in enumerate(sorted(rows))]
    table = names.prefix_table(spark.createDataFrame(rows, NAME).repartition(5), most).collect()
    got = {(x.country, x.prefix, x.tier): [tuple(n) for n in x.names] for x in table}
    assert len(got) == len(table) and got == brute_prefixes(rows, most)


def test_prefixes_that_are_longer_than_lists(spark, monkeypatch):
    monkeypatch.setattr(names, "LONG", 4)
    rows = [("AA", n, t, i) for i, (n, t) in enumerate([("abcdefgh", 0), ("abcdexyz", 0), ("abcd", 0), ("abcdeaaa", 1), ("abc", 0)])]
    q = spark.createDataFrame([(1, "abcde", "AA", 2), (2, "abcd", "AA", None), (3, "abcdeaaaa", "AA", None), (4, "", "BB", None), (5, "abc", "AA", 0)], "qid long, prefix string, country string, limit int")
    got = defaultdict(list)
    for x in names.prefixes(q, spark.createDataFrame(rows, NAME)).orderBy("qid", "rank").collect():
        got[x.qid].append((x.rank, x.name))
    assert got == {1: [(1, "abcdefgh"), (2, "abcdexyz")], 2: [(1, "abcd"), (2, "abcdefgh"), (3, "abcdexyz"), (4, "abcdeaaa")]}
    assert names.prefix_table(spark.createDataFrame([], NAME)).collect() == []


def test_numbers_by_range(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "x", "x", None, "y"]), r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v string, _at int").repartition(7)
    got = ranges.numbered(df, "v", "id").collect()
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))
    assert [(x.id, x.pos) for x in sorted(got, key=lambda x: x.pos)] == [(x[0], k) for k, x in enumerate(order)]
    nth, seen = {}, Counter()
    for i, v, _ in rows:
        nth[i] = seen[v]
        seen[v] += 1
    assert {x.id: x.nth for x in ranges.places_among_equals(df, ["v"], "id").collect()} == nth
    plan = ranges.dense_ids(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and ranges.dense_ids(df.limit(0), "id").collect() == []


def test_remap(spark):
    kind = "row_id long, name string, size double"
    old = [(i, n, s) for i, (n, s) in enumerate([("a", 1.0), ("a", 1.0), (None, 2.0), ("b", None), ("a", 1.0), (None, None)])]
    new = [(100 - i, n, s) for i, n, s in old]
    a, b = (spark.createDataFrame(x, kind).repartition(3) for x in (old, new))
    got = {x.old_id: x.new_id for x in metrics.remap(a, b, ["name", "size"]).collect()}
    assert got == {0: 96, 1: 99, 4: 100, 2: 98, 3: 97, 5: 95}
    with pytest.raises(ValueError, match="old table alone has .*'b'"):
        metrics.remap(a, b.where("name IS NULL OR name <> 'b'"), ["name", "size"])
    with pytest.raises(ValueError, match="new table alone"):
        metrics.remap(a.where("row_id <> 4"), b, ["name", "size"])


def plain_crc(words):
    crc = 0
    for w in words:
        for bit in range(63, -1, -1):
            top = crc >> 63
            crc = (crc << 1 | w >> bit & 1) & (1 << 64) - 1
            crc ^= metrics.POLYNOMIAL if top else 0
    return crc


def test_ordered_fingerprint(spark):
    r = random.Random(9)
    words = [r.getrandbits(64) for _ in range(37)]
    import numpy as np

    assert metrics._crc(np.array(words, np.uint64)) == plain_crc(words)
    assert metrics._times(plain_crc(words[:20]), metrics._shift(17)) ^ plain_crc(words[20:]) == plain_crc(words)
    rows = [(i, r.choice(["x", None, "y"]), i / 3) for i in range(300)]
    make = lambda x, n: metrics.ordered_fingerprint(spark.createDataFrame(x, "at long, name string, v double").repartition(n), ["at"], ["name", "v"])
    whole = make(rows, 1)
    hashes = spark.createDataFrame(rows, "at long, name string, v double").select("at", F.xxhash64(F.col("name").isNull(), "name", F.col("v").isNull(), "v").alias("h")).orderBy("at").collect()
    assert whole == make(rows, 6) == (300, plain_crc([x.h % (1 << 64) for x in hashes]))
    swapped = [(rows[8][0], *rows[7][1:]) if i == 8 else (rows[7][0], *rows[8][1:]) if i == 7 else x for i, x in enumerate(rows)]
    assert make(swapped, 3) != whole and make(rows[1:], 2) != whole and make([], 1) == (0, 0)


def test_log_has_one_writer_a_number(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.read() == (0, {}) and log.commit(0, {"a": 1}) == 1 and log.read() == (1, {"a": 1})
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.commit(1, {"é": [3]}) == 3  # the number of the writer that lost is passed over
    assert Log(spark, str(tmp_path / "log")).read() == (3, {"é": [3]}) and log.at(1) == {"a": 1}


def one_table(spark, n):
    return {"postal": spark.createDataFrame([(i, "AA", str(i), f"place {i}", 1.0, 1.0) for i in range(n)], POST)}


def test_a_build_that_stops_leaves_the_old_answers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "build")
    with pytest.raises(ValueError, match="no build"):
        tables.load(spark, path)
    tables.save(one_table(spark, 5), path)
    old = tables.load(spark, path)["postal"]
    broken = one_table(spark, 9) | {"names": spark.range(1).select(F.raise_error(F.lit("lost")).alias("country"), F.lit("x").alias("name"))}
    with pytest.raises(Exception, match="lost"):
        tables.save(broken, path)
    assert tables.load(spark, path)["postal"].count() == 5
    tables.save(one_table(spark, 7), path)
    assert old.count() == 5 and tables.load(spark, path)["postal"].count() == 7  # who has the old one open stays with it
    assert tables.vacuum(spark, path, keep=1) == 2 and tables.load(spark, path)["postal"].count() == 7
    file = next(x for x in (tmp_path / "build").rglob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="postal isn't what was written"):
        tables.load(spark, path)
    monkeypatch.setattr(tables, "FORMAT", 99)
    with pytest.raises(ValueError, match="format"):
        tables.load(spark, path)


def test_runs_merge_in_levels(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"), postal.merge_postal, ("country", "code"), fanout=3)
    assert runs.read() is None
    r, want = random.Random(2), {}
    for batch in range(10):
        rows = [(r.randint(0, 10**6), "AA", str(r.randint(0, 12)), f"p{batch}.{i}", 1.0, None) for i in range(8)]
        for x in rows:
            want[x[2]] = max(want.get(x[2], (-1,)), (x[0], x[3]))
        assert runs.add(spark.createDataFrame(rows, POST), "s", batch)
        assert not runs.add(spark.createDataFrame([(10**9, "AA", "1", "again", 1.0, 1.0)], POST), "s", batch)
        got = [(x.code, x.row_id, x.place) for x in runs.read().collect()]
        assert sorted(got) == sorted((k, *v) for k, v in want.items())
        levels = Counter(x["level"] for x in runs.runs())
        assert max(levels.values()) < 3
    assert sorted(levels.items()) == [(0, 1), (2, 1)]
    assert runs.vacuum() > 0 and len(runs.read().collect()) == len(want)


def test_a_writer_that_is_lost_adds_nothing(spark, tmp_path, monkeypatch):
    runs = Runs(spark, str(tmp_path / "runs"), postal.merge_postal, ("country", "code"))
    one = lambda p: spark.createDataFrame([(1, "AA", "1", p, 1.0, 1.0)], POST)
    runs.add(one("a"), "s", 0)
    lost = Runs(spark, str(tmp_path / "runs"), postal.merge_postal, ("country", "code"))
    monkeypatch.setattr(lost.log, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        lost.add(one("z"), "s", 1)
    assert [x.place for x in runs.read().collect()] == ["a"]
    assert runs.add(one("z"), "s", 1) and [x.place for x in runs.read().collect()] == ["z"] and runs.vacuum() == 1


def test_streams_change_answers_and_go_on_from_a_checkpoint(spark, tmp_path):
    built = spark.createDataFrame([(0, "Ville", [], "FR", 1.0, 1.0, 5, "", "")], PLACE)
    codes = spark.createDataFrame([(0, "FR", "1", "built", 1.0, 1.0)], POST)
    additions = str(tmp_path / "additions")
    finder = Finder(built, codes, additions=additions)
    asked = spark.createDataFrame([(1, "Ville", "FR"), (2, "Town", "FR"), (3, "Twn", "FR"), (4, "Tower", "FR")], "qid long, name string, country string")
    post = spark.createDataFrame([(1, "1", "FR"), (2, "2", "FR")], "qid long, code string, country string")

    def arrive(k, places, rows):
        spark.createDataFrame(places, PLACE).coalesce(1).write.parquet(f"{tmp_path}/places/{k}")
        spark.createDataFrame(rows, POST).coalesce(1).write.parquet(f"{tmp_path}/post/{k}")
        live.stream_places(spark.readStream.schema(PLACE).parquet(f"{tmp_path}/places/*"), finder, f"{tmp_path}/cp1").awaitTermination()
        live.stream_postal(spark.readStream.schema(POST).parquet(f"{tmp_path}/post/*"), finder, f"{tmp_path}/cp2").awaitTermination()
        return {r.qid: (r.name, r.tier) for r in finder.find_by_name(asked).collect()}, {r.qid: r.name for r in finder.find_by_postal_code(post).collect()}

    got = arrive(1, [(7, "Town", ["Ville"], "FR", 2.0, 2.0, 1, "", "")], [(5, "FR", "1", "new", 1.0, 1.0)])
    assert got == ({1: ("Ville", 0), 2: ("Town", 1), 3: ("Town", 1), 4: ("Town", 1)}, {1: "new"})
    finder = Finder(built, codes, additions=additions)  # another driver goes on from the checkpoint
    got = arrive(2, [(8, "Tower", [], "FR", 2.0, 2.0, 1, "", "")], [(4, "FR", "1", "late", 1.0, 1.0), (9, "FR", "2", "two", 1.0, 1.0)])
    assert got == ({1: ("Ville", 0), 2: ("Town", 1), 3: ("Town", 1), 4: ("Tower", 1)}, {1: "new", 2: "two"})
    assert finder._names_added.log.read()[1]["batches"] == {"places": 1}
    assert not finder.add_places(spark.createDataFrame([(9, "Twn", [], "FR", 2.0, 2.0, 1, "", "")], PLACE), "places", 1)  # a batch that is delivered twice
    asked = spark.createDataFrame([(1, "T", "FR", None)], "qid long, prefix string, country string, limit int")
    assert [(r.rank, r.name, r.tier, r.place, r.lat) for r in finder.prefixes(asked).orderBy("rank").collect()] == [(1, "Tower", 1, "Tower", 2.0), (2, "Town", 1, "Town", 2.0)]
