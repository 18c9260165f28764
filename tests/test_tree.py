"""The tree of cubes against plain counting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_places import some_places, some_points

from trigpoint.operators import nearest, pages


def ids(df):
    return {r.qid: r.row_id for r in df.collect()}


def above(cube, level):
    """The cube around a cube at a level."""
    bits = 18
    own, axes = cube >> 3 * bits, [cube >> k * bits & (1 << bits) - 1 for k in (2, 1, 0)]
    x, y, z = (c >> 2 * (own - level) for c in axes)
    return level << 3 * bits | x << 2 * bits | y << bits | z


def test_leaves_are_the_largest_cubes_that_are_not_crowded(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CROWD", 5)
    monkeypatch.setattr(nearest, "_BLOCK", 7)  # most places stand next to a block's end
    rows, places = some_places(spark)
    town = places.limit(60).withColumn("lat", 48 + F.col("row_id") * 1e-5).withColumn("lon", F.lit(11.0)).withColumn("row_id", F.col("row_id") + 1000)
    lost = places.limit(1).withColumn("lat", F.lit(None).cast("double")).withColumn("row_id", F.lit(5000).cast("long"))
    cubes, leaves = nearest.cube_tables(places.unionByName(town).unionByName(lost))
    own = {r.row_id: r.cube for r in leaves.collect()}
    assert len(own) == len(rows) + 60  # a place without a point is in no cube
    inside = Counter(above(c, level) for c in own.values() for level in range(1, (c >> 54) + 1))
    for c in set(own.values()):
        assert inside[c] <= 5 or c >> 54 == nearest.LAST
        assert all(inside[above(c, level)] > 5 for level in range(1, c >> 54))
    reached = max(c >> 54 for c in own.values())
    want = {(level, above(c, level - 1) if level > 1 else 0, above(c, level)) for c in own.values() for level in range(1, (c >> 54) + 1)}
    want |= {(level, c, c) for c in own.values() for level in range((c >> 54) + 1, reached + 1)}
    found = [(r.level, r.parent, r.cube) for r in cubes.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_a_cube_knows_its_most_populous_place(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CROWD", 3)
    rows, places = some_places(spark)
    cubes, leaves = nearest.cube_tables(places)
    most = {r.cube: r.p for r in leaves.groupBy("cube").agg(F.max("population").alias("p")).collect()}
    found = cubes.collect()
    assert all(r.most == most[r.cube] for r in found if r.cube in most) and len({r.cube for r in found}) > len(most)
    have = {(p[4], p[5]): 0 for p in rows}
    for p in rows:
        have[p[4], p[5]] = max(have[p[4], p[5]], p[6])
    assert all(have[r.lat, r.lon] >= r.most for r in found)


def test_levels_that_are_not_sent_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CROWD", 3)
    _, places = some_places(spark)
    _, queries = some_points(spark)
    built = nearest.cube_tables(places)
    sent = [ids(f(queries, places, built)) for f in (nearest.nearest, nearest.nearest_by_gravity)]
    for most in (0, 60):  # none is sent; the first level alone is
        monkeypatch.setattr(nearest, "SENT", most)
        assert [ids(f(queries, places, built)) for f in (nearest.nearest, nearest.nearest_by_gravity)] == sent


def shuffled(df):
    """Rows that Spark writes to shuffles for df, in which broadcasts have none."""
    df.collect()

    def rows(node):
        name = node.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            return 0
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return sum(map(rows, inner)) + (node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0)

    return rows(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("find", [nearest.nearest, nearest.nearest_by_gravity])
def test_queries_are_shuffled_few_times(spark, monkeypatch, find):
    """Where the tree is too large to be sent, however deep it is where a town stands, or many are at one point."""
    _, places = some_places(spark, 3000)
    town = places.limit(60).withColumn("lat", 48 + F.col("row_id") * 1e-5).withColumn("lon", F.lit(11.0)).withColumn("row_id", F.col("row_id") + 10_000)
    crowd = places.limit(60).withColumn("lat", F.lit(-20.0)).withColumn("lon", F.lit(30.0)).withColumn("row_id", 20_000 - F.col("row_id"))
    places = places.unionByName(town).unionByName(crowd)
    _, queries = some_points(spark, 4000)
    near = spark.createDataFrame([(10_000, 48.0003, 11.0), (10_001, -20.0, 30.0), (10_002, -20.001, 30.0)], queries.schema)
    queries = queries.unionByName(near)
    built = nearest.cube_tables(places)
    assert built[0].agg(F.max("level")).first()[0] == nearest.LAST
    want = ids(find(queries, places, built))
    assert len(want) == queries.count()
    monkeypatch.setattr(nearest, "SENT", 540)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = find(queries, places, built)
        n = shuffled(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids(found) == want
    assert n <= 9 * queries.count()  # populations are very uneven here, so a query meets several pages by gravity


@pytest.mark.parametrize("find", [nearest.nearest, nearest.nearest_by_gravity])
def test_queries_stand_in_no_row_for_each_cube(spark, monkeypatch, find):
    """Where the tree is too large to be sent: a query is met by pages as a whole, those in no page and those far from all places too."""
    _, places = some_places(spark, 3000)
    places = places.where("lon < 40 OR abs(lat) > 60")  # a sea
    crowd = places.limit(60).withColumn("lat", F.lit(-20.0)).withColumn("lon", F.lit(30.0)).withColumn("row_id", 20_000 - F.col("row_id"))
    places = places.unionByName(crowd)
    _, queries = some_points(spark, 4000)
    queries = queries.unionByName(queries.withColumns({"qid": F.col("qid") + 10_000, "lon": F.col("lon") + 720}))
    built = nearest.cube_tables(places)
    want = ids(find(queries, places, built))
    monkeypatch.setattr(nearest, "SENT", 540)
    found = find(queries, places.select("row_id"), built)
    assert shuffled(found) <= 4.5 * queries.count() and ids(found) == want and len(want) == queries.count()
    monkeypatch.setattr(pages, "_PAIRS", 500)
    assert ids(find(queries, places.select("row_id"), built)) == want
