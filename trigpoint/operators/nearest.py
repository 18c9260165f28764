"""Nearest places, by distance and by gravity, and places within a radius.

Points are unit vectors in cubes. A search within a radius uses cubes as wide as its chord: what lies within the radius is in the
27 cubes around a query, so it is an equi-join on cubes and needs no case for poles or the date line.

Searches for the best place use a tree of cubes, each a quarter as wide as the one around it, down to cubes of few places. A
cube knows one place of its own, its most populous, and how far from a query it begins. The place gives what a query reaches at least, first those
of the cubes around the query itself; cubes that can't reach it are left out, the others are opened, a level at a time for all queries together. So a
query far from all places meets as few of them as one in a city, and no cube holds more than CROWD places unless they stand within metres of each other.

Where the tree is too large to be sent, places are dealt into pages, the undivided cubes of a coarser tree that isn't (see pages.py).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.geo import RADIUS, chord, gravity, haversine_km, unit_vector
from ..plans.ranges import numbered
from ..plans.tables import cut
from .pages import Pages

#: Places of the table of top populations.
TABLE = 4096
_WIDER = 1 + 1e-9
_FARTHEST = math.pi * RADIUS
#: Where radii are a column, widths of cubes are chords of 1 km times powers of this.
_STEP = 2.0


def _cube(lat: Column, lon: Column, width: Column) -> list[Column]:
    return [F.floor(v / width).cast("int") for v in unit_vector(lat, lon)]


def _around(cell: Column) -> Column:
    return F.array(cell - 1, cell, cell + 1)


def _width(level: Column) -> Column:
    return chord(F.least(F.pow(F.lit(_STEP), level), F.lit(_FARTHEST))) * _WIDER


def radius_join(queries: DataFrame, places: DataFrame, km: str | float) -> DataFrame:
    """(qid, km, and the columns of places) for places at most so many km from a query's point; km may be a column of queries.

    Queries without a point or with a null or negative radius find nothing. One radius for all gives cubes of its own width; radii
    of a column are dealt to levels of widths, and places are entered on each level that occurs.
    """
    if isinstance(km, str):
        reach = F.col(km)
        level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(reach, F.lit(1.0))) / math.log(_STEP))).cast("int")
    else:
        reach, level = F.lit(float(km)), F.lit(0)
    width = _width if isinstance(km, str) else lambda _: F.lit(chord(min(max(1.0, float(km)), _FARTHEST)) * _WIDER)
    q = queries.where(reach >= 0).select("qid", F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"), (reach * _WIDER).alias("_reach"), level.alias("_level"))
    levels = [r[0] for r in q.select("_level").distinct().collect()] if isinstance(km, str) else [0]  # the logarithm of the largest radius at most
    q = q.withColumns({f"_v{axis}": v / width(F.col("_level")) for axis, v in zip("xyz", unit_vector(F.col("_qlat"), F.col("_qlon")), strict=True)})
    far, near = F.lit(0.0), F.lit(0.0)  # of a cube, squares of its farthest and nearest distance from the centre of the earth
    off = F.lit(0.0)  # and of its distance from the query, in widths
    for axis in "xyz":
        at, own = F.col(f"_{axis}"), F.col(f"_v{axis}")
        q = q.withColumn(f"_{axis}", F.explode(_around(F.floor(own).cast("int"))))
        off += F.pow(F.greatest(at - own, own - at - 1, F.lit(0.0)), F.lit(2))
        near += F.pow(F.greatest(at, -at - 1, F.lit(0)), F.lit(2))
        far += F.pow(F.greatest(F.abs(at), F.abs(at + 1)), F.lit(2))
    # most of the 27 are too far off, or hold no part of the surface; 1e-6 is more than rounding makes
    surface = F.pow(width(F.col("_level")), F.lit(-2))
    q = q.where((off <= 1 + 1e-6) & (near <= surface * (1 + 1e-6)) & (far >= surface * (1 - 1e-6))).drop("_vx", "_vy", "_vz")
    own_columns = _own_columns(places)
    p = places.select(own_columns).withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0]))))
    for axis, c in zip("xyz", _cube(F.col("lat"), F.col("lon"), width(F.col("_level"))), strict=True):
        p = p.withColumn(f"_{axis}", c)
    # Spark reckons queries as small as they were before they were exploded, and would send all of them through the driver
    hit = q.hint("merge").join(p, ["_level", "_x", "_y", "_z"]).withColumn("km", haversine_km(F.col("_qlat"), F.col("_qlon"), F.col("lat"), F.col("lon")))
    return hit.where(F.col("km") <= F.col("_reach")).select("qid", "km", *own_columns)


#: Places of a cube that isn't divided further, last level of the tree (cubes of the last are some 50 m wide), and how many cubes
#: of all levels may be sent to all executors (some 15 MB); of larger trees, pages are.
CROWD, LAST, SENT = 24, 9, 200_000
#: A cube is divided in four along each axis, so an axis of the last level has so many bits.
_SPLIT, _BITS = 2, 2 * 9
#: Places, in the order of their cubes, that are looked through together.
_BLOCK = 20_000


def _axes(lat: Column, lon: Column) -> list[Column]:
    """Where a point is along each axis, as numbers of cubes of the last level."""
    side = float(1 << _BITS - 1)
    return [F.least(F.floor((v + 1) * side), F.lit((1 << _BITS) - 1)).cast("long") for v in unit_vector(lat, lon)]


def _key(level: Column, axes: list[Column], of: Column) -> Column:
    """The number of a cube from its place along the axes at a level that is as deep or deeper."""
    x, y, z = (F.call_function("shiftright", c, _SPLIT * (of - level)) for c in axes)
    return F.shiftleft(level.cast("long"), 3 * _BITS).bitwiseOR(F.shiftleft(x, 2 * _BITS)).bitwiseOR(F.shiftleft(y, _BITS)).bitwiseOR(z)


def _in_order(axes: list[Column]) -> Column:
    """A number by which each cube's points stand together, from their cubes of the last level: a cube's number within the one around it, level by level."""
    code = F.lit(0).cast("long")
    for level in range(1, LAST + 1):
        for c in axes:
            code = F.shiftleft(code, _SPLIT).bitwiseOR(F.shiftright(c, _SPLIT * (LAST - level)).bitwiseAND((1 << _SPLIT) - 1))
    return code


def _level(cube: Column) -> Column:
    return F.shiftright(cube, 3 * _BITS).cast("int")


def _along(cube: Column) -> list[Column]:
    """Where a cube is along each axis, at its own level."""
    return [F.shiftright(cube, k * _BITS).bitwiseAND((1 << _BITS) - 1) for k in (2, 1, 0)]


def _around_it(cube: Column, level: Column) -> Column:
    """The cube around a cube at a level, 0 at level 0."""
    return F.when(level > 0, _key(level, _along(cube), _level(cube))).otherwise(F.lit(0).cast("long"))


def cube_tables(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree as a table of cubes and a table of places.

    cubes: (level, parent, cube, most, lat, lon): below which cube it is, its largest population, and a place that has it. A
    cube that isn't divided is below itself on all later levels. leaves: (cube, row_id, lat, lon, population).

    Places are put in an order in which each cube's stand together and are numbered by ranges. A cube has more than CROWD of them if two
    that stand CROWD apart are in it, so one pass finds each place's undivided cube, whatever share of the places one city has; the
    cubes around these come from them, not from places.
    """
    leaves = _leaves(places)
    ends = leaves.groupBy("cube").agg(*_most())  # longs and doubles alone, so that groups are hashed
    return _tree(ends), leaves


def _tree(ends: DataFrame) -> DataFrame:
    """(level, parent, cube, most, lat, lon) of undivided cubes (cube, most, lat, lon) and those around them."""
    ends = cut(ends.withColumn("level", _level(F.col("cube"))), "ends")
    reached = ends.agg(F.max("level")).first()[0] or 1
    above = ends.withColumn("to", F.explode(F.when(F.col("level") > 1, F.sequence(F.lit(1), F.col("level") - 1))))
    above = above.withColumn("cube", _around_it(F.col("cube"), F.col("to"))).groupBy(F.col("to").alias("level"), "cube").agg(*_most("most"))
    above = above.withColumn("parent", _around_it(F.col("cube"), F.col("level") - 1))
    later = ends.withColumn("to", F.explode(F.sequence(F.col("level"), F.lit(reached))))
    later = later.withColumn("parent", F.when(F.col("to") > F.col("level"), F.col("cube")).otherwise(_around_it(F.col("cube"), F.col("level") - 1))).withColumn("level", F.col("to"))
    columns = ["level", "parent", "cube", "most", "lat", "lon"]
    return cut(above.select(columns).unionByName(later.select(columns)), "tree")


def _pages(leaves: DataFrame, weighed: bool) -> Pages:
    """The pages of a tree that is too large to be sent: SENT // LAST at most, or the first level.

    A cube is a page if it has at most so many places, or isn't divided, and the one around it has more; how many follows from the number of pages that there would be.
    """
    ends = cut(leaves.groupBy("cube").agg(F.count(F.lit(1)).alias("count"), *_most()), "sizes")
    every = ends.withColumn("to", F.explode(F.sequence(F.lit(1), _level(F.col("cube"))))).groupBy(_around_it(F.col("cube"), F.col("to")).alias("cube")).agg(F.sum("count").alias("count"))
    divided = every.groupBy(_around_it(F.col("cube"), _level(F.col("cube")) - 1).alias("cube")).agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("parts"))
    divided = cut(divided, "divided")
    root = F.col("cube") == 0
    sizes = [CROWD << k for k in range(1, 40)]
    more = divided.agg(*(F.sum(F.when(root | (F.col("count") > n), F.col("parts") - F.when(root, 0).otherwise(1))).alias(str(n)) for n in sizes)).first()
    most = next((n for n in sizes if (more[str(n)] or 0) <= SENT // LAST), sizes[-1])
    opened = F.broadcast(divided.where(root | (F.col("count") > most)).select(F.col("cube").alias("_opened")))  # fewer than pages
    own = ends.withColumn("to", F.explode(F.sequence(F.lit(0), _level(F.col("cube")) - 1)))
    own = own.join(opened, _around_it(F.col("cube"), F.col("to")) == F.col("_opened")).groupBy("cube").agg((F.max("to") + 1).alias("to"))
    own = own.join(ends, "cube").groupBy(_around_it(F.col("cube"), F.col("to")).alias("cube")).agg(*_most("most"))
    below = _SPLIT * (LAST - _level(F.col("cube")))
    begins = _in_order([F.call_function("shiftleft", c, below) for c in _along(F.col("cube"))])
    corner = [v.alias(c) for v, c in zip(_corner(F.col("cube")), _CORNER, strict=True)]
    found = own.select(begins.alias("begins"), *corner, F.col("most").cast("double"), *unit_vector(F.col("lat"), F.col("lon")))
    return Pages(sorted(map(tuple, found.collect())), weighed)


def _most(population: str = "population") -> list[Column]:
    """The largest population and a place that has it: both coordinates come from the same row, as equals are met in the same order."""
    own = F.coalesce(population, F.lit(0))
    return [F.max(population).alias("most"), F.max_by("lat", own).alias("lat"), F.max_by("lon", own).alias("lon")]


def _leaves(places: DataFrame) -> DataFrame:
    """(cube, row_id, lat, lon, population): each place and the largest cube around it that has at most CROWD, or the one of the last level."""
    axes = ["_x", "_y", "_z"]
    own = places.where("lat IS NOT NULL AND lon IS NOT NULL").select("row_id", "lat", "lon", F.col("population").cast("long").alias("population"), *(v.alias(c) for v, c in zip(_axes(F.col("lat"), F.col("lon")), axes, strict=True)))
    rows = numbered(own.withColumn("_code", _in_order([F.col(c) for c in axes])), "_code").drop("_code")
    near = F.sequence(F.floor((F.col("pos") - CROWD) / _BLOCK), F.floor((F.col("pos") + CROWD) / _BLOCK))  # its block, and one that it stands next to
    rows = rows.withColumn("block", F.explode(near))
    order = Window.partitionBy("block").orderBy("pos")
    apart = F.lit(0)
    for c in axes:
        apart = apart.bitwiseOR(F.col(c).bitwiseXOR(F.lead(c, CROWD).over(order)))
    rows = rows.withColumn("apart", apart)
    common = sum((F.col("apart") < 1 << _SPLIT * (LAST - level)).cast("int") for level in range(1, LAST + 1))  # levels on which both are in one cube
    rows = rows.withColumn("crowded", F.max(common).over(order.rowsBetween(-CROWD, 0))).where(F.col("block") == F.floor(F.col("pos") / _BLOCK))
    level = F.least(F.lit(LAST), F.coalesce("crowded", F.lit(0)) + 1)
    return cut(rows.select(_key(level, [F.col(c) for c in axes], F.lit(LAST)).alias("cube"), "row_id", "lat", "lon", "population"), "leaves")


_VECTOR, _CORNER = ["_qx", "_qy", "_qz"], ["_lx", "_ly", "_lz", "_width"]


def _corner(cube: Column) -> list[Column]:
    """A cube's least coordinates, and how wide it is."""
    width = F.pow(F.lit(2.0), 1 - _SPLIT * _level(cube))
    return [*(at * width - 1 for at in _along(cube)), width]


def _begins() -> Column:
    """The chord from a query's unit vector to the nearest point of a cube, from its corner."""
    off = [F.greatest(F.col(f"_l{c}") - F.col(f"_q{c}"), F.col(f"_q{c}") - F.col(f"_l{c}") - F.col("_width"), F.lit(0.0)) for c in "xyz"]
    return F.sqrt(sum((o * o for o in off[1:]), off[0] * off[0]))


def _chord_km(c: Column) -> Column:
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), c / 2))


def _search(queries: DataFrame, columns: DataFrame, tables: tuple[DataFrame, DataFrame], weighed: bool) -> DataFrame:
    """(qid, km, columns of places) of the best place by distance, or if weighed by gravity."""
    cubes, leaves = tables
    if weighed:
        cubes, leaves = cubes.where("most > 0"), leaves.where("population > 0")
    q = queries.where("lat BETWEEN -90 AND 90 AND abs(lon) < double('Infinity')").select("qid", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    levels = cubes.groupBy("level").count().orderBy("level").collect()  # LAST rows at most
    hit = _hits_of_pages(q, leaves, weighed) if sum(n for _, n in levels) > SENT else _hits_of_tree(q, cubes, leaves, levels, weighed)
    order = F.struct(-gravity(F.col("population"), F.col("km")), "km", "row_id") if weighed else F.struct("km", "row_id")
    found = hit.groupBy("qid").agg(F.min_by(F.struct("km", "row_id"), order).alias("_p")).select("qid", "_p.km", "_p.row_id")
    own = _own_columns(columns)
    return found if own == ["row_id"] else found.join(columns.select(own), "row_id").select("qid", "km", *own)


def _hits_of_pages(q: DataFrame, leaves: DataFrame, weighed: bool) -> DataFrame:
    """(qid, row_id, population, km) of places that are best or within rounding of it.

    Places and queries are dealt by pages, and stand page by page in a partition, places first. So a page is met by its queries as they come: first by those in it,
    which it tells what they reach, then by those that could do better there.
    """
    pages = _pages(leaves, weighed)
    axes = _axes(F.col("_lat"), F.col("_lon"))

    def with_page(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", *(v.alias(c) for v, c in zip(axes, ("_x", "_y", "_z"), strict=True)))
        rows = rows.withColumn("_at", _in_order([F.col(c) for c in ("_x", "_y", "_z")])).drop("_x", "_y", "_z")
        return rows.withColumn("_page", pages.of(F.col("_at")))

    kind = q.schema["qid"].dataType
    places = leaves.select(F.lit(None).cast(kind).alias("qid"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "row_id", "population")
    places = with_page(places).withColumns({"_at": F.lit(-1).cast("long"), "_reached": F.lit(None).cast("double")})
    none = {"row_id": F.lit(None).cast("long"), "population": F.lit(None).cast("long")}
    first = with_page(q).withColumns(none | {"_reached": F.lit(float("-inf"))})

    def met(rows: DataFrame, others: bool) -> DataFrame:
        dealt = places.unionByName(rows).repartition("_page").sortWithinPartitions("_page", "_at")
        schema = StructType([StructField(n, t) for n, t in (("qid", kind), ("_lat", DoubleType()), ("_lon", DoubleType()), ("_page", IntegerType()), ("_reached", DoubleType()), ("row_id", LongType()), ("population", LongType()), ("_plat", DoubleType()), ("_plon", DoubleType()))])
        found = dealt.select("qid", "_lat", "_lon", "_page", "_reached", "row_id", "population").mapInArrow(pages.meet(others), schema)
        return found.withColumn("km", F.when(F.col("row_id").isNotNull(), haversine_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon")))).drop("_plat", "_plon")

    point = {c: F.when(F.col("row_id").isNull(), F.col(c)) for c in ("_lat", "_lon", "_reached")}  # of an answer they aren't needed any more
    own = cut(met(first, True).withColumns(point), "own")
    more = met(own.where("row_id IS NULL").drop("km").withColumn("_at", F.lit(0).cast("long")), False)
    columns = ["qid", "row_id", "population", "km"]
    return own.where("row_id IS NOT NULL").select(columns).unionByName(more.select(columns))


def _hits_of_tree(q: DataFrame, cubes: DataFrame, leaves: DataFrame, levels: list, weighed: bool) -> DataFrame:
    """(qid, row_id, population, km) of places that are best or within rounding of it, from the tree of cubes, which is sent."""
    lat, lon = F.col("_lat"), F.col("_lon")
    worth = (lambda most, km: gravity(most, km)) if weighed else (lambda most, km: -km)
    km = haversine_km(lat, lon, F.col("_plat"), F.col("_plon"))
    best = worth(F.col("most"), km)
    begins = _chord_km(_begins() * (1 - 1e-9)) * (1 - 1e-9)
    enough = (worth(F.col("most"), begins) * (1 + 1e-9) if weighed else 1e-6 - begins) >= F.col("_reached")
    place = ["most", F.col("lat").alias("_plat"), F.col("lon").alias("_plon")]
    # what a query reaches at least is seen first from the cubes around itself
    axes = ["_x", "_y", "_z"]
    cand = q.select("*", *(v.alias(c) for v, c in zip(_axes(lat, lon), axes, strict=True)), F.lit(float("-inf")).alias("_reached"))
    for level, _ in levels:
        own = cubes.where((F.col("level") == level) & (_level(F.col("cube")) == level)).select(F.col("cube").alias("_own"), *place)
        cand = cand.join(F.broadcast(own), _key(F.lit(level), [F.col(c) for c in axes], F.lit(LAST)) == F.col("_own"), "left")
        cand = cand.withColumn("_reached", F.greatest("_reached", best)).drop("_own", "most", "_plat", "_plon")
    cand = cand.select("qid", "_lat", "_lon", "_reached").repartition("qid")
    cand = cand.withColumns(dict(zip(_VECTOR, unit_vector(lat, lon), strict=True))).withColumn("cube", F.lit(0).cast("long"))
    for level, _ in levels:
        corner = [v.alias(c) for v, c in zip(_corner(F.col("cube")), _CORNER, strict=True)]  # once for a cube, not for each query
        below = cubes.where(F.col("level") == level).select("parent", F.col("cube").alias("_cube"), *place, *corner)
        cand = cand.join(F.broadcast(below), F.col("cube") == F.col("parent")).drop("cube", "parent").withColumnRenamed("_cube", "cube").where(enough)
        cand = cand.withColumn("_reached", F.greatest("_reached", F.max(best).over(Window.partitionBy("qid")))).where(enough)
        cand = cand.drop("most", "_plat", "_plon", *_CORNER)
    hit = cand.select("qid", "_lat", "_lon", "_reached", "cube").join(leaves.select("cube", "row_id", F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), "population"), "cube")
    hit = hit.withColumn("km", km)
    score = worth(F.col("population"), F.col("km"))
    return hit.where((score * (1 + 1e-9) if weighed else score + 1e-6) >= F.col("_reached")).select("qid", "row_id", "population", "km")


def _own_columns(places: DataFrame) -> list[str]:
    """Columns of places but for those that are called as a result's own are."""
    return [c for c in places.columns if c.lower() not in ("qid", "km")]


def invalid_points(queries: DataFrame) -> DataFrame:
    """(qid, error) of queries whose point can't be looked up: latitude or longitude missing or not finite, or a latitude beyond the poles. Any finite
    longitude is a place, as it wraps."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return queries.where(bad("lat") | bad("lon") | (F.abs(F.col("lat")) > 90)).select("qid", F.lit("invalid coordinate").alias("error"))


def nearest(queries: DataFrame, places: DataFrame, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, km, columns of places): for each query the place at the least distance; of equals, the one of least row_id.

    Queries without a valid point have no row, see invalid_points(); nor has any if places is empty. Columns of places that are called qid or km go. tables: cube_tables(places), if they were made before.
    """
    return _search(queries, places, cube_tables(places) if tables is None else tables, False)


def top_populations(places: DataFrame, k: int = TABLE) -> DataFrame:
    """The k most populous places, positive ones alone; of equals, those of least row_id."""
    return places.where("population > 0").orderBy(F.desc("population"), "row_id").limit(k)


def nearest_by_gravity(queries: DataFrame, places: DataFrame, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, km, columns of places): for each query the place of highest population / (km * km + 1), over all places.

    Ties go to the nearer place, then to the lesser row_id. If no place has inhabitants, the nearest one.
    """
    tables = cube_tables(places) if tables is None else tables
    return _search(queries, places, tables, not tables[0].where("most > 0").isEmpty())


def with_admin(winners: DataFrame, admin1: DataFrame | None) -> DataFrame:
    """Adds admin1_name: the name of the winner's first-level division, empty if the code is or no name is known."""
    if admin1 is None:
        return winners.withColumn("admin1_name", F.lit(""))
    names = admin1.select(F.col("key").alias("_key"), F.col("name").alias("_admin1"))
    key = F.when(F.col("admin1_code") != "", F.concat_ws(".", "country", "admin1_code"))
    return winners.join(names, key == F.col("_key"), "left").withColumn("admin1_name", F.coalesce("_admin1", F.lit(""))).drop("_key", "_admin1")
