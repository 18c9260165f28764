"""Made-up places and query mixes, from hashes of row numbers: the same rows on any number of partitions.

The hash is arithmetic on 64-bit integers, so that any SQL engine gives the same numbers.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SYLLABLES = ("ba", "den", "fi", "gor", "hal", "ka", "lun", "mer", "no", "ru", "sta", "vel")
#: Centres (lat, lon, spread in degrees) of places; one in fifty lies anywhere.
_CENTRES = ((48, 10, 12), (20, 80, 14), (35, 110, 14), (40, -95, 15), (-12, -55, 14), (5, 22, 15), (-27, 140, 10))


#: A prime below 2 ** 31, so that products of two remainders fit into 64 bits.
PRIME = 2_147_483_647


def uniform_sql(seed: int, name: str, key: str = "id") -> str:
    """SQL of a number in [0, 1) for a row, by its id."""
    k = [zlib.crc32(f"{name}/{seed}/{i}".encode()) % PRIME for i in range(4)]
    x = f"(({key} + {k[0]}) % {PRIME})"
    for a, b in ((48_271, k[1]), (69_621, k[2]), (1_220_703_125, k[3])):
        # squares in between, so that neighbouring ids don't give neighbouring numbers
        x = f"(({x} * {a} + {b}) % {PRIME})"
        x = f"(({x} * ({x} % 65521)) % {PRIME})" if a == 48_271 else x
    return f"({x} / {PRIME}.0E0)"


def uniform(seed: int, name: str, key: str = "id") -> Column:
    return F.expr(uniform_sql(seed, name, key))


def _pick(values: list, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def places(spark: SparkSession, n: int, seed: int = 1, countries: int = 250) -> DataFrame:
    """Clustered places; populations have a heavy tail and a third are 0; 15 % take one of a few names."""
    u = lambda name: uniform(seed, name)
    k = u("centre")
    wide = u("anywhere") < 0.02
    gauss = lambda a: F.sqrt(-2 * F.log(1 - u(a + "r"))) * F.cos(2 * math.pi * u(a + "a"))
    lat = _pick([float(c[0]) for c in _CENTRES], k) + gauss("lat") * _pick([float(c[2]) / 3 for c in _CENTRES], k)
    lon = _pick([float(c[1]) for c in _CENTRES], k) + gauss("lon") * _pick([float(c[2]) / 2 for c in _CENTRES], k)
    word = lambda p: F.initcap(F.concat(*(_pick(list(_SYLLABLES), u(f"{p}{i}")) for i in range(3))))
    common = F.concat(F.lit("Santa "), _pick([s.title() for s in _SYLLABLES], u("common")))
    country = F.floor(u("country") * u("country2") * countries).cast("int")
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.when(u("homonym") < 0.15, common).otherwise(word("name")).alias("name"),
        F.when(u("alt") < 0.25, F.array(word("alt"))).otherwise(F.array().cast("array<string>")).alias("alt_names"),
        country_code(country).alias("country"),
        F.when(wide, F.degrees(F.asin(2 * u("wlat") - 1))).otherwise(F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat))).alias("lat"),
        F.when(wide, u("wlon") * 360 - 180).otherwise(lon).alias("lon"),
        F.when(u("empty") < 1 / 3, 0).otherwise(F.least(F.lit(3e7), 200 / F.pow(1 - u("pop"), 1.1)).cast("int")).alias("population"),
        F.format_string("%02d", F.floor(u("a1") * 20)).alias("admin1_code"), F.when(u("a2") < 0.58, F.format_string("%03d", F.floor(u("a2n") * 400))).otherwise("").alias("admin2_code"), F.lit("P").alias("feature_class"),
    )


def country_code(i: Column) -> Column:
    """AA, AB, ... for 0, 1, ..."""
    return F.concat(F.chr(65 + F.floor(i / 26)), F.chr(65 + i % 26))


def workload(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(id, kind, lat, lon): 80 % nearest, 5 % gravity, 10 % name, 5 % postal; points are even on the sphere."""
    u = uniform(seed, "kind")
    kind = F.when(u < 0.80, "nearest").when(u < 0.85, "gravity").when(u < 0.95, "name").otherwise("postal")
    return spark.range(n).select("id", kind.alias("kind"), F.degrees(F.asin(2 * uniform(seed, "lat") - 1)).alias("lat"), (uniform(seed, "lon") * 360 - 180).alias("lon"))


def sample(df: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    """k rows by the order of a hash of their key, a whole number from 0: the same rows each time."""
    return df.orderBy(uniform(seed, "sample", key), key).limit(k)
