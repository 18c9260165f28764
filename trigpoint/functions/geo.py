"""Distances and scores as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
RADIUS = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord(km: float | Column) -> float | Column:
    """Straight-line distance, on the unit sphere, of points that are so many km apart."""
    if isinstance(km, Column):
        return 2 * F.sin(F.least(km, F.lit(math.pi * RADIUS)) / (2 * RADIUS))
    return 2 * math.sin(min(km, math.pi * RADIUS) / (2 * RADIUS))


def gravity(population: Column, km: Column) -> Column:
    return population / (km * km + 1)


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100
