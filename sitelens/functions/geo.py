"""Distances, bearings and places on a sphere, as column expressions in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / F.lit(2.0)), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first place to the second, 0 to 360 degrees."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def destination(lat: Column, lon: Column, km: Column, azimuth: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached from a place by distance and bearing."""
    d, a, p = km / F.lit(RADIUS_KM), F.radians(azimuth), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a))
    east = F.radians(lon) + F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), F.degrees(east)


def square(lat: Column, lon: Column, side_km: float) -> list[Column]:
    """South, west, north and east of a square around a place."""
    dy = F.lit(side_km / 2 / KM_PER_DEGREE)
    dx = F.lit(side_km / 2) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return [lat - dy, lon - dx, lat + dy, lon + dx]


def cell(c: Column, size: float) -> Column:
    """Grid cell by truncation toward zero, so that cell 0 is twice as wide."""
    return (c / F.lit(size)).cast("int")


def snapped(low: Column, high: Column, resolution: float) -> tuple[Column, Column]:
    """Origin on a multiple of the resolution, and the number of cells up to high."""
    first = F.floor(low / F.lit(resolution))
    return first.cast("double") * F.lit(resolution), (F.ceil(high / F.lit(resolution)) - first).cast("int")


def closed_ring(ring: Column) -> Column:
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def vertex_mean(ring: Column, name: str) -> Column:
    """Mean of one coordinate over the vertices of a ring."""
    return F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[name]) / F.size(ring)


def _row(lat: Column, km: float) -> Column:
    return F.floor(lat / F.lit(km / 111.0)).cast("int")


def _cells(row: Column, km: float) -> Column:
    """Cells in a row of latitude: each is as wide as two places less than km apart can differ that are in this row and the next to it."""
    high = km / 111.0
    least = F.least(F.cos(F.radians((row - 1) * F.lit(high))), F.cos(F.radians((row + 2) * F.lit(high))))
    part = F.lit(math.sin(min(math.pi / 2, km / (2 * RADIUS_KM))) * (1 + 1e-9)) / least
    wide = F.degrees(F.lit(2.0) * F.asin(part))
    sure = (least > 0.001) & (part < 0.99) & (F.abs((row + F.lit(0.5)) * F.lit(high)) + F.lit(1.5 * high) < 90)
    return F.when(sure, F.greatest(F.lit(1), F.floor(F.lit(360.0) / wide))).otherwise(F.lit(1)).cast("int")


def _cell_at(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + F.lit(180.0)) * n / F.lit(360.0)), n).cast("int")


def placed(rows: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """rows with the cell (cy, cx) that each place is in."""
    return rows.withColumn("cy", _row(F.col(lat), km)).withColumn("cx", _cell_at(F.col(lon), _cells(F.col("cy"), km)))


def around(rows: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """rows once for each cell (cy, cx) in which `placed` puts what may be within km of them, across the date line too."""
    out = rows.withColumn("cy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _row(F.col(lat), km) + d)))
    n = _cells(F.col("cy"), km)
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(_cell_at(F.col(lon), n) + d, n).cast("int")))
    return out.withColumn("cx", F.explode(near))


def wkt_point(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of POINT(lon lat); nulls where the text is none."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^POINT ?\((-?[0-9.]+) (-?[0-9.]+)\)$", k), F.lit("")).try_cast("double")
    return part(2), part(1)


def rectangle(transform: Column, width: Column, height: Column) -> Column:
    """West, south, east and north of a grid by its transform (x step, 0, x origin, 0, negative y step, y origin) and size."""
    west, north = transform[2], transform[5]
    return F.struct(west.alias("oeste"), (north + height * transform[4]).alias("sul"), (west + width * transform[0]).alias("leste"), north.alias("norte"))
