"""Transverse Mercator on the WGS 84 and GRS 80 ellipsoids, forward and back, as column expressions.

Krueger's series to the sixth order of the third flattening: the coefficients are worked out here from that one parameter. Within 3000 km of the
central meridian the error is far below a millimetre; places more than 85 degrees from it are outside what the series is made for and get nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXIS, SCALE, EAST, NORTH = 6378137.0, 0.9996, 500000.0, 10000000.0
FLATTENING = {"WGS84": 1 / 298.257223563, "GRS80": 1 / 298.257222101}

# Coefficients of the series in powers of the third flattening n, from n on, for alpha (forward), beta (back) and delta (latitude).
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)


def third(ellipsoid: str) -> float:
    """The third flattening n."""
    f = FLATTENING[ellipsoid]
    return f / (2 - f)


def series(table: tuple[tuple[float, ...], ...], n: float) -> list[float]:
    return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table]


def radius(n: float) -> float:
    """Radius of the circle as long as a meridian."""
    return AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def zone(lon: Column, lat: Column | None = None) -> Column:
    """The zone 1 to 60 that a longitude is in (180 is in zone 1); with lat, southern Norway and Svalbard have wider ones as usual."""
    plain = (F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(6.0)), F.lit(60)) + 1).cast("int")
    if lat is None:
        return plain
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when(norway, F.lit(32)).when((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain)


def meridian(number: Column) -> Column:
    """The central meridian of a zone."""
    return number.cast("double") * F.lit(6.0) - F.lit(183.0)


def epsg(number: Column, south: Column) -> Column:
    """EPSG code of a zone on WGS 84."""
    return F.when(south, F.lit(32700)).otherwise(F.lit(32600)) + number


def forward(lat: Column, lon: Column, centre: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Easting and northing in metres, by degrees and the central meridian; with south, northings count from ten million below the equator."""
    n = third(ellipsoid)
    e = 2 * math.sqrt(n) / (1 + n)
    off = F.pmod(lon - centre + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(F.radians(off))), F.atanh(F.sin(F.radians(off)) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for k, a in enumerate(series(ALPHA, n), 1):
        x = x + F.lit(a) * F.cos(F.lit(2.0 * k) * xi) * F.sinh(F.lit(2.0 * k) * eta)
        y = y + F.lit(a) * F.sin(F.lit(2.0 * k) * xi) * F.cosh(F.lit(2.0 * k) * eta)
    r = SCALE * radius(n)
    near = (F.abs(off) <= 85) & (F.abs(lat) < 90)
    return F.when(near, F.lit(EAST) + F.lit(r) * x), F.when(near, F.when(south, F.lit(NORTH)).otherwise(F.lit(0.0)) + F.lit(r) * y)


def inverse(east: Column, north: Column, centre: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Latitude and longitude in degrees of an easting and northing: the inverse of forward."""
    n = third(ellipsoid)
    e = 2 * math.sqrt(n) / (1 + n)
    r = SCALE * radius(n)
    xi = (north - F.when(south, F.lit(NORTH)).otherwise(F.lit(0.0))) / F.lit(r)
    eta = (east - F.lit(EAST)) / F.lit(r)
    x, y = eta, xi
    for k, b in enumerate(series(BETA, n), 1):
        y = y - F.lit(b) * F.sin(F.lit(2.0 * k) * xi) * F.cosh(F.lit(2.0 * k) * eta)
        x = x - F.lit(b) * F.cos(F.lit(2.0 * k) * xi) * F.sinh(F.lit(2.0 * k) * eta)
    conformal = F.asin(F.sin(y) / F.cosh(x))
    # From the conformal latitude to the geographic one: steps of a fixed point, each some 150 times nearer than the one before.
    q = F.atanh(F.sin(conformal))
    s = F.sin(conformal)
    for _ in range(6):
        s = F.tanh(q + F.lit(e) * F.atanh(F.lit(e) * s))
    lon = centre + F.degrees(F.atan2(F.sinh(x), F.cos(y)))
    return F.degrees(F.asin(s)), F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def site_grid(lat: Column, lon: Column, buffer_m: Column, resolution: int, centre: Column, south: Column, ellipsoid: str = "GRS80") -> Column:
    """The pixel grid around a site as a struct: origin_x and origin_y (west and north, on multiples of the resolution in projected metres), width and height in pixels."""
    x, y = forward(lat, lon, centre, south, ellipsoid)
    step = F.lit(float(resolution))
    west, north = F.floor((x - buffer_m) / step) * step, F.ceil((y + buffer_m) / step) * step
    return F.struct(west.alias("origin_x"), north.alias("origin_y"), F.ceil((x + buffer_m - west) / step).cast("int").alias("width"), F.ceil((north - (y - buffer_m)) / step).cast("int").alias("height"))
