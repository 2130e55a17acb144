"""Column functions that Spark has no single name for. All run inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone; the session's time zone plays no part."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def second_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius_m: float = 6371000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * radius_m * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def ratio(n: Column, d: Column, default: float | None = None) -> Column:
    """n / d where d is positive, else the default (null)."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(default).cast("double"))


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal by a published Chebyshev fit of erfc, relative error below 1.2e-7; null for null or infinite z."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    erfc = t * F.exp(-x * x - 1.26551223 + t * poly)
    one_sided = F.when(z >= 0, 0.5 * erfc).otherwise(1.0 - 0.5 * erfc)
    return F.when(z.isNotNull() & (F.abs(z) < float("inf")), one_sided)


def upper_tail_sql(z: str) -> str:
    """The same function as SQL text."""
    x, t = f"(abs({z}) / {math.sqrt(2.0)!r})", f"(1.0 / (1.0 + 0.5 * (abs({z}) / {math.sqrt(2.0)!r})))"
    poly = "CAST(0.17087277 AS DOUBLE)"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = f"({poly} * {t} + CAST({c} AS DOUBLE))"
    erfc = f"({t} * exp(-{x} * {x} - CAST(1.26551223 AS DOUBLE) + {t} * {poly}))"
    return f"CASE WHEN {z} >= 0 THEN 0.5 * {erfc} ELSE 1.0 - 0.5 * {erfc} END"


def sector(dx: Column, dy: Column, n: int = 16) -> Column:
    """Nearest compass sector of a direction: 0 is north, clockwise."""
    return F.pmod(F.floor(F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)) / (360.0 / n) + 0.5), F.lit(n)).cast("int")


def utm(lon: Column, lat: Column, central_meridian: float = 117.0) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the third flattening's fourth order, northern hemisphere."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - central_meridian)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * a * east, 0.9996 * a * north


def text_seed(name: str) -> int:
    """Seed of a random stream from its name, so that the order of draws plays no part."""
    import hashlib

    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
