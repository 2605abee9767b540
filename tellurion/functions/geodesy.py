"""Geodetic column functions: WGS84 to UTM and back by Krueger series, zones, angle texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLAT / (2 - FLAT)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series terms of the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
BANDS = "CDEFGHJKLMNPQRSTUVWX"


def zone_number(lat: Column, lon: Column) -> Column:
    """UTM zone with the exceptions of Norway and Svalbard."""
    z = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    sval = (lat >= 72) & (lat <= 84) & (lon >= 0)
    return F.when(norway, 32).when(sval & (lon < 9), 31).when(sval & (lon < 21), 33).when(sval & (lon < 33), 35).when(sval & (lon < 42), 37).otherwise(z)


def zone_letter(lat: Column) -> Column:
    """Latitude band, NULL outside 80 S to 84 N."""
    i = F.least(F.floor((lat + 80) / 8), F.lit(len(BANDS) - 1)).cast("int")
    return F.when(lat.between(-80, 84), F.substring(F.lit(BANDS), i + 1, F.lit(1)))


def valid_letter(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike("^[E-X]$"), F.lit(False))


def valid_number(c: Column) -> Column:
    return F.coalesce(c.between(1, 60), F.lit(False))


def zone_limits(number: Column) -> tuple[Column, Column]:
    """(west, east) longitudes."""
    return (number - 1) * 6 - 180, number * 6 - 180


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column, Column]:
    """(easting, northing, zone number); northings south of the equator begin at 10,000 km."""
    zone = zone_number(lat, lon) if zone is None else zone
    phi, lam = F.radians(lat), F.radians(lon - ((zone - 1) * 6 - 177))
    c = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - F.lit(c) * _atanh(F.lit(c) * s))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(K0 * _RECT) * x, F.lit(K0 * _RECT) * y + F.when(lat < 0, 10_000_000.0).otherwise(0.0), zone


def wgs84(east: Column, north: Column, zone: Column, northern: Column | bool = True) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees."""
    northern = F.lit(northern) if isinstance(northern, bool) else northern
    xi = (north - F.when(northern, 0.0).otherwise(10_000_000.0)) / F.lit(K0 * _RECT)
    eta = (east - 500000.0) / F.lit(K0 * _RECT)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone - 1) * 6 - 177


def parse_angle(text: Column) -> Column:
    """'d°m.mmm' (a sign holds for both parts) as decimal degrees."""
    p = F.split(F.trim(text), "°")
    deg, minute = F.try_element_at(p, F.lit(1)).try_cast("double"), F.coalesce(F.regexp_replace(F.try_element_at(p, F.lit(2)), "[^0-9.]", "").try_cast("double"), F.lit(0.0))
    return F.when(F.trim(text).startswith("-"), deg - minute / 60).otherwise(deg + minute / 60)


def format_angle(degrees: Column) -> Column:
    whole = F.floor(F.abs(degrees))
    return F.concat(F.when(degrees < 0, "-").otherwise(""), whole.cast("string"), F.lit("°"), F.format_string("%.8f", (F.abs(degrees) - whole) * 60))
