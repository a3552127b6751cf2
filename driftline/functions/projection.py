"""Transverse Mercator for ETRS89 / UTM zone 32N (EPSG:25832) as Column maths.

Krueger series of fourth order in the third flattening of GRS80. Everything stays
inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid and the parameters of EPSG:25832.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0
CENTRAL_MERIDIAN = 9.0

_n = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = 2 * math.sqrt(_n) / (1 + _n)
RECTIFYING = SCALE * SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)

# Series coefficients published by Krueger (1912).
FORWARD = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
INVERSE = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
LATITUDE = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)


def _series(coefficients, term) -> Column:
    total = None
    for j, c in enumerate(coefficients, start=1):
        part = F.lit(c) * term(2.0 * j)
        total = part if total is None else total + part
    return total


def utm32_from_lonlat(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres from longitude and latitude in degrees."""
    sin_lat = F.sin(F.radians(lat))
    d_lon = F.radians(lon - F.lit(CENTRAL_MERIDIAN))
    t = F.sinh(F.atanh(sin_lat) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * sin_lat))
    xi = F.atan2(t, F.cos(d_lon))
    eta = F.atanh(F.sin(d_lon) / F.sqrt(F.lit(1.0) + t * t))
    north = xi + _series(FORWARD, lambda k: F.sin(F.lit(k) * xi) * F.cosh(F.lit(k) * eta))
    east = eta + _series(FORWARD, lambda k: F.cos(F.lit(k) * xi) * F.sinh(F.lit(k) * eta))
    return F.lit(FALSE_EASTING) + F.lit(RECTIFYING) * east, F.lit(RECTIFYING) * north


def lonlat_from_utm32(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees from easting and northing in metres."""
    xi = northing / F.lit(RECTIFYING)
    eta = (easting - F.lit(FALSE_EASTING)) / F.lit(RECTIFYING)
    xi_s = xi - _series(INVERSE, lambda k: F.sin(F.lit(k) * xi) * F.cosh(F.lit(k) * eta))
    eta_s = eta - _series(INVERSE, lambda k: F.cos(F.lit(k) * xi) * F.sinh(F.lit(k) * eta))
    chi = F.asin(F.sin(xi_s) / F.cosh(eta_s))
    lat = chi + _series(LATITUDE, lambda k: F.sin(F.lit(k) * chi))
    lon = F.lit(CENTRAL_MERIDIAN) + F.degrees(F.atan2(F.sinh(eta_s), F.cos(xi_s)))
    return lon, F.degrees(lat)
