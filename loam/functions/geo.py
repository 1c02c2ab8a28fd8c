"""Geodesy as column expressions: great-circle distance, equal-area projection, grid keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres; GRS80 axes; parameters of EPSG:3035.
EARTH_RADIUS = 6_371_008.8
_A, _INV_F = 6_378_137.0, 298.257222101
_LAT0, _LON0, _FE, _FN = math.radians(52.0), math.radians(10.0), 4_321_000.0, 3_210_000.0
_E2 = 2 / _INV_F - 1 / _INV_F**2
_E = math.sqrt(_E2)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two positions in degrees on the sphere (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box_distance_bounds(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Least and greatest possible great-circle distance between points of two boxes (south, north, west, east) in degrees."""
    s1, n1, w1, e1 = a
    s2, n2, w2, e2 = b
    zero = F.lit(0.0)

    def gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
        return F.greatest(zero, lo2 - hi1, lo1 - hi2)

    def span(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
        return F.greatest(hi2 - lo1, hi1 - lo2)

    def cosines(s: Column, n: Column) -> tuple[Column, Column]:
        low = F.least(F.cos(F.radians(s)), F.cos(F.radians(n)))
        high = F.when((s <= 0) & (n >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(s)), F.cos(F.radians(n))))
        return low, high

    (l1, h1), (l2, h2) = cosines(s1, n1), cosines(s2, n2)

    def arc(dlat: Column, dlon: Column, k: Column) -> Column:
        h = F.pow(F.sin(F.radians(F.least(dlat, F.lit(180.0))) / 2), 2) + k * F.pow(F.sin(F.radians(F.least(dlon, F.lit(180.0))) / 2), 2)
        return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    return arc(gap(s1, n1, s2, n2), gap(w1, e1, w2, e2), l1 * l2), arc(span(s1, n1, s2, n2), span(w1, e1, w2, e2), h1 * h2)


def _q(sin_lat: Column | float, sqrt=None, log=None) -> Column | float:
    ln = log or F.log
    return (1 - _E2) * (sin_lat / (1 - _E2 * sin_lat * sin_lat) - ln((1 - _E * sin_lat) / (1 + _E * sin_lat)) / (2 * _E))


_QP = _q(1.0, log=math.log)
_RQ = _A * math.sqrt(_QP / 2)
_BETA0 = math.asin(_q(math.sin(_LAT0), log=math.log) / _QP)
_D = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (_RQ * math.cos(_BETA0))


def laea_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area x, y (EPSG:3035) of degrees: closed form after Snyder, USGS Professional Paper 1395 (1987)."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(F.sin(F.radians(lat))) / _QP)))
    dlon = F.radians(lon) - _LON0
    b = _RQ * F.sqrt(2 / (1 + math.sin(_BETA0) * F.sin(beta) + math.cos(_BETA0) * F.cos(beta) * F.cos(dlon)))
    x = _FE + b * _D * F.cos(beta) * F.sin(dlon)
    y = _FN + (b / _D) * (math.cos(_BETA0) * F.sin(beta) - math.sin(_BETA0) * F.cos(beta) * F.cos(dlon))
    return x, y


def cell_id(x: Column, y: Column, size: float = 1000.0) -> Column:
    """Key of the square grid cell that holds x, y: row * 100000 + column."""
    return F.floor(y / size).cast("bigint") * 100_000 + F.floor(x / size).cast("bigint")
