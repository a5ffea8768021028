"""Lengths, areas, bearings on a sphere of the Earth's mean radius."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V
from .vectors import _c

RADIUS_M = 6371010.0
LOWEST_M, HIGHEST_M = -10898.0, 8848.0


def to_meters(radians) -> Column:
    return _c(radians) * RADIUS_M


def to_km(radians) -> Column:
    return _c(radians) * (RADIUS_M / 1000)


def from_meters(meters) -> Column:
    return _c(meters) / RADIUS_M


def from_km(km) -> Column:
    return _c(km) / (RADIUS_M / 1000)


def chord_from_meters(meters) -> Column:
    from .angles import chord_from_angle

    return chord_from_angle(from_meters(meters))


def square_meters(steradians) -> Column:
    return _c(steradians) * RADIUS_M**2


def square_km(steradians) -> Column:
    return _c(steradians) * (RADIUS_M / 1000) ** 2


def steradians_from_square_km(area) -> Column:
    return _c(area) / (RADIUS_M / 1000) ** 2


def haversine(radians) -> Column:
    s = F.sin(_c(radians) / 2)
    return s * s


def latlng_angle(lat1, lng1, lat2, lng2) -> Column:
    """Haversine angle of two positions in degrees; about eight digits near half a turn."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    x = haversine(b - a) + haversine(F.radians(_c(lng2)) - F.radians(_c(lng1))) * F.cos(a) * F.cos(b)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), x)))


def latlng_meters(lat1, lng1, lat2, lng2) -> Column:
    return to_meters(latlng_angle(lat1, lng1, lat2, lng2))


def point_meters(a, b) -> Column:
    return to_meters(V.angle(a, b))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in radians, clockwise from north."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    d = F.radians(_c(lng2)) - F.radians(_c(lng1))
    return F.atan2(F.sin(d) * F.cos(b), F.sin(b - a) + F.sin(a) * F.cos(b) * 2 * haversine(d))


def longitude_span(meters, lat_radians) -> Column:
    """Longitude range of a length along a parallel, at most a full turn."""
    c = F.cos(_c(lat_radians))
    return F.when(c == 0, 2 * math.pi).otherwise(F.least(from_meters(meters) / c, F.lit(2 * math.pi)))
