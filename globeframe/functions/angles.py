"""Angles (radians) and squared chords (0 to 4; -1 negative, infinity beyond all)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .vectors import _c

INFINITE = float("inf")
EPSILON = 2.0**-52


def to_e(radians, digits: int) -> Column:
    """Degrees times 10**digits as an integer, halves away from zero."""
    return F.round(F.degrees(_c(radians)) * 10.0**digits).cast("int")


def from_e(value, digits: int) -> Column:
    return F.radians(_c(value).cast("double") * 10.0**-digits)


@let
def normalized(radians) -> Column:
    """In (-pi, pi]."""
    x = _c(radians)
    y = x - F.round(x / (2 * math.pi)) * (2 * math.pi)
    return F.when(y <= -math.pi, math.pi).otherwise(y)


def chord_from_angle(radians) -> Column:
    r = _c(radians)
    half = 2 * F.sin(F.least(r, F.lit(math.pi)) / 2)
    return F.when(r < 0, -1.0).when(r == INFINITE, INFINITE).otherwise(half * half)


def chord_to_angle(chord) -> Column:
    c = _c(chord)
    return F.when(c < 0, -1.0).when(c == INFINITE, INFINITE).otherwise(2 * F.asin(F.sqrt(c) / 2))


@let
def chord_add(a, b) -> Column:
    """Chord of the sum of two angles, at most a half turn."""
    a, b = _c(a), _c(b)
    x, y = a * (1 - b / 4), b * (1 - a / 4)
    both = F.least(F.lit(4.0), x + y + 2 * F.sqrt(x * y))
    return F.when(b == 0, a).when(a + b >= 4, 4.0).otherwise(both)


@let
def chord_subtract(a, b) -> Column:
    a, b = _c(a), _c(b)
    x, y = a * (1 - b / 4), b * (1 - a / 4)
    c = F.greatest(F.lit(0.0), F.sqrt(x) - F.sqrt(y))
    return F.when(b == 0, a).when(a <= b, 0.0).otherwise(c * c)


def chord_plus_error(chord, error) -> Column:
    c = _c(chord)
    special = (c < 0) | (c == INFINITE)
    return F.when(special, c).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(4.0), c + _c(error))))


def _beside(name: str, value: Column) -> Column:
    """The next double up or down, by the JVM's own method."""
    return F.call_function("reflect", F.lit("java.lang.Math"), F.lit(name), value).cast("double")


def chord_successor(chord) -> Column:
    """The next larger chord: 0 after -1, infinity after 4."""
    c = _c(chord)
    return F.when(c >= 4, INFINITE).when(c < 0, 0.0).otherwise(_beside("nextUp", c))


def chord_predecessor(chord) -> Column:
    """The next smaller chord: -1 before 0, 4 before infinity."""
    c = _c(chord)
    return F.when(c <= 0, -1.0).when(c > 4, 4.0).otherwise(_beside("nextDown", c))


def latlng_is_valid(lat, lng) -> Column:
    """Positions in radians."""
    return (F.abs(_c(lat)) <= math.pi / 2) & (F.abs(_c(lng)) <= math.pi)


def latlng_normalized(lat, lng) -> tuple[Column, Column]:
    """The latitude cut at the poles, the longitude turned into [-pi, pi]."""
    turned = _c(lng) - F.round(_c(lng) / (2 * math.pi)) * (2 * math.pi)
    return F.greatest(F.lit(-math.pi / 2), F.least(F.lit(math.pi / 2), _c(lat))), turned


def chord_sin2(chord) -> Column:
    return _c(chord) * (1 - _c(chord) / 4)


def chord_sin(chord) -> Column:
    return F.sqrt(chord_sin2(chord))


def chord_cos(chord) -> Column:
    return 1 - _c(chord) / 2


def chord_tan(chord) -> Column:
    return chord_sin(chord) / chord_cos(chord)


def chord_point_error(chord) -> Column:
    """Bound on the error of a chord between two rounded unit vectors."""
    return 2.5 * EPSILON * _c(chord) + 16 * EPSILON * EPSILON


def chord_angle_error(chord) -> Column:
    """Bound on the error of a chord made from an angle."""
    return EPSILON * _c(chord)
