"""Points and vectors: structs of x, y, z doubles, as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

#: The far reference point of parity tests, and the vector that makes
#: an orthogonal direction with no zero component.
ORIGIN = (-0.00999946643502502, 0.002592454260932412, 0.999946643502502)
ORTHO = (0.012, 0.0053, 0.00457)

_c = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def vector(x, y, z) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"))


def xyz(p) -> tuple[Column, Column, Column]:
    p = _c(p)
    return p["x"], p["y"], p["z"]


def from_degrees(lat, lng) -> Column:
    """Unit vector of a latitude and longitude in degrees."""
    return from_radians(F.radians(_c(lat)), F.radians(_c(lng)))


def from_radians(lat, lng) -> Column:
    lat, lng = _c(lat), _c(lng)
    return vector(F.cos(lng) * F.cos(lat), F.sin(lng) * F.cos(lat), F.sin(lat))


def latitude(p) -> Column:
    x, y, z = xyz(p)
    return F.atan2(z, F.sqrt(x * x + y * y))


def longitude(p) -> Column:
    x, y, _ = xyz(p)
    return F.atan2(y, x)


def dot(a, b) -> Column:
    (ax, ay, az), (bx, by, bz) = xyz(a), xyz(b)
    return ax * bx + ay * by + az * bz


def cross(a, b) -> Column:
    (ax, ay, az), (bx, by, bz) = xyz(a), xyz(b)
    return vector(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def add(a, b) -> Column:
    return vector(*(p + q for p, q in zip(xyz(a), xyz(b), strict=True)))


def subtract(a, b) -> Column:
    return vector(*(p - q for p, q in zip(xyz(a), xyz(b), strict=True)))


def scale(a, k) -> Column:
    return vector(*(p * _c(k) for p in xyz(a)))


def norm2(a) -> Column:
    return dot(a, a)


def norm(a) -> Column:
    return F.sqrt(norm2(a))


@let
def normalize(a) -> Column:
    """Unit vector; the zero vector becomes the far reference point."""
    n = norm(a)
    return F.when(n > 0, scale(a, 1 / n)).otherwise(vector(*ORIGIN))


def is_unit(a) -> Column:
    return F.abs(norm2(a) - 1) <= 5 * 2.0**-52


@let
def angle(a, b) -> Column:
    """atan2(|a x b|, a.b): exact to rounding at all distances."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def chord2(a, b) -> Column:
    """Squared chord, 0 to 4: the cheap key that orders distances."""
    return F.least(F.lit(4.0), norm2(subtract(a, b)))


@let
def stable_angle(a, b) -> Column:
    return 2 * F.atan2(norm(subtract(a, b)), norm(add(a, b)))


@let
def ortho(a) -> Column:
    """Unit vector orthogonal to a: across from the axis where a is largest."""
    x, y, z = (F.abs(v) for v in xyz(a))
    tx, ty, tz = (F.lit(v) for v in ORTHO)
    first, second = (x > y) & (x > z), ~((x > y) & (x > z)) & (y > z)
    turn = vector(F.when(second, 1.0).otherwise(tx), F.when(~first & ~second, 1.0).otherwise(ty), F.when(first, 1.0).otherwise(tz))
    return normalize(cross(a, turn))


@let
def robust_cross(a, b) -> Column:
    """2 (a x b) by (a + b) x (b - a); an orthogonal vector where the two are parallel."""
    out = cross(add(a, b), subtract(b, a))
    return F.when(norm2(out) > 0, out).otherwise(ortho(a))


@let
def rotate(p, axis, radians) -> Column:
    """p turned about a unit axis."""
    c, s = F.cos(_c(radians)), F.sin(_c(radians))
    return normalize(add(add(scale(p, c), scale(cross(axis, p), s)), scale(axis, dot(axis, p) * (1 - c))))


@let
def interpolate(a, b, t) -> Column:
    """The point a fraction t along the shorter arc from a to b."""
    d = angle(a, b)
    s = F.sin(d)
    mid = add(scale(a, F.sin((1 - _c(t)) * d) / s), scale(b, F.sin(_c(t) * d) / s))
    return F.when(s > 0, normalize(mid)).otherwise(_c(a))


@let
def at_distance(a, b, radians) -> Column:
    """The point at a distance from a towards b, or beyond it."""
    tangent = normalize(cross(cross(a, b), a))
    return normalize(add(scale(a, F.cos(_c(radians))), scale(tangent, F.sin(_c(radians)))))


def ccw(a, b, c) -> Column:
    """Plain orientation test (c x a).b > 0; never true for both abc and cba."""
    return dot(cross(c, a), b) > 0


@let
def triangle_area(a, b, c) -> Column:
    """Area by its half tangent, which holds for small triangles, slivers and half spheres alike."""
    volume = dot(a, cross(subtract(b, a), subtract(c, a)))
    return 2 * F.atan2(F.abs(volume), 1 + dot(a, b) + dot(b, c) + dot(c, a))


@let
def girard_area(a, b, c) -> Column:
    ab, bc, ac = robust_cross(a, b), robust_cross(b, c), robust_cross(a, c)
    return F.greatest(F.lit(0.0), angle(ab, ac) - angle(ab, bc) + angle(bc, ac))


@let
def turn_angle(a, b, c) -> Column:
    """Exterior angle at b, positive for a left turn."""
    size = angle(robust_cross(a, b), robust_cross(b, c))
    return F.when(ccw(a, b, c), size).otherwise(-size)


@let
def inner_angle(a, b, c) -> Column:
    """Angle at b between the arcs to a and to c."""
    return angle(robust_cross(a, b), robust_cross(c, b))


@let
def true_centroid(a, b, c) -> Column:
    """Centroid of a triangle times its area: solves for equal weighted sides."""
    ratio = lambda p, q: F.when(angle(p, q) == 0, 1.0).otherwise(angle(p, q) / F.sin(angle(p, q)))
    ra, rb, rc = ratio(b, c), ratio(c, a), ratio(a, b)
    ax, ay, az = xyz(a)
    bx, by, bz = xyz(b)
    cx, cy, cz = xyz(c)
    x, y, z = vector(ax, bx - ax, cx - ax), vector(ay, by - ay, cy - ay), vector(az, bz - az, cz - az)
    r = vector(ra, rb - ra, rc - ra)
    return scale(vector(dot(cross(y, z), r), dot(cross(z, x), r), dot(cross(x, y), r)), 0.5)


@let
def edge_centroid(a, b) -> Column:
    """Centroid of an arc times its length."""
    n2 = norm2(subtract(a, b))
    c2 = norm2(add(a, b))
    return F.when(c2 > 0, scale(add(a, b), F.sqrt(n2 / c2))).otherwise(vector(0.0, 0.0, 0.0))


def planar_centroid(a, b, c) -> Column:
    return scale(add(add(a, b), c), 1 / 3)


# Distances from a point to the arc ab.


def _foot_inside(x, a, b) -> Column:
    """Whether the nearest point of the great circle ab to x lies within the arc."""
    m = robust_cross(a, b)
    return (dot(cross(m, a), x) > 0) & (dot(cross(b, m), x) > 0)


@let
def segment_distance(x, a, b) -> Column:
    """Angle from x to the nearest point of the arc ab."""
    return _arc_distance(cross(subtract(a, b), add(a, b)), x, a, b)


@let
def _arc_distance(n, x, a, b) -> Column:
    """The same, with n across the arc bound once."""
    size = norm(n)
    off = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(n, x), size)))))
    ends = F.least(F.atan2(norm(cross(x, a)), dot(x, a)), F.atan2(norm(cross(x, b)), dot(x, b)))
    inside = (size > 0) & (dot(cross(n, a), x) > 0) & (dot(cross(b, n), x) > 0)
    return F.when(inside, F.least(off, ends)).otherwise(ends)


@let
def segment_max_distance(x, a, b) -> Column:
    """Angle from x to the farthest point of the arc ab."""
    far = F.greatest(angle(x, a), angle(x, b))
    return F.when(far > math.pi / 2, math.pi - segment_distance(scale(x, -1.0), a, b)).otherwise(far)


@let
def project(x, a, b) -> Column:
    """Nearest point of the arc ab to x."""
    m = normalize(robust_cross(a, b))
    foot = normalize(subtract(x, scale(m, dot(x, m))))
    end = F.when(angle(x, a) <= angle(x, b), _c(a)).otherwise(_c(b))
    return F.when((norm2(subtract(a, b)) > 0) & _foot_inside(x, a, b), foot).otherwise(end)


@let
def distance_fraction(x, a, b) -> Column:
    """How far x is between a and b, 0 to 1."""
    d0, d1 = angle(x, a), angle(x, b)
    return F.when(d0 + d1 > 0, d0 / (d0 + d1)).otherwise(0.0)
