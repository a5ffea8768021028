"""Discs (caps: centre and squared chord) and latitude/longitude rectangles, in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import angles as A
from . import intervals as I
from . import vectors as V
from .bind import let
from .vectors import _c

PI = math.pi


def cap(center, radians) -> Column:
    """The disc about a unit vector; a negative radius is the empty disc."""
    return F.struct(_c(center).alias("center"), A.chord_from_angle(radians).alias("l2"))


def cap_from_chord(center, l2) -> Column:
    return F.struct(_c(center).alias("center"), _c(l2).alias("l2"))


def cap_from_height(center, height) -> Column:
    return cap_from_chord(center, F.least(F.lit(4.0), 2 * _c(height)))


def cap_from_area(center, area) -> Column:
    return cap_from_chord(center, F.least(F.lit(4.0), _c(area) / PI))


def cap_is_empty(c) -> Column:
    return _c(c)["l2"] < 0


def cap_is_full(c) -> Column:
    return _c(c)["l2"] == 4


def cap_height(c) -> Column:
    return 0.5 * _c(c)["l2"]


def cap_area(c) -> Column:
    return 2 * PI * F.greatest(F.lit(0.0), cap_height(c))


def cap_radius(c) -> Column:
    return A.chord_to_angle(_c(c)["l2"])


def cap_contains(c, p) -> Column:
    return V.chord2(_c(c)["center"], p) <= _c(c)["l2"]


def cap_interior_contains(c, p) -> Column:
    return cap_is_full(c) | (V.chord2(_c(c)["center"], p) < _c(c)["l2"])


@let
def cap_contains_cap(a, b) -> Column:
    d = A.chord_add(V.chord2(_c(a)["center"], _c(b)["center"]), _c(b)["l2"])
    return cap_is_full(a) | cap_is_empty(b) | (_c(a)["l2"] >= d)


@let
def cap_intersects(a, b) -> Column:
    reach = A.chord_add(_c(a)["l2"], _c(b)["l2"])
    return ~cap_is_empty(a) & ~cap_is_empty(b) & (reach >= V.chord2(_c(a)["center"], _c(b)["center"]))


@let
def cap_complement(c) -> Column:
    l2 = F.when(cap_is_full(c), -1.0).when(cap_is_empty(c), 4.0).otherwise(4 - _c(c)["l2"])
    return cap_from_chord(V.scale(_c(c)["center"], -1.0), l2)


@let
def cap_expanded(c, radians) -> Column:
    grown = A.chord_add(_c(c)["l2"], A.chord_from_angle(radians))
    return F.when(cap_is_empty(c), _c(c)).otherwise(cap_from_chord(_c(c)["center"], grown))


@let
def cap_add_point(c, p) -> Column:
    """The smallest disc of the same centre with p; an empty one becomes p."""
    grown = cap_from_chord(_c(c)["center"], F.greatest(_c(c)["l2"], V.chord2(_c(c)["center"], p)))
    return F.when(cap_is_empty(c), cap_from_chord(p, 0.0)).otherwise(grown)


@let
def cap_union(a, b) -> Column:
    """The smallest disc that holds both."""
    ra, rb = cap_radius(a), cap_radius(b)
    d = V.angle(_c(a)["center"], _c(b)["center"])
    radius = (d + ra + rb) / 2
    center = V.at_distance(_c(a)["center"], _c(b)["center"], (d - ra + rb) / 2)
    big = F.when(radius >= PI, cap_from_chord(_c(a)["center"], 4.0)).otherwise(cap(center, radius))
    out = F.when(cap_contains_cap(a, b), _c(a)).when(cap_contains_cap(b, a), _c(b)).otherwise(big)
    return F.when(cap_is_empty(a), _c(b)).when(cap_is_empty(b), _c(a)).otherwise(out)


@let
def cap_centroid(c) -> Column:
    """Centre of mass times area."""
    r = 1 - 0.5 * cap_height(c)
    return F.when(cap_is_empty(c), V.vector(0.0, 0.0, 0.0)).otherwise(V.scale(_c(c)["center"], r * cap_area(c)))


@let
def cap_rect(c) -> Column:
    """Bounding rectangle: all longitudes where the disc holds a pole."""
    center, r = _c(c)["center"], cap_radius(c)
    lat, lng = V.latitude(center), V.longitude(center)
    lo, hi = lat - r, lat + r
    polar = (lo <= -PI / 2) | (hi >= PI / 2)
    ratio = F.sin(r) / F.cos(lat)
    half = F.asin(F.least(F.lit(1.0), ratio))
    wrap = lambda x: x - F.round(x / (2 * PI)) * (2 * PI)
    lngs = F.when(polar | (ratio > 1), I.interval(-PI, PI)).otherwise(I.s_make(wrap(lng - half), wrap(lng + half)))
    some = rect(I.interval(F.greatest(F.lit(-PI / 2), lo), F.least(F.lit(PI / 2), hi)), lngs)
    return F.when(cap_is_empty(c), empty_rect()).otherwise(some)


def rect(lat, lng) -> Column:
    return F.struct(_c(lat).alias("lat"), _c(lng).alias("lng"))


def empty_rect() -> Column:
    return rect(I.interval(*I.R_EMPTY), I.interval(*I.S_EMPTY))


def full_rect() -> Column:
    return rect(I.interval(-PI / 2, PI / 2), I.interval(*I.S_FULL))


def rect_from_degrees(lat_lo, lng_lo, lat_hi, lng_hi) -> Column:
    r = lambda x: F.radians(_c(x))
    return rect(I.interval(r(lat_lo), r(lat_hi)), I.s_make(r(lng_lo), r(lng_hi)))


@let
def rect_from_center_size(lat, lng, lat_size, lng_size) -> Column:
    """From a centre and full sizes, all in radians, cut at the poles."""
    lats = I.r_intersection(I.interval(_c(lat) - _c(lat_size) / 2, _c(lat) + _c(lat_size) / 2), I.interval(-PI / 2, PI / 2))
    return rect(lats, I.s_expanded(I.interval(lng, lng), _c(lng_size) / 2))


def rect_is_empty(r) -> Column:
    return I.r_is_empty(_c(r)["lat"])


def rect_is_full(r) -> Column:
    lat = _c(r)["lat"]
    return (lat["lo"] == -PI / 2) & (lat["hi"] == PI / 2) & I.s_is_full(_c(r)["lng"])


@let
def rect_contains(r, lat, lng) -> Column:
    """Positions in radians; one out of range is in no rectangle."""
    valid = (F.abs(_c(lat)) <= PI / 2) & (F.abs(_c(lng)) <= PI)
    return valid & I.r_contains(_c(r)["lat"], lat) & I.s_contains(_c(r)["lng"], lng)


@let
def rect_contains_rect(a, b) -> Column:
    return I.r_contains_interval(_c(a)["lat"], _c(b)["lat"]) & I.s_contains_interval(_c(a)["lng"], _c(b)["lng"])


@let
def rect_intersects(a, b) -> Column:
    return I.r_intersects(_c(a)["lat"], _c(b)["lat"]) & I.s_intersects(_c(a)["lng"], _c(b)["lng"])


@let
def rect_union(a, b) -> Column:
    return rect(I.r_union(_c(a)["lat"], _c(b)["lat"]), I.s_union(_c(a)["lng"], _c(b)["lng"]))


@let
def rect_intersection(a, b) -> Column:
    lat, lng = I.r_intersection(_c(a)["lat"], _c(b)["lat"]), I.s_intersection(_c(a)["lng"], _c(b)["lng"])
    return F.when(I.r_is_empty(lat) | I.s_is_empty(lng), empty_rect()).otherwise(rect(lat, lng))


@let
def rect_area(r) -> Column:
    lat = _c(r)["lat"]
    return F.when(rect_is_empty(r), 0.0).otherwise(I.s_length(_c(r)["lng"]) * F.abs(F.sin(lat["hi"]) - F.sin(lat["lo"])))


def rect_center(r) -> tuple[Column, Column]:
    return I.r_center(_c(r)["lat"]), I.s_center(_c(r)["lng"])


@let
def rect_polar_closure(r) -> Column:
    lat = _c(r)["lat"]
    touches = (lat["lo"] == -PI / 2) | (lat["hi"] == PI / 2)
    return F.when(touches, rect(lat, I.interval(*I.S_FULL))).otherwise(_c(r))


@let
def rect_expanded(r, lat_margin, lng_margin) -> Column:
    lat = I.r_intersection(I.r_expanded(_c(r)["lat"], lat_margin), I.interval(-PI / 2, PI / 2))
    lng = I.s_expanded(_c(r)["lng"], lng_margin)
    return F.when(I.r_is_empty(lat) | I.s_is_empty(lng), empty_rect()).otherwise(rect(lat, lng))


@let
def rect_add_point(r, lat, lng) -> Column:
    lngs = _c(r)["lng"]
    turned = F.when(I.s_contains(lngs, lng), lngs).when(I.s_is_empty(lngs), I.interval(lng, lng))
    ahead, behind = I.s_distance(lng, lngs["lo"]), I.s_distance(lngs["hi"], lng)
    turned = turned.otherwise(F.when(ahead < behind, I.interval(lng, lngs["hi"])).otherwise(I.interval(lngs["lo"], lng)))
    return rect(I.r_add_point(_c(r)["lat"], lat), turned)
