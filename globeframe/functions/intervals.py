"""Closed intervals: on the line (``r_``) and on the circle (``s_``); structs of lo and hi.

Empty on the line: lo > hi.  On the circle: empty is [pi, -pi], full is [-pi, pi], an
interval with lo > hi goes through the far side, and -pi is written pi otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .vectors import _c

PI = math.pi


def interval(lo, hi) -> Column:
    return F.struct(_c(lo).alias("lo"), _c(hi).alias("hi"))


R_EMPTY = (1.0, 0.0)
S_EMPTY, S_FULL = (PI, -PI), (-PI, PI)


def _b(i) -> tuple[Column, Column]:
    i = _c(i)
    return i["lo"], i["hi"]


def r_is_empty(i) -> Column:
    lo, hi = _b(i)
    return lo > hi


def r_center(i) -> Column:
    lo, hi = _b(i)
    return (lo + hi) / 2


def r_length(i) -> Column:
    lo, hi = _b(i)
    return hi - lo


def r_contains(i, x) -> Column:
    lo, hi = _b(i)
    return (_c(x) >= lo) & (_c(x) <= hi)


def r_interior_contains(i, x) -> Column:
    lo, hi = _b(i)
    return (_c(x) > lo) & (_c(x) < hi)


def r_contains_interval(a, b) -> Column:
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    return r_is_empty(b) | ((blo >= alo) & (bhi <= ahi))


def r_intersects(a, b) -> Column:
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    return F.when(alo <= blo, (blo <= ahi) & (blo <= bhi)).otherwise((alo <= bhi) & (alo <= ahi))


@let
def r_union(a, b) -> Column:
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    both = interval(F.least(alo, blo), F.greatest(ahi, bhi))
    return F.when(r_is_empty(a), _c(b)).when(r_is_empty(b), _c(a)).otherwise(both)


def r_intersection(a, b) -> Column:
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    return interval(F.greatest(alo, blo), F.least(ahi, bhi))


@let
def r_expanded(i, margin) -> Column:
    lo, hi = _b(i)
    return F.when(r_is_empty(i), _c(i)).otherwise(interval(lo - _c(margin), hi + _c(margin)))


def r_add_point(i, x) -> Column:
    return r_union(i, interval(x, x))


def r_project(i, x) -> Column:
    lo, hi = _b(i)
    return F.greatest(lo, F.least(hi, _c(x)))


def r_hausdorff(a, b) -> Column:
    """Directed: how far a point of a can be from b."""
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    far = F.greatest(F.lit(0.0), ahi - bhi, blo - alo)
    return F.when(r_is_empty(a), 0.0).when(r_is_empty(b), float("inf")).otherwise(far)


@let
def s_make(lo, hi) -> Column:
    """The circle's interval from two ends, -pi taken as pi but in the full and empty ones."""
    lo, hi = _c(lo), _c(hi)
    return interval(F.when((lo == -PI) & (hi != PI), PI).otherwise(lo), F.when((hi == -PI) & (lo != PI), PI).otherwise(hi))


@let
def s_from_pair(a, b) -> Column:
    """The shorter arc between two points of the circle."""
    a, b = (F.when(_c(x) == -PI, PI).otherwise(_c(x)) for x in (a, b))
    return F.when(s_distance(a, b) <= PI, interval(a, b)).otherwise(interval(b, a))


@let
def s_distance(a, b) -> Column:
    """From a counterclockwise to b, in [0, 2 pi)."""
    d = _c(b) - _c(a)
    return F.when(d >= 0, d).otherwise((_c(b) + PI) - (_c(a) - PI))


def s_is_empty(i) -> Column:
    lo, hi = _b(i)
    return (lo - hi) == 2 * PI


def s_is_full(i) -> Column:
    lo, hi = _b(i)
    return (hi - lo) == 2 * PI


def s_is_inverted(i) -> Column:
    lo, hi = _b(i)
    return lo > hi


@let
def s_length(i) -> Column:
    """Negative for the empty interval."""
    lo, hi = _b(i)
    n = hi - lo
    turned = n + 2 * PI
    return F.when(n >= 0, n).when(turned > 0, turned).otherwise(-1.0)


@let
def s_center(i) -> Column:
    lo, hi = _b(i)
    c = (lo + hi) / 2
    return F.when(~s_is_inverted(i), c).otherwise(F.when(c <= 0, c + PI).otherwise(c - PI))


@let
def s_contains(i, x) -> Column:
    lo, hi = _b(i)
    x = F.when(_c(x) == -PI, PI).otherwise(_c(x))
    return F.when(s_is_inverted(i), ((x >= lo) | (x <= hi)) & ~s_is_empty(i)).otherwise((x >= lo) & (x <= hi))


@let
def s_contains_interval(a, b) -> Column:
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    wide = F.when(s_is_inverted(b), (blo >= alo) & (bhi <= ahi) & ~s_is_empty(a)).otherwise(((blo >= alo) | (bhi <= ahi)) & ~s_is_empty(a))
    plain = F.when(s_is_inverted(b), s_is_full(a) | s_is_empty(b)).otherwise((blo >= alo) & (bhi <= ahi))
    return F.when(s_is_inverted(a), wide).otherwise(plain)


@let
def s_intersects(a, b) -> Column:
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    either = s_is_inverted(b) | (blo <= ahi) | (bhi >= alo)
    plain = F.when(s_is_inverted(b), (blo <= ahi) | (bhi >= alo)).otherwise((blo <= ahi) & (bhi >= alo))
    return ~s_is_empty(a) & ~s_is_empty(b) & F.when(s_is_inverted(a), either).otherwise(plain)


def s_complement(i) -> Column:
    lo, hi = _b(i)
    return F.when(lo == hi, interval(*S_FULL)).otherwise(interval(hi, lo))


@let
def s_union(a, b) -> Column:
    """The smallest interval that holds both."""
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    near = F.when(s_distance(bhi, alo) < s_distance(ahi, blo), interval(blo, ahi)).otherwise(interval(alo, bhi))
    overlap = F.when(s_contains(a, bhi), F.when(s_contains_interval(a, b), _c(a)).otherwise(interval(*S_FULL))).otherwise(interval(alo, bhi))
    return (
        F.when(s_is_empty(b), _c(a))
        .when(s_contains(a, blo), overlap)
        .when(s_contains(a, bhi), interval(blo, ahi))
        .when(s_is_empty(a) | s_contains(b, alo), _c(b))
        .otherwise(near)
    )


@let
def s_intersection(a, b) -> Column:
    """Where that would be two pieces, the shorter of the inputs."""
    (alo, ahi), (blo, bhi) = _b(a), _b(b)
    shorter = F.when(s_length(a) < s_length(b), _c(a)).otherwise(_c(b))
    return (
        F.when(s_is_empty(b), interval(*S_EMPTY))
        .when(s_contains(a, blo), F.when(s_contains(a, bhi), shorter).otherwise(interval(blo, ahi)))
        .when(s_contains(a, bhi), interval(alo, bhi))
        .when(s_contains(b, alo), _c(a))
        .otherwise(interval(*S_EMPTY))
    )


@let
def s_expanded(i, margin) -> Column:
    lo, hi = _b(i)
    m = _c(margin)
    wrap = lambda x: x - F.round(x / (2 * PI)) * (2 * PI)
    grown = F.when(s_is_empty(i), _c(i)).when(s_length(i) + 2 * m + 2 * 2.0**-52 >= 2 * PI, interval(*S_FULL)).otherwise(s_make(wrap(lo - m), wrap(hi + m)))
    shrunk = F.when(s_is_full(i), _c(i)).when(s_length(i) + 2 * m - 2 * 2.0**-52 <= 0, interval(*S_EMPTY)).otherwise(s_make(wrap(lo - m), wrap(hi + m)))
    return F.when(m >= 0, grown).otherwise(shrunk)
