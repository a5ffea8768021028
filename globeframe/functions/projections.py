"""Plane projections of positions in radians: plate carree and Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _c


def plate_carree(lat, lng, x_scale: float = 180.0) -> tuple[Column, Column]:
    k = x_scale / math.pi
    return _c(lng) * k, _c(lat) * k


def plate_carree_inverse(x, y, x_scale: float = 180.0) -> tuple[Column, Column]:
    k = math.pi / x_scale
    return _c(y) * k, remainder(_c(x), 2 * x_scale) * k


def mercator(lat, lng, max_x: float = 180.0) -> tuple[Column, Column]:
    k = max_x / math.pi
    s = F.sin(_c(lat))
    return _c(lng) * k, 0.5 * F.ln((1 + s) / (1 - s)) * k


def mercator_inverse(x, y, max_x: float = 180.0) -> tuple[Column, Column]:
    k = math.pi / max_x
    t = F.exp(2 * k * _c(y))
    return F.asin((t - 1) / (t + 1)), remainder(_c(x), 2 * max_x) * k


def remainder(x: Column, period: float) -> Column:
    """The representative of x nearest zero."""
    return x - F.rint(x / period) * period


def wrap_destination(ax, bx, period: float) -> Column:
    """bx moved by whole turns to lie within half a turn of ax."""
    d = _c(bx) - _c(ax)
    return F.when(F.abs(d) > period / 2, _c(ax) + remainder(d, period)).otherwise(_c(bx))


def interpolate(f, ax, bx) -> Column:
    return (1 - _c(f)) * _c(ax) + _c(f) * _c(bx)
