"""Text forms: points and chains as ``lat:lng, lat:lng`` in degrees, rings apart by ``;``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V
from .vectors import _c

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
ENTRY = rf"^\s*({NUMBER})\s*:\s*({NUMBER})\s*$"


def parse_points(text) -> Column:
    """The points of a text; entries that are no position are skipped."""
    entries = F.filter(F.split(_c(text), ","), lambda e: e.rlike(ENTRY))
    part = lambda e, k: F.regexp_extract(e, ENTRY, k).cast("double")
    return F.transform(entries, lambda e: V.from_degrees(part(e, 1), part(e, 2)))


def parse_rings(text) -> Column:
    """Rings of a polygon; ``empty`` gives none, ``full`` one ring without vertices."""
    rings = F.transform(F.split(_c(text), ";"), parse_points)
    some = F.filter(rings, lambda r: F.size(r) > 0)
    word = F.lower(F.trim(_c(text)))
    return F.when(word == "full", F.array(F.slice(parse_points(F.lit("0:0")), 1, 0))).when(word == "empty", F.slice(rings, 1, 0)).otherwise(some)


def format_points(points, digits: int = 15) -> Column:
    """``lat:lng`` entries joined by comma and blank."""
    show = lambda x: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", F.degrees(x)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.array_join(F.transform(_c(points), lambda p: F.concat(show(V.latitude(p)), F.lit(":"), show(V.longitude(p)))), ", ")


def format_rings(rings) -> Column:
    """Rings apart by ``;``; ``empty`` without a ring, ``full`` for one without a vertex."""
    one = lambda r: F.when(F.size(r) == 0, "full").otherwise(format_points(r))
    return F.when(F.size(_c(rings)) == 0, "empty").otherwise(F.array_join(F.transform(_c(rings), one), "; "))


def format_index(points, chains, polygons) -> Column:
    """``points # chains # polygons`` of arrays; items of a part are apart by ``|``."""
    part = lambda items, show: F.array_join(F.transform(_c(items), show), " | ")
    shown = [part(points, lambda p: format_points(F.array(p))), part(chains, lambda c: format_points(c)), part(polygons, lambda r: format_rings(r))]
    return F.trim(F.concat_ws(" # ", *shown))


def parse_rect(text) -> Column:
    """lat_lo, lat_hi, lng_lo, lng_hi (radians) of the points of a text, the longitudes the shorter
    way from the least to the greatest; null without a point."""
    p = parse_points(text)
    lat, lng = F.transform(p, lambda q: V.latitude(q)), F.transform(p, lambda q: V.longitude(q))
    some = F.struct(F.array_min(lat).alias("lat_lo"), F.array_max(lat).alias("lat_hi"), F.array_min(lng).alias("lng_lo"), F.array_max(lng).alias("lng_hi"))
    return F.when(F.size(p) > 0, some)


def parse_index(text) -> Column:
    """``points # chains # polygons``: a struct of points, chains and polygons; items of a part
    are apart by ``|``, and a text without two ``#`` gives null."""
    parts = F.split(_c(text), "#")
    items = lambda k: F.filter(F.split(F.element_at(parts, k), r"\|"), lambda s: F.trim(s) != "")
    out = F.struct(
        F.flatten(F.transform(items(1), parse_points)).alias("points"),
        F.transform(items(2), parse_points).alias("chains"),
        F.transform(items(3), parse_rings).alias("polygons"),
    )
    return F.when(F.size(parts) == 3, out)
