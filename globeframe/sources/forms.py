"""Byte forms and plain coordinates of shapes as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..kernels import codecs
from ..operators.geometry import CHAIN, CHAIN_SQL, POINT, RINGS_SQL, structs, with_kernel

#: Column type of each kind of value, as SQL and as Arrow.
KINDS = {
    "cell": ("long", pa.int64()),
    "cell_id": ("long", pa.int64()),
    "point": ("struct<x:double,y:double,z:double>", POINT),
    "cap": ("array<double>", pa.list_(pa.float64())),
    "rect": ("array<double>", pa.list_(pa.float64())),
    "cell_union": ("array<long>", pa.list_(pa.int64())),
    "cell_vector": ("array<long>", pa.list_(pa.int64())),
    "polyline": (CHAIN_SQL, CHAIN),
    "loop": (CHAIN_SQL, CHAIN),
    "lax_polyline": (CHAIN_SQL, CHAIN),
    "point_vector": (CHAIN_SQL, CHAIN),
    "polygon": (RINGS_SQL, pa.list_(CHAIN)),
    "lax_polygon": (RINGS_SQL, pa.list_(CHAIN)),
}


def _plain(kind: str, value):
    if kind == "point":
        return structs(np.asarray(value)[None])[0]
    if kind in ("polygon", "lax_polygon"):
        return [structs(r) for r in value]
    if KINDS[kind][0] == CHAIN_SQL:
        return structs(value)
    return np.asarray(value).tolist()


def with_encoded(df: DataFrame, kind: str, value: str, name: str = "bytes") -> DataFrame:
    """Adds a value's bytes; discs are [x, y, z, squared chord], rectangles four radians."""
    take = (lambda v: [v["x"], v["y"], v["z"]]) if kind == "point" else (lambda v: v)
    return with_kernel(df, name, "binary", pa.binary(), [value], lambda v: codecs.encode(kind, take(v)))


def with_decoded(df: DataFrame, kind: str, raw: str, name: str = "value") -> DataFrame:
    """Adds the value of bytes; null where they are none of the kind."""

    def read(v):
        try:
            return _plain(kind, codecs.decode(kind, v))
        except codecs.Malformed:
            return None

    return with_kernel(df, name, *KINDS[kind], [raw], read)


# Plain coordinates: x is the longitude and y the latitude, in degrees.


def to_xy(p) -> Column:
    return F.struct(F.degrees(V.longitude(p)).alias("x"), F.degrees(V.latitude(p)).alias("y"))


def from_xy(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return V.from_degrees(c["y"], c["x"])


def chain_to_xy(chain, closed: bool = False) -> Column:
    """A line string; ``closed`` repeats a ring's first point at its end."""
    c = F.col(chain) if isinstance(chain, str) else chain
    return F.transform(F.concat(c, F.slice(c, 1, 1)) if closed else c, to_xy)


def chain_from_xy(line, closed: bool = False) -> Column:
    """The points of a line string; ``closed`` leaves out a last point that repeats the first."""
    c = F.col(line) if isinstance(line, str) else line
    n = F.size(c)
    again = (n > 1) & (F.element_at(c, 1) == F.element_at(c, -1)) if closed else F.lit(False)
    return F.transform(F.slice(c, F.lit(1), F.when(again, n - 1).otherwise(n)), from_xy)


def to_wkt(chain, kind: str = "LINESTRING") -> Column:
    """Well-known text of a chain, or of a POLYGON's one ring."""
    pairs = F.array_join(F.transform(chain_to_xy(chain, kind == "POLYGON"), lambda q: F.concat_ws(" ", F.round(q["x"], 9).cast("string"), F.round(q["y"], 9).cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} (" + ("(" if kind == "POLYGON" else "")), pairs, F.lit("))" if kind == "POLYGON" else ")"))
