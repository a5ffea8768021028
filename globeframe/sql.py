"""The library's functions under names in SQL.

Formulas are SQL functions whose bodies Spark inlines, so they stay Catalyst expressions;
what needs the Hilbert chain or exact predicates is an Arrow function over NumPy kernels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .kernels import grid
from .kernels import predicates as P

POINT = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"

#: Name: parameters, result, body.  Later ones use earlier ones.
BODIES: dict[str, tuple[str, str, str]] = {
    "globe_point": ("lat DOUBLE, lng DOUBLE", POINT, "named_struct('x', cos(radians(lng)) * cos(radians(lat)), 'y', sin(radians(lng)) * cos(radians(lat)), 'z', sin(radians(lat)))"),
    "globe_lat": (f"p {POINT}", "DOUBLE", "degrees(atan2(p.z, sqrt(p.x * p.x + p.y * p.y)))"),
    "globe_lng": (f"p {POINT}", "DOUBLE", "degrees(atan2(p.y, p.x))"),
    "globe_dot": (f"a {POINT}, b {POINT}", "DOUBLE", "a.x * b.x + a.y * b.y + a.z * b.z"),
    "globe_cross": (f"a {POINT}, b {POINT}", POINT, "named_struct('x', a.y * b.z - a.z * b.y, 'y', a.z * b.x - a.x * b.z, 'z', a.x * b.y - a.y * b.x)"),
    "globe_norm": (f"a {POINT}", "DOUBLE", "sqrt(a.x * a.x + a.y * a.y + a.z * a.z)"),
    "globe_angle": (f"a {POINT}, b {POINT}", "DOUBLE", "atan2(globe_norm(globe_cross(a, b)), globe_dot(a, b))"),
    "globe_chord2": (f"a {POINT}, b {POINT}", "DOUBLE", "least(4.0D, power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))"),
    "globe_chord_from_angle": ("r DOUBLE", "DOUBLE", "CASE WHEN r < 0 THEN -1.0D WHEN r = double('infinity') THEN r ELSE power(2 * sin(least(r, pi()) / 2), 2) END"),
    "globe_chord_to_angle": ("c DOUBLE", "DOUBLE", "CASE WHEN c < 0 THEN -1.0D WHEN c = double('infinity') THEN c ELSE 2 * asin(sqrt(c) / 2) END"),
    "globe_meters": (
        "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE",
        "DOUBLE",
        "2 * 6371010.0D * asin(sqrt(least(1.0D, power(sin(radians(lat2 - lat1) / 2), 2) + power(sin(radians(lng2 - lng1) / 2), 2) * cos(radians(lat1)) * cos(radians(lat2)))))",
    ),
    "globe_bearing": (
        "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE",
        "DOUBLE",
        "atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))",
    ),
    "globe_cap_contains": (f"center {POINT}, radius DOUBLE, p {POINT}", "BOOLEAN", "globe_chord2(center, p) <= globe_chord_from_angle(radius)"),
    "globe_triangle_area": (f"a {POINT}, b {POINT}, c {POINT}", "DOUBLE", "2 * abs(atan2(globe_dot(globe_cross(a, b), c), 1 + globe_dot(a, b) + globe_dot(b, c) + globe_dot(c, a)))"),
    "globe_cell_lsb": ("cell BIGINT", "BIGINT", "cell & -cell"),
    "globe_cell_level": ("cell BIGINT", "INT", "CAST(30 - bit_count((cell & -cell) - 1) DIV 2 AS INT)"),
    "globe_cell_face": ("cell BIGINT", "INT", "CAST(shiftrightunsigned(cell, 61) AS INT)"),
    "globe_cell_parent": ("cell BIGINT, level INT", "BIGINT", "(cell & -shiftleft(1L, 60 - 2 * level)) | shiftleft(1L, 60 - 2 * level)"),
    "globe_cell_range_min": ("cell BIGINT", "BIGINT", "cell - ((cell & -cell) - 1)"),
    "globe_cell_range_max": ("cell BIGINT", "BIGINT", "cell + ((cell & -cell) - 1)"),
    "globe_cell_order": ("cell BIGINT", "BIGINT", "cell ^ (-9223372036854775807L - 1)"),
    "globe_cell_contains": ("a BIGINT, b BIGINT", "BOOLEAN", "globe_cell_order(b) BETWEEN globe_cell_order(globe_cell_range_min(a)) AND globe_cell_order(globe_cell_range_max(a))"),
    "globe_cell_intersects": ("a BIGINT, b BIGINT", "BOOLEAN", "globe_cell_contains(a, b) OR globe_cell_contains(b, a)"),
    "globe_cell_token": ("cell BIGINT", "STRING", "CASE WHEN cell = 0 THEN 'X' ELSE rtrim('0', lower(lpad(hex(cell), 16, '0'))) END"),
}


def _points(p: pd.DataFrame):
    return p[["x", "y", "z"]].to_numpy()


def _cell(p: pd.DataFrame, level: pd.Series) -> pd.Series:
    return pd.Series(grid.parent(grid.from_xyz(_points(p)), level.to_numpy()))


def _center(cell: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(grid.center(cell.to_numpy()), columns=["x", "y", "z"])


def _area(cell: pd.Series) -> pd.Series:
    return pd.Series(grid.exact_area(cell.to_numpy()))


def _segment(x: pd.DataFrame, a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series(P.segment_distance(_points(x), _points(a), _points(b)))


def _crossing(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame) -> pd.Series:
    return pd.Series(P.crossing(_points(a), _points(b), _points(c), _points(d)).astype("int32"))


def _orientation(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame) -> pd.Series:
    return pd.Series(P.orientation(_points(a), _points(b), _points(c)).astype("int32"))


#: Name: result, kernel.
KERNELS = {
    "globe_cell": ("bigint", _cell),
    "globe_cell_center": ("x double, y double, z double", _center),
    "globe_cell_area": ("double", _area),
    "globe_segment_distance": ("double", _segment),
    "globe_crossing": ("int", _crossing),
    "globe_orientation": ("int", _orientation),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session; their names."""
    for name, (parameters, kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (kind, kernel) in KERNELS.items():
        spark.udf.register(name, F.pandas_udf(kernel, kind))
    return [*BODIES, *KERNELS]
