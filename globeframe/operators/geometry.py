"""Arrow operators on chains: one kernel call for each row, whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import cell_distance, cover, grid, overlay, shapes
from ..kernels import predicates as P
from .spatial_join import points_array

POINT = pa.struct([(c, pa.float64()) for c in "xyz"])
CHAIN = pa.list_(POINT)
CHAIN_SQL = "array<struct<x:double,y:double,z:double>>"
RINGS_SQL = f"array<{CHAIN_SQL}>"


def structs(points: np.ndarray) -> list[dict]:
    return [dict(zip("xyz", map(float, p), strict=True)) for p in points]


def _schema_with(df: DataFrame, name: str, sql_type: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` {sql_type}"


def slices(b: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes and at least a row: Python values take many times that."""
    step = max(1, int(size * b.num_rows / max(1, b.nbytes)))
    for s in range(0, b.num_rows, step):
        yield b.slice(s, step)


def with_kernel(df: DataFrame, name: str, sql_type: str, arrow_type: pa.DataType, inputs: list[str], kernel: Callable) -> DataFrame:
    """Adds a column: ``kernel`` over the values of some columns, row by row; nulls give null.

    For results of varying length.  Chains of points come as (n, 3) arrays, cut from the flat
    arrays of a part of the batch, so that few rows are Python values at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            columns = [_values(b.column(c)) for c in inputs]
            values = [None if any(v is None for v in row) else kernel(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow_type)], [*b.schema.names, name])

    return df.mapInArrow(run, _schema_with(df, name, sql_type))


def _is_point(kind: pa.DataType) -> bool:
    return pa.types.is_struct(kind) and [f.name for f in kind] == ["x", "y", "z"]


def _values(column: pa.Array) -> list:
    """Python values of a column; chains as arrays, lists of chains as lists of arrays."""
    kind = column.type
    if not pa.types.is_list(kind):
        return column.to_pylist()
    if _is_point(kind.value_type):
        offsets = column.offsets.to_numpy()
        first = offsets[0] if len(offsets) else 0
        flat = points_array(column.values.slice(first, offsets[-1] - first if len(offsets) else 0))
        parts = [flat[s:e] for s, e in zip(offsets[:-1] - first, offsets[1:] - first, strict=True)]
    elif pa.types.is_list(kind.value_type) and _is_point(kind.value_type.value_type):
        offsets = column.offsets.to_numpy()
        first = offsets[0] if len(offsets) else 0
        inner = _values(column.values.slice(first, offsets[-1] - first if len(offsets) else 0))
        parts = [inner[s:e] for s, e in zip(offsets[:-1] - first, offsets[1:] - first, strict=True)]
    else:
        return column.to_pylist()
    return [p if ok else None for p, ok in zip(parts, column.is_valid().to_pylist(), strict=True)]


def with_arrays(df: DataFrame, name: str, sql_type: str, kernel: Callable, inputs: list[str]) -> DataFrame:
    """Adds a column: ``kernel`` over whole columns of a batch as NumPy arrays, points as (n, 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [points_array(c) if _is_point(c.type) else c.to_numpy(zero_copy_only=False) for c in map(b.column, inputs)]
                yield b.append_column(name, pa.array(kernel(*columns)))

    return df.mapInArrow(run, _schema_with(df, name, sql_type))


#: Distances of a cell column to others, in radians, by kind.
CELL_DISTANCES = {
    "point": cell_distance.to_point,
    "border": cell_distance.border_to_point,
    "edge": cell_distance.to_edge,
    "cell": cell_distance.to_cell,
    "max_point": cell_distance.max_to_point,
    "max_edge": cell_distance.max_to_edge,
    "max_cell": cell_distance.max_to_cell,
}


def with_cell_distance(df: DataFrame, kind: str, cell: str, *others: str, name: str = "radians") -> DataFrame:
    """Distance of each cell to a point, an edge (two points) or a cell; ``max_`` for the largest,
    ``border`` for that of the border alone."""
    return with_arrays(df, name, "double", CELL_DISTANCES[kind], [cell, *others])


def with_rect_distance(df: DataFrame, a: str, b: str, hausdorff: bool = False, name: str = "radians") -> DataFrame:
    """Distance of rectangles (functions.regions.rect), or the larger of both directed Hausdorff
    distances."""
    flat = df
    sides = []
    for k, r in (("a", a), ("b", b)):
        names = [f"_{k}_{x}" for x in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")]
        flat = flat.withColumns(dict(zip(names, (F.col(r)["lat"]["lo"], F.col(r)["lat"]["hi"], F.col(r)["lng"]["lo"], F.col(r)["lng"]["hi"]), strict=True)))
        sides += names

    def kernel(*v):
        r, s = v[:4], v[4:]
        if hausdorff:
            return np.maximum(cell_distance.rect_directed_hausdorff(r, s), cell_distance.rect_directed_hausdorff(s, r))
        return cell_distance.rect_distance(r, s)

    return with_arrays(flat, name, "double", kernel, sides).drop(*sides)


def with_rect_expanded(df: DataFrame, rect: str, distance: str, name: str = "expanded") -> DataFrame:
    """A rectangle (functions.regions.rect) grown by a distance in radians, or shrunk by a negative
    one: lat_lo, lat_hi, lng_lo, lng_hi."""
    names = ["lat_lo", "lat_hi", "lng_lo", "lng_hi"]
    sides = [f"_{x}" for x in names]
    flat = df.withColumns(dict(zip(sides, (F.col(rect)["lat"]["lo"], F.col(rect)["lat"]["hi"], F.col(rect)["lng"]["lo"], F.col(rect)["lng"]["hi"]), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = [b.column(c).to_numpy() for c in (*sides, distance)]
                out = pa.StructArray.from_arrays([pa.array(x) for x in cell_distance.rect_expanded(v[:4], v[4])], names)
                yield b.append_column(name, out)

    return flat.mapInArrow(run, _schema_with(flat, name, "struct<lat_lo:double,lat_hi:double,lng_lo:double,lng_hi:double>")).drop(*sides)


def with_chain_rect(df: DataFrame, chain: str = "chain", name: str = "bound") -> DataFrame:
    """The bounding rectangle of each chain's arcs, in radians, with a margin of rounding."""
    sql = "struct<lat_lo:double,lat_hi:double,lng_lo:double,lng_hi:double>"
    kind = pa.struct([(c, pa.float64()) for c in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")])
    names = [f.name for f in kind]
    return with_kernel(df, name, sql, kind, [chain], lambda c: dict(zip(names, map(float, cell_distance.chain_rect(c)), strict=True)))


def _chain(f):
    return lambda c, *rest: f(shapes.unpack(c), *rest)


def with_area(df: DataFrame, ring: str = "ring", name: str = "area") -> DataFrame:
    return with_kernel(df, name, "double", pa.float64(), [ring], _chain(shapes.signed_area))


def with_curvature(df: DataFrame, ring: str = "ring", name: str = "curvature") -> DataFrame:
    return with_kernel(df, name, "double", pa.float64(), [ring], _chain(shapes.curvature))


def with_perimeter(df: DataFrame, ring: str = "ring", name: str = "perimeter") -> DataFrame:
    return with_kernel(df, name, "double", pa.float64(), [ring], _chain(shapes.perimeter))


def with_polygon_area(df: DataFrame, rings: str = "rings", name: str = "area") -> DataFrame:
    return with_kernel(df, name, "double", pa.float64(), [rings], lambda r: shapes.area([shapes.unpack(x) for x in r]))


def with_regular_ring(df: DataFrame, center: str, radius: float, n: int, name: str = "ring") -> DataFrame:
    return with_kernel(df, name, CHAIN_SQL, CHAIN, [center], lambda p: structs(shapes.regular(np.array([p["x"], p["y"], p["z"]]), radius, n)))


def with_simplified(df: DataFrame, tolerance: float, chain: str = "chain", name: str = "kept") -> DataFrame:
    """Indices of a vertex subset whose chain stays within a tolerance."""
    return with_kernel(df, name, "array<int>", pa.list_(pa.int32()), [chain], _chain(lambda c: shapes.subsample(c, tolerance)))


def with_interpolated(df: DataFrame, fraction: float, chain: str = "chain", name: str = "at") -> DataFrame:
    """The point at a share of a chain's length, and the index of the next vertex."""
    sql = "struct<p:struct<x:double,y:double,z:double>,next_vertex:int>"
    kind = pa.struct([("p", POINT), ("next_vertex", pa.int32())])

    def kernel(c):
        p, k = shapes.interpolate(shapes.unpack(c), fraction)
        return {"p": structs(p[None])[0], "next_vertex": k}

    return with_kernel(df, name, sql, kind, [chain], kernel)


def with_alignment_cost(df: DataFrame, a: str, b: str, radius: int | None = None, name: str = "cost") -> DataFrame:
    return with_kernel(df, name, "double", pa.float64(), [a, b], lambda x, y: shapes.dtw_cost(shapes.unpack(x), shapes.unpack(y), radius))


def with_covering(df: DataFrame, kind: str, inputs: list[str], name: str = "cells", **options) -> DataFrame:
    """Covering cells of each row: kind cap (center, radians), rect (four degrees), polygon
    (rings), chain (chain) or cells."""
    build = {
        "cap": lambda c, r: cover.Cap([c["x"], c["y"], c["z"]], r),
        "rect": cover.Rect,
        "polygon": lambda rings: cover.Polygon([shapes.unpack(r) for r in rings]),
        "chain": lambda c: cover.Chain(shapes.unpack(c)),
        "cells": lambda c: cover.Union(np.array(c, np.int64)),
    }[kind]
    return with_kernel(df, name, "array<long>", pa.list_(pa.int64()), inputs, lambda *v: cover.cover(build(*v), **options).tolist())


def with_union_op(df: DataFrame, a: str, b: str, op: str, name: str = "cells") -> DataFrame:
    """Union, intersection or difference of two arrays of cells."""
    arr = lambda x: grid.normalize(np.array(x, np.int64))
    kernel = {
        "union": lambda x, y: grid.normalize(np.concatenate([arr(x), arr(y)])),
        "intersection": lambda x, y: grid.union_intersection(arr(x), arr(y)),
        "difference": lambda x, y: grid.union_difference(arr(x), arr(y)),
    }[op]
    return with_kernel(df, name, "array<long>", pa.list_(pa.int64()), [a, b], lambda x, y: kernel(x, y).tolist())


def with_neighbors(df: DataFrame, cell: str = "cell", name: str = "neighbors") -> DataFrame:
    """The four edge neighbours of each cell."""
    out = _schema_with(df, name, "array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            four = grid.edge_neighbors(b.column(cell).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(four.tolist(), pa.list_(pa.int64()))], [*b.schema.names, name])

    return df.mapInArrow(run, out)


def with_exact_area(df: DataFrame, cell: str = "cell", name: str = "area") -> DataFrame:
    out = _schema_with(df, name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grid.exact_area(b.column(cell).to_numpy()))], [*b.schema.names, name])

    return df.mapInArrow(run, out)


def with_orientation(df: DataFrame, a: str, b: str, c: str, name: str = "sign") -> DataFrame:
    out = _schema_with(df, name, "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = P.orientation(*(points_array(x.column(k)) for k in (a, b, c)))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(s, pa.int32())], [*x.schema.names, name])

    return df.mapInArrow(run, out)


def with_overlay(df: DataFrame, a: str, b: str, op: str, name: str = "rings") -> DataFrame:
    """Union, intersection, difference or symmetric difference of two polygons."""

    def kernel(x, y):
        rings = overlay.combine([shapes.unpack(r) for r in x], [shapes.unpack(r) for r in y], op)
        return [structs(r) for r in rings]

    return with_kernel(df, name, RINGS_SQL, pa.list_(CHAIN), [a, b], kernel)


def with_buffer(df: DataFrame, radius: float, chain: str = "chain", name: str = "rings") -> DataFrame:
    """Polygon of all points within a radius of a chain."""
    return with_kernel(df, name, RINGS_SQL, pa.list_(CHAIN), [chain], lambda c: [structs(r) for r in overlay.buffer_chain(shapes.unpack(c), radius)])


def polygon_relations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds contains, intersects and equal of two polygons."""

    def kernel(x, y):
        p, q = [shapes.unpack(r) for r in x], [shapes.unpack(r) for r in y]
        return overlay.relations(p, q)

    sql = "struct<contains:boolean,intersects:boolean,equal:boolean>"
    kind = pa.struct([(c, pa.bool_()) for c in ("contains", "intersects", "equal")])
    return with_kernel(df, "relation", sql, kind, [a, b], kernel).select("*", "relation.*").drop("relation")


def _crossing_rings(parts: list[np.ndarray]) -> set[tuple[int, int]]:
    """Pairs of rings with sides that cross, each with itself included, in blocks of sides."""
    a = np.concatenate(parts)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in parts])
    of = np.repeat(np.arange(len(parts)), [len(r) for r in parts])
    found: set[tuple[int, int]] = set()
    step = max(1, 200_000 // len(a))
    for s in range(0, len(a), step):
        i, j = np.nonzero(P.crossing(a[s : s + step, None], b[s : s + step, None], a[None], b[None]) > 0)
        found |= {(int(min(x, y)), int(max(x, y))) for x, y in zip(of[i + s], of[j], strict=True)}
    return found


def validate(rings: DataFrame) -> DataFrame:
    """id, code, message of every rule that a polygon (id, rings) breaks: rings of under three
    vertices, points off the sphere or not finite, repeated or antipodal neighbours, sides that
    cross within a ring or between rings, sides used twice in one direction, and rings whose
    direction does not fit how deep they lie."""

    def kernel(value):
        found = []
        parts = [shapes.unpack(r) for r in value]
        sound = True
        for k, r in enumerate(parts):
            if len(r) < 3:
                found.append(("not_enough_vertices", f"ring {k} has {len(r)} vertices"))
                continue
            if not np.isfinite(r).all():
                found.append(("invalid_vertex", f"ring {k} has a vertex that is not finite"))
                sound = False
                continue
            if (np.abs((r * r).sum(1) - 1) > 1e-14).any():
                found.append(("not_unit_length", f"ring {k} has a vertex off the sphere"))
            nxt = np.roll(r, -1, axis=0)
            if (r == nxt).all(1).any():
                found.append(("duplicate_vertices", f"ring {k} repeats a vertex"))
            if (r == -nxt).all(1).any():
                found.append(("antipodal_vertices", f"ring {k} has an edge between antipodes"))
        whole = [r for r in parts if len(r) >= 3]
        if whole and sound:
            crossing = _crossing_rings(whole)
            if any(x == y for x, y in crossing):
                found.append(("edges_cross", "two edges of a ring cross"))
            if any(x != y for x, y in crossing):
                found.append(("rings_cross", "edges of two rings cross"))
            sides = [(tuple(p), tuple(q)) for r in whole for p, q in zip(r.tolist(), np.roll(r, -1, axis=0).tolist(), strict=True) if p != q]
            if len(set(sides)) < len(sides):
                found.append(("duplicate_edges", "an edge is there twice"))
            if not found and len(whole) > 1:
                wrong = [k for k, (r, (_, depth)) in enumerate(zip(whole, shapes.nesting(whole), strict=True)) if (shapes.signed_area(r) < 0) != (depth % 2 == 1)]
                if wrong:
                    found.append(("inconsistent_orientation", f"ring {wrong[0]} runs the wrong way round"))
        return [{"code": c, "message": m} for c, m in found]

    sql = "array<struct<code:string,message:string>>"
    kind = pa.list_(pa.struct([("code", pa.string()), ("message", pa.string())]))
    out = with_kernel(rings.select("id", "rings"), "found", sql, kind, ["rings"], kernel)
    return out.select("id", F.explode("found").alias("f")).select("id", "f.code", "f.message")
