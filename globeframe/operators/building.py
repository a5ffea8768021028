"""Building, snapping and combining shapes of all dimensions, and edge predicates, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..kernels import builder
from ..kernels import predicates as P
from .geometry import CHAIN, CHAIN_SQL, POINT, RINGS_SQL, _is_point, _schema_with, structs, with_kernel
from .spatial_join import points_array

RINGS = pa.list_(CHAIN)
SHAPE_SQL = f"struct<points:{CHAIN_SQL},chains:{RINGS_SQL},rings:{RINGS_SQL}>"
SHAPE = pa.struct([("points", CHAIN), ("chains", RINGS), ("rings", RINGS)])


def with_snapped_polygon(df: DataFrame, rings: str, options: builder.Options, name: str = "built") -> DataFrame:
    """A polygon built anew: snapped, simplified, its crossing edges split if asked."""
    return with_kernel(df, name, RINGS_SQL, RINGS, [rings], lambda r: [structs(x) for x in builder.polygon(r, options)])


def with_built_chains(df: DataFrame, chains: str, options: builder.Options, name: str = "built") -> DataFrame:
    """Chains (array of chains) built anew, as maximal walks."""
    return with_kernel(df, name, RINGS_SQL, RINGS, [chains], lambda c: [structs(x) for x in builder.polylines(c, options)])


def with_degeneracies(df: DataFrame, rings: str = "rings", name: str = "degenerate") -> DataFrame:
    """Sides without length (point) and sides that another goes back along (sibling)."""
    kind = pa.list_(pa.struct([("ring", pa.int32()), ("side", pa.int32()), ("kind", pa.string())]))
    return with_kernel(df, name, "array<struct<ring:int,side:int,kind:string>>", kind, [rings], lambda r: [dict(zip(("ring", "side", "kind"), x, strict=True)) for x in builder.degeneracies(r)])


def with_combined(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], op: str, polygon_model: str = "semi_open", name: str = "combined") -> DataFrame:
    """An operation on two shapes given as columns (points, chains, rings) each: a struct of the same."""

    def kernel(*v):
        p, c, r = builder.combine((v[0].reshape(-1, 3), v[1], v[2]), (v[3].reshape(-1, 3), v[4], v[5]), op, polygon_model)
        return {"points": structs(p), "chains": [structs(x) for x in c], "rings": [structs(x) for x in r]}

    return with_kernel(df, name, SHAPE_SQL, SHAPE, [*a, *b], kernel)


def with_predicate(df: DataFrame, kind: str, *columns: str, name: str | None = None) -> DataFrame:
    """Adds the exact sign of a predicate on point columns: ``orientation`` (a, b, c), ``crossing``
    (a, b, c, d: 1, 0 shared end, -1), ``compare_distances`` (x, a, b), ``compare_distance`` (x, y,
    squared chord), ``compare_edge_distance`` (x, a, b, chord), ``compare_edge_pair_distance`` (a,
    b, c, d, chord), ``compare_edge_directions`` (a, b, c, d), ``sign_dot`` (a, b)."""
    kernel = getattr(P, kind)
    name = name or kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = [points_array(c) if _is_point(c.type) else c.to_numpy(zero_copy_only=False) for c in map(b.column, columns)]
                yield b.append_column(name, pa.array(np.asarray(kernel(*values)).astype(np.int32)))

    return df.mapInArrow(run, _schema_with(df, name, "int"))


def with_intersection(df: DataFrame, a: str, b: str, c: str, d: str, name: str = "meets") -> DataFrame:
    """Where the arcs ab and cd cross; null where they do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = [points_array(batch.column(k)) for k in (a, b, c, d)]
                hit, at = P.crossing(*p) > 0, P.intersection(*p)
                yield batch.append_column(name, pa.array([structs(x[None])[0] if h else None for x, h in zip(at, hit, strict=True)], POINT))

    return df.mapInArrow(run, _schema_with(df, name, "struct<x:double,y:double,z:double>"))


def with_faces(df: DataFrame, a: str, b: str, name: str = "faces") -> DataFrame:
    """The cube faces that each arc touches, with the (u, v) of its part there."""
    kind = pa.list_(pa.struct([("face", pa.int32()), *((c, pa.float64()) for c in ("u0", "v0", "u1", "v1"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = points_array(batch.column(a)), points_array(batch.column(b))
                found = [P.clip_to_face(p, q, f) for f in range(6)]
                rows = [[{"face": f, "u0": u[k, 0], "v0": u[k, 1], "u1": v[k, 0], "v1": v[k, 1]} for f, (u, v, some) in enumerate(found) if some[k]] for k in range(len(p))]
                yield batch.append_column(name, pa.array(rows, kind))

    return df.mapInArrow(run, _schema_with(df, name, "array<struct<face:int,u0:double,v0:double,u1:double,v1:double>>"))


