"""Aggregations over points, arcs and chains."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import vectors as V
from ..kernels import shapes
from .spatial_join import points_array

PI = math.pi


def bounding_rect(points: DataFrame, key: str) -> DataFrame:
    """key, lat_lo, lat_hi, lng_lo, lng_hi (degrees): the longitudes leave out the widest gap.

    The gap is found by one window over distinct longitudes of a key, after an aggregation
    has made them distinct.  Gaps are compared in millionths of a degree, and of equal ones
    the westernmost is left out, so rounding does not choose between them.
    """
    lats = points.groupBy(key).agg(F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"))
    lngs = points.select(key, "lng").distinct()
    w = Window.partitionBy(key).orderBy("lng")
    first = F.min("lng").over(Window.partitionBy(key))
    gap = F.coalesce(F.lead("lng").over(w), first + 360) - F.col("lng")
    gaps = lngs.withColumn("g", F.struct(F.round(gap, 6).alias("gap"), (-F.col("lng")).alias("neg"), F.coalesce(F.lead("lng").over(w), first).alias("after")))
    ends = gaps.groupBy(key).agg(F.max("g").alias("g"))
    return lats.join(ends, key).select(key, "lat_lo", "lat_hi", F.col("g.after").alias("lng_lo"), (-F.col("g.neg")).alias("lng_hi"))


def bounding_cap(points: DataFrame, key: str) -> DataFrame:
    """key, center, radians: a disc about the mean direction that holds all points."""
    mean = points.groupBy(key).agg(*(F.sum(F.col("p")[c]).alias(c) for c in "xyz"))
    mean = mean.select(key, V.normalize(F.struct("x", "y", "z")).alias("center"))
    far = points.join(mean, key).groupBy(key).agg(F.max(V.angle("p", "center")).alias("radians"))
    return mean.join(far, key)


def path_length(arcs: DataFrame, key: str) -> DataFrame:
    """key, radians: summed length of arcs (a, b)."""
    return arcs.groupBy(key).agg(F.sum(V.angle("a", "b")).alias("radians"))


def cumulative_length(points: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``along``: the length of the key's path up to each point."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.coalesce(V.angle(F.lag("p").over(w), "p"), F.lit(0.0))
    stepped = points.withColumn("step", step)
    return stepped.withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def path_at(points: DataFrame, key: str, fraction: float, *order: str) -> DataFrame:
    """key, p: the point at a share of each path's length."""
    along = cumulative_length(points, key, *order)
    w = Window.partitionBy(key).orderBy(*order)
    seg = along.withColumns({"total": F.max("along").over(Window.partitionBy(key)), "p2": F.lead("p").over(w), "along2": F.lead("along").over(w)})
    target = F.col("total") * fraction
    hit = seg.filter((F.col("p2").isNull() & (target >= F.col("along"))) | ((F.col("along") <= target) & (target < F.col("along2"))))
    p = F.when(F.col("p2").isNull(), F.col("p")).otherwise(V.at_distance("p", "p2", target - F.col("along")))
    p = F.when(target == F.col("along"), F.col("p")).otherwise(p)
    return hit.select(key, p.alias("p"))


def path_centroid(arcs: DataFrame, key: str) -> DataFrame:
    """key, centroid: of the arcs, times their length."""
    c = V.edge_centroid("a", "b")
    sums = arcs.withColumn("c", c).groupBy(key).agg(*(F.sum(F.col("c")[k]).alias(k) for k in "xyz"))
    return sums.select(key, F.struct("x", "y", "z").alias("centroid"))


def chain_length(chain) -> Column:
    """Length of an array of points."""
    n = F.size(chain)
    pairs = F.zip_with(F.slice(chain, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chain, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: V.angle(a, b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def ring_area(ring) -> Column:
    """Signed area of an array of points: fan of triangles by their half-tangent form."""
    n = F.size(ring)
    o = F.element_at(ring, 1)
    part = F.zip_with(
        F.slice(ring, F.lit(2), F.greatest(n - 2, F.lit(0))),
        F.slice(ring, F.lit(3), F.greatest(n - 2, F.lit(0))),
        lambda b, c: 2 * F.atan2(V.dot(o, V.cross(V.subtract(b, o), V.subtract(c, o))), 1 + V.dot(o, b) + V.dot(b, c) + V.dot(c, o)),
    )
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x)


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """key, hull (array of points), counterclockwise.

    Hulls of parts are hulls of the whole's candidates: each key is first reduced within
    salts, so that one key's points do not meet in one task before they are few.
    """
    kind = points.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, hull array<struct<x:double,y:double,z:double>>"

    def fold(table: pa.Table, p: np.ndarray, open_ended: bool) -> pa.Table:
        ring = shapes.hull(p)
        keep = p if open_ended and not len(ring) else ring
        value = [[dict(zip("xyz", map(float, v), strict=True)) for v in keep]]
        return pa.table([table.column(key).slice(0, 1), pa.array(value, pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"])))], [key, "hull"])

    def part(table: pa.Table) -> pa.Table:
        return fold(table, points_array(table.column("p")), True)

    def whole(table: pa.Table) -> pa.Table:
        rows = [shapes.unpack(h) for h in table.column("hull").to_pylist() if h]
        return fold(table, np.concatenate(rows) if rows else np.zeros((0, 3)), False)

    salted = points.select(key, "p", F.pmod(F.xxhash64("p"), F.lit(16)).alias("salt"))
    parts = salted.groupBy(key, "salt").applyInArrow(part, schema)
    return parts.groupBy(key).applyInArrow(whole, schema)


def directed_hausdorff(target: DataFrame, source: DataFrame, pairs: DataFrame) -> DataFrame:
    """target_id, source_id, radians for each asked pair (target_id, source_id): over target
    vertices (target_id, p) the largest distance to the source's nearest arc (source_id, a, b)."""
    near = pairs.join(target, "target_id").join(source, "source_id").groupBy("target_id", "source_id", "p").agg(F.min(V.segment_distance("p", "a", "b")).alias("near"))
    return near.groupBy("target_id", "source_id").agg(F.max("near").alias("radians"))


def longitude_interval(points: DataFrame, key: str) -> DataFrame:
    box = bounding_rect(points, key)
    return box.select(key, I.s_make(F.radians("lng_lo"), F.radians("lng_hi")).alias("lng"))


def dense_ids(rows: DataFrame, *columns: str, name: str = "id", ranges: int = 256) -> DataFrame:
    """Dictionary encoding: distinct values numbered from 0 in order, nulls first.

    A sample of at most ``ranges`` values (the least hashes) cuts the order into ranges of
    about one size; values are numbered within their range, and each range starts at the
    count of those before it, so no task sees all values."""
    values = rows.select(*columns).distinct()
    value = F.struct(*columns)
    sample = values.orderBy(F.xxhash64(*columns)).limit(ranges).orderBy(*columns).collect()
    kinds = [values.schema[c].dataType for c in columns]
    cuts = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, columns, strict=True))) for r in sample))
    part = F.size(F.filter(cuts, lambda c: c <= value)) if sample else F.lit(0)
    parted = values.select(*columns, part.alias("_part"))
    numbered = parted.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*columns)))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return numbered.join(F.broadcast(base), "_part").select(*columns, (F.col("_base") + F.col("_nth") - 1).alias(name))
