"""Queries on indexes of edges and cells: nearest, farthest, within, containing.

An index of edges is a DataFrame (shape_id, edge_id, a, b).  Targets are rows (target_id, a,
b), several rows making one target: a point has a = b, an edge one row, a cell its four
sides, an index all its edges.  Edges are entered under the cells that they may meet within
a radius and targets under the cells that they meet, so all pairs within the radius share a
cell; the exact distance is taken once for a pair of edge and target row in a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import vectors as V
from ..kernels import cell_distance, cover, grid, shapes
from ..kernels import predicates as P
from .geometry import _values
from .lineage import cut, spread
from .spatial_join import _arc_cells, crossings_in_order, level_for, point_in_polygon, points_array

POINT_SQL = "struct<x:double,y:double,z:double>"
#: The edge id of a shape's interior.
INTERIOR = -1
#: The most rows of targets that are sent to all tasks (under 1 MB).
FEW = 4096


def edge_scan(shapes_: DataFrame, closed: bool = False) -> DataFrame:
    """The edges of shapes (shape_id, chains), by ``posexplode`` of each chain's pairs."""
    one = shapes_.select("shape_id", F.posexplode("chains").alias("chain", "c"))
    last = F.size("c") if closed else F.size("c") - 1
    rows = one.filter(last > 0).select("shape_id", "chain", "c", F.explode(F.sequence(F.lit(1), last)).alias("k"))
    rows = rows.select("shape_id", "chain", "k", F.element_at("c", F.col("k")).alias("a"), F.element_at("c", F.col("k") % F.size("c") + 1).alias("b"))
    nth = F.row_number().over(Window.partitionBy("shape_id").orderBy("chain", "k"))
    return rows.select("shape_id", (nth - 1).alias("edge_id"), "a", "b")


def point_targets(points: DataFrame) -> DataFrame:
    """Targets from points (target_id, q)."""
    return points.select("target_id", F.col("q").alias("a"), F.col("q").alias("b"))


def cell_targets(cells: DataFrame) -> DataFrame:
    """Targets from cells (target_id, cell): their four sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = grid.corners(b.column("cell").to_numpy())
                ids = np.repeat(b.column("target_id").to_numpy(), 4)
                yield pa.RecordBatch.from_arrays([pa.array(ids), _points(a.reshape(-1, 3)), _points(np.roll(a, -1, axis=1).reshape(-1, 3))], ["target_id", "a", "b"])

    return cells.select(F.col("target_id").cast("long").alias("target_id"), "cell").mapInArrow(run, f"target_id long, a {POINT_SQL}, b {POINT_SQL}")


def _points(p: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)], ["x", "y", "z"])


def _entered(rows: DataFrame, level: int, margin: float) -> DataFrame:
    """Rows with a and b once for each cell of a level that the arc may meet within a margin."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, cells = _arc_cells(points_array(b.column("a")), points_array(b.column("b")), level, margin)
                yield b.take(pa.array(at, pa.int64())).append_column("cell", pa.array(cells, pa.int64()))

    return rows.mapInArrow(run, schema + ", cell long")


def _few_targets(targets: DataFrame) -> tuple | None:
    """The rows of targets as arrays (target_id, a, b), unless there are more than ``FEW``."""
    t = targets.select("target_id", "a", "b").limit(FEW + 1).toArrow().combine_chunks()
    return (t.column("target_id").combine_chunks(), points_array(t.column("a")), points_array(t.column("b"))) if t.num_rows <= FEW else None


def _pairs_in_cells(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, radius: float, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (arc ab, arc cd) that share a cell, arcs ab being entered with a margin: each once.

    Cells are walked from the faces, and one that either side misses is left with all below it;
    so an arc has work only where there are targets."""
    if not len(a) or not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cells = np.repeat(np.arange(len(a)), 6), np.tile(grid.faces(), len(a))
    asked, places = np.repeat(np.arange(len(c)), 6), np.tile(grid.faces(), len(c))

    def meet(rows, cells, p, q, margin):
        few, at = np.unique(cells, return_inverse=True)
        center, reach = grid.cell_bound(few)
        hit = P.segment_distance(center[at], p[rows], q[rows]) <= reach[at] + margin + 1e-15
        return rows[hit], cells[hit]

    for k in range(deepest + 1):
        asked, places = meet(asked, places, c, d, 0.0)
        live = np.isin(cells, places)
        rows, cells = meet(rows[live], cells[live], a, b, radius)
        live = np.isin(places, cells)
        asked, places = asked[live], places[live]
        if k < deepest:
            rows, cells = np.repeat(rows, 4), grid.children(cells).ravel()
            asked, places = np.repeat(asked, 4), grid.children(places).ravel()
    order = np.argsort(places, kind="stable")
    asked, places = asked[order], places[order]
    low, high = np.searchsorted(places, cells, "left"), np.searchsorted(places, cells, "right")
    n = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    both = np.unique(np.repeat(rows, n) * len(c) + asked[at])
    return both // len(c), both % len(c)


def _within_few(edges: DataFrame, few: tuple, radius: float, level: int) -> DataFrame:
    """``edges_within`` for targets that every task holds: edges are not entered under cells without
    a target, nor moved."""
    ids, c, d = few
    sent = (ids.to_numpy(zero_copy_only=False), c, d)
    kind, target_kind = ids.type, pa.types.is_string(ids.type) and "string" or "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, d = sent
        for whole in batches:
            for s in range(0, whole.num_rows, 1 << 11):
                b = whole.slice(s, 1 << 11)
                p, q = points_array(b.column("a")), points_array(b.column("b"))
                i, j = _pairs_in_cells(p, q, c, d, radius, level)
                r = np.zeros(len(i))
                for k in range(0, len(i), 1 << 15):
                    x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                    r[k : k + (1 << 15)] = P.segment_pair_distance(p[x], q[x], c[y], d[y])
                near = r <= radius
                taken = b.select(["shape_id", "edge_id"]).take(pa.array(i[near], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names[j[near]], kind), *taken.columns, pa.array(r[near])], ["target_id", "shape_id", "edge_id", "radians"])

    shape = edges.schema["shape_id"].dataType.simpleString()
    return edges.select("shape_id", "edge_id", "a", "b").mapInArrow(run, f"target_id {target_kind}, shape_id {shape}, edge_id int, radians double")


def edges_within(edges: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """target_id, shape_id, edge_id, radians of the edges at most ``radius`` from a target.

    Long edges meet very many small cells, so up to ``FEW`` targets go to the edges; more are
    joined with them on cells."""
    level = min(level_for(max(radius, 1e-9)), 8)
    few = _few_targets(targets)
    if few is not None:
        return _within_few(edges, few, radius, level).groupBy("target_id", "shape_id", "edge_id").agg(F.min("radians").alias("radians"))
    right = _entered(targets.select("target_id", "a", "b"), level, 0.0).select("target_id", F.col("a").alias("c"), F.col("b").alias("d"), "cell")
    pairs = _entered(edges.select("shape_id", "edge_id", "a", "b"), level, radius).join(right, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1 << 15):
                part = b.slice(s, 1 << 15)
                d = P.segment_pair_distance(*(points_array(part.column(c)) for c in "abcd"))
                near = pa.array(d <= radius)
                yield part.select(["target_id", "shape_id", "edge_id"]).filter(near).append_column("radians", pa.array(d).filter(near))

    kind = edges.schema["shape_id"].dataType.simpleString()
    found = pairs.select("target_id", "shape_id", "edge_id", *"abcd").mapInArrow(run, f"target_id long, shape_id {kind}, edge_id int, radians double")
    return found.groupBy("target_id", "shape_id", "edge_id").agg(F.min("radians").alias("radians"))


def interiors(polygons: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, shape_id of the polygons (shape_id, rings) that hold an end of a target's row."""
    ends = targets.select("target_id", "a").union(targets.filter("a <> b").select("target_id", "b")).distinct()
    ends = ends.select(F.col("target_id").alias("id"), F.col("a").alias("p"))
    hits = point_in_polygon(ends, polygons.select(F.col("shape_id").alias("polygon_id"), "rings"))
    return hits.select(F.col("id").alias("target_id"), F.col("polygon_id").alias("shape_id")).distinct()


def _nearest(within: Callable[[DataFrame, float], DataFrame], targets: DataFrame, k: int, first: float, limit: float, order: list, slack: float = 0.0) -> DataFrame:
    """The k first rows of each target by ``order``: discs grow until they hold k rows, so a
    target is finished once its k-th row lies within the radius.  Where ``order`` takes distances
    less than ``slack`` apart for equal, the k-th must lie that far within it."""
    best = Window.partitionBy("target_id").orderBy(*order)
    radius, todo, out = max(first, 1e-7), targets, None
    while True:
        last = radius >= limit
        ranked = within(todo, min(radius, limit)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ranked = cut(ranked)
        full = ranked.filter((F.col("rank") == k) & (F.col("radians") <= radius - slack)).select("target_id")
        part = ranked if last else ranked.join(full, "target_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if last:
            return out
        todo = cut(todo.join(full, "target_id", "left_anti"))
        if todo.isEmpty():
            return out
        radius *= 3


def closest_edges(edges: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, polygons: DataFrame | None = None, inclusive: bool = False, touching: DataFrame | None = None) -> DataFrame:
    """target_id, rank, shape_id, edge_id, radians: each target's k nearest edges, by distance,
    shape and edge.

    ``max_distance`` is exclusive unless ``inclusive``.  With ``polygons`` (shape_id, rings)
    a target inside one has it at distance 0, as edge -1.  ``touching`` (target_id, shape_id,
    edge_id) are pairs known to meet, such as the edges inside a target cell."""
    limit = math.pi if max_distance is None else min(math.pi, max_distance)
    zero = F.lit(0.0).alias("radians")
    known = []
    if polygons is not None:
        known.append(interiors(polygons, targets).select("target_id", "shape_id", F.lit(INTERIOR).alias("edge_id"), zero))
    if touching is not None:
        known.append(touching.select("target_id", "shape_id", "edge_id", zero))
    inner = cut(reduce(DataFrame.unionByName, known)) if known else None

    def within(todo: DataFrame, radius: float) -> DataFrame:
        found = edges_within(edges, todo, radius)
        if inner is not None:
            found = found.unionByName(inner.join(todo.select("target_id").distinct(), "target_id", "left_semi"))
            found = found.groupBy("target_id", "shape_id", "edge_id").agg(F.min("radians").alias("radians"))
        return found if max_distance is None or inclusive or radius < limit else found.filter(F.col("radians") < limit)

    n = edges.count()
    first = math.acos(max(-1.0, 1 - 2 * min(1.0, 4 * k / max(1, n))))
    return _nearest(within, targets, k, first, limit, ["radians", "shape_id", "edge_id"]).select("target_id", "rank", "shape_id", "edge_id", "radians")


def closest_points(points: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, inclusive: bool = False) -> DataFrame:
    """target_id, rank, id, radians: the k nearest points (id, p) of targets of any kind, by distance
    and id.  A region filter is a filter on the points."""
    as_edges = points.select(F.col("id").alias("shape_id"), F.lit(0).alias("edge_id"), F.col("p").alias("a"), F.col("p").alias("b"))
    found = closest_edges(as_edges, targets, k, max_distance, inclusive=inclusive)
    return found.select("target_id", "rank", F.col("shape_id").alias("id"), "radians")


def edges_in_cells(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """target_id, shape_id, edge_id of the edges that start in cells (target_id, cell): with those that
    cross a side, all that meet them."""
    leaf = C.with_cell(edges.select("shape_id", "edge_id", "a"), "a", "leaf")
    up = leaf.select("shape_id", "edge_id", F.explode(_ancestors("leaf")).alias("cell"))
    return up.join(cells.select("target_id", "cell"), "cell").select("target_id", "shape_id", "edge_id")


def furthest_edges(edges: DataFrame, targets: DataFrame, k: int = 1, min_distance: float | None = None) -> DataFrame:
    """target_id, rank, shape_id, edge_id, radians: the k farthest edges, the farthest point of an
    edge counting; ``min_distance`` is exclusive.  They are the nearest to the antipodal target."""
    turned = targets.select("target_id", V.scale("a", -1.0).alias("a"), V.scale("b", -1.0).alias("b"))
    limit = None if min_distance is None else math.pi - min_distance
    near = closest_edges(edges, turned, k, limit)
    return near.withColumn("radians", F.lit(math.pi) - F.col("radians"))


def targets_within(edges: DataFrame, targets: DataFrame, limit: float, or_equal: bool = False, conservative: bool = False) -> DataFrame:
    """The ids of targets with an edge nearer than ``limit``: strictly, or at it too, or within the
    error of a distance beyond it."""
    reach = limit * (1 + 8 * 2.0**-52) + 1e-15 if conservative else limit
    found = edges_within(edges, targets, reach)
    return (found if or_equal or conservative else found.filter(F.col("radians") < limit)).select("target_id").distinct()


def closest_shapes(edges: DataFrame, targets: DataFrame, radius: float, polygons: DataFrame | None = None) -> DataFrame:
    """target_id, rank, shape_id, radians: the shapes within a radius, nearest first, each by its
    nearest edge or its interior."""
    found = edges_within(edges, targets, radius).select("target_id", "shape_id", "radians")
    if polygons is not None:
        found = found.unionByName(interiors(polygons, targets).withColumn("radians", F.lit(0.0)))
    near = found.groupBy("target_id", "shape_id").agg(F.min("radians").alias("radians"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy("radians", "shape_id")))


# Cells.


def cells_within(cells: DataFrame, targets: DataFrame, radius: float, inside: DataFrame | None = None) -> DataFrame:
    """target_id, cell, label, radians of the cells (cell, label) within a radius of targets."""
    found = edges_within(_cell_sides(cells).select(F.struct("cell", "label").alias("shape_id"), "edge_id", "a", "b"), targets, radius)
    found = found.groupBy("target_id", "shape_id").agg(F.min("radians").alias("radians")).select("target_id", "shape_id.cell", "shape_id.label", "radians")
    held = _holding(cells, targets) if inside is None else inside
    return found.unionByName(held.withColumn("radians", F.lit(0.0))).groupBy("target_id", "cell", "label").agg(F.min("radians").alias("radians"))


def _cell_sides(cells: DataFrame) -> DataFrame:
    kind = cells.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = grid.corners(b.column("cell").to_numpy())
                four = b.select(["cell", "label"]).take(pa.array(np.repeat(np.arange(b.num_rows), 4)))
                yield four.append_column("edge_id", pa.array(np.tile(np.arange(4), b.num_rows), pa.int32())).append_column("a", _points(a.reshape(-1, 3))).append_column("b", _points(np.roll(a, -1, axis=1).reshape(-1, 3)))

    return cells.select("cell", "label").mapInArrow(run, f"cell long, label {kind}, edge_id int, a {POINT_SQL}, b {POINT_SQL}")


def _ancestors(leaf: str) -> Column:
    """The cells of all levels that hold a leaf."""
    return F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: C.parent(F.col(leaf), k))


def _holding(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, cell, label of the cells that hold an end of a target's row."""
    ends = targets.select("target_id", F.col("a").alias("p")).union(targets.select("target_id", "b")).distinct()
    leaf = C.with_cell(ends, "p", "leaf").select("target_id", "leaf")
    up = leaf.select("target_id", F.explode(_ancestors("leaf")).alias("cell")).distinct()
    return up.join(cells.select("cell", "label"), "cell").select("target_id", "cell", "label").distinct()


def closest_cells(cells: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, inside: DataFrame | None = None) -> DataFrame:
    """target_id, rank, cell, label, radians: the k nearest cells (cell, label) of each target, by
    distance, cell in curve order, label.  Neighbours share their sides, so distances are equal
    if they agree to 12 places.  ``inside`` (target_id, cell, label) are pairs known to overlap;
    left out, they are the cells that hold an end of a target's row."""
    limit = math.pi if max_distance is None else min(math.pi, max_distance)
    held = cut(_holding(cells, targets) if inside is None else inside)

    def within(todo: DataFrame, radius: float) -> DataFrame:
        found = cells_within(cells, todo, radius, held.join(todo.select("target_id").distinct(), "target_id", "left_semi"))
        return found if max_distance is None or radius < limit else found.filter(F.col("radians") < limit)

    n = cells.count()
    first = math.acos(max(-1.0, 1 - 2 * min(1.0, 4 * k / max(1, n))))
    return _nearest(within, targets, k, first, limit, [F.round("radians", 12), C.order_key("cell"), "label"], 2e-12).select("target_id", "rank", "cell", "label", "radians")


def cell_join(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """left_id, right_id of cells (left_id, left_cell), (right_id, right_cell) at most ``tolerance``
    apart, overlapping ones included."""
    from .spatial_join import cell_overlap

    targets = cell_targets(left.select(F.col("left_id").alias("target_id"), F.col("left_cell").alias("cell")))
    near = edges_within(_cell_sides(right.select(F.col("right_cell").alias("cell"), F.col("right_id").alias("label"))).select(F.col("label").alias("shape_id"), "edge_id", "a", "b"), targets, tolerance)
    over = cell_overlap(left, right).select("left_id", "right_id")
    return near.select(F.col("target_id").alias("left_id"), F.col("shape_id").alias("right_id")).union(over).distinct()


def leaf_ranges(cells: DataFrame) -> DataFrame:
    """begin, end (leaf cells, both included) of the stretches of the curve that the starts and
    ends of cells (cell) cut it into, empty ones left out.

    Cells end with their face, so the faces are cut apart; within one the cuts are sorted."""
    own = cells.select("cell").distinct()
    starts = own.select(C.range_min("cell").alias("leaf"))
    stops = own.select(C.range_max("cell").alias("last"))
    whole = F.lit((1 << 61) - 1)
    stops = stops.filter(F.col("last").bitwiseAND(whole) != whole).select((F.col("last") + 2).alias("leaf"))
    cuts = cut(starts.union(stops).distinct()).withColumn("face", C.face("leaf"))
    after = F.lead("leaf").over(Window.partitionBy("face").orderBy(C.order_key("leaf")))
    final = F.shiftleft(F.col("face").cast("long"), 61).bitwiseOR(whole)
    ranges = cut(cuts.select(F.col("leaf").alias("begin"), F.coalesce(after - 2, final).alias("end")))
    held = range_contents(own.withColumn("label", F.lit(0)), ranges).select("begin").distinct()
    return ranges.join(held, "begin", "left_semi")


def range_contents(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """begin, end, cell, label: the cells (cell, label) that hold each range of ``leaf_ranges``."""
    up = ranges.select("begin", "end", F.explode(_ancestors("begin")).alias("cell"))
    return up.join(cells.select("cell", "label"), "cell").select("begin", "end", "cell", "label").distinct()


def range_totals(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """begin, n, labels: how many different (cell, label) hold each range of ``leaf_ranges``, and the
    sum of their labels; a cell's labels are added up before they meet the ranges."""
    per = cells.select("cell", "label").distinct().groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))
    up = ranges.select("begin", F.explode(_ancestors("begin")).alias("cell"))
    return up.join(per, "cell").groupBy("begin").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"))


def seek(index: DataFrame, cell: int, column: str = "cell") -> DataFrame:
    """An index of points from a cell on, in curve order."""
    return index.filter(C.order_key(column) >= C.order_key(F.lit(cell))).orderBy(C.order_key(column))


# Points and vertices.


def containing(points: DataFrame, polygons: DataFrame, model: str = "semi_open") -> DataFrame:
    """id, polygon_id of the polygons (polygon_id, rings) that hold points (id, p).

    A point that is a vertex is in no polygon if ``open``, in all of its polygons if
    ``closed``, and in one of those that tile around it if ``semi_open``."""
    inside = point_in_polygon(points, polygons)
    if model == "semi_open":
        return inside
    corners = polygons.select("polygon_id", F.explode(F.flatten("rings")).alias("p")).distinct()
    on = points.select("id", "p").join(corners, "p").select("id", "polygon_id")
    if model == "open":
        return inside.join(on, ["id", "polygon_id"], "left_anti")
    if model == "closed":
        return inside.unionByName(on).distinct()
    raise ValueError("model is open, semi_open or closed")


def incident_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """id, shape_id, edge_id of the edges that start or end at points (id, p)."""
    ends = edges.select("shape_id", "edge_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))
    return points.select("id", "p").join(ends, "p").select("id", "shape_id", "edge_id")


def contains_vertex(edges: DataFrame) -> DataFrame:
    """vertex, sign for every end of edges (a, b): 1 if the region on the left of the edges holds
    it, -1 if not, 0 if all edges there cancel each other.

    The unmatched edge next to the vertex's reference direction decides."""
    out = edges.select(F.col("a").alias("vertex"), F.col("b").alias("other"), F.lit(1).alias("way"))
    back = edges.select(F.col("b").alias("vertex"), F.col("a").alias("other"), F.lit(-1).alias("way"))
    sums = out.union(back).filter("vertex <> other").groupBy("vertex", "other").agg(F.sum("way").cast("int").alias("way"))

    def decide(t: pa.Table) -> pa.Table:
        at, others, way = points_array(t.column("vertex")), points_array(t.column("other")), t.column("way").to_numpy()
        ref = P.reference_dir(at[:1])[0]
        best, sign = ref, 0
        for k in np.flatnonzero(way):
            if P.ordered_ccw(ref, best, others[k], at[0]):
                best, sign = others[k], int(np.sign(way[k]))
        return pa.table([t.column("vertex").slice(0, 1), pa.array([sign], pa.int32())], ["vertex", "sign"])

    return sums.groupBy("vertex").applyInArrow(decide, f"vertex {POINT_SQL}, sign int")


def self_intersections(edges: DataFrame) -> DataFrame:
    """shape_id, left_edge, right_edge: the first pair of edges of each shape that cross, if any.

    A shape's edges meet in one task, in order, a block against all that follow; the first block
    with a crossing ends the shape, and memory is that of the block."""
    kind = edges.schema["shape_id"].dataType.simpleString()

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by("edge_id")
        ids, a, b = t.column("edge_id").to_numpy(), points_array(t.column("a")), points_array(t.column("b"))
        for left, right in crossings_in_order(a, b):
            if len(left):
                k = np.lexsort((ids[right], ids[left]))[0]
                return pa.table([t.column("shape_id").slice(0, 1), pa.array(ids[left[k : k + 1]], pa.int32()), pa.array(ids[right[k : k + 1]], pa.int32())], ["shape_id", "left_edge", "right_edge"])
        return pa.table([t.column("shape_id").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.int32())], ["shape_id", "left_edge", "right_edge"])

    own = spread(edges.select("shape_id", "edge_id", "a", "b").filter("shape_id IS NOT NULL AND edge_id IS NOT NULL"), "shape_id")
    return own.groupBy("shape_id").applyInArrow(first, f"shape_id {kind}, left_edge int, right_edge int")


def cell_shapes(cells: DataFrame, polygons: DataFrame, max_cells: int = 32) -> DataFrame:
    """target_id, polygon_id, contains: the polygons (polygon_id, rings) that meet each cell
    (target_id, cell), and whether they hold all of it."""
    from .spatial_join import cell_overlap

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cover.cover(cover.Polygon(r or []), max_cells) for r in _values(b.column("rings"))]
            ids = np.repeat(b.column("polygon_id").to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found) if found else [], pa.int64())], ["right_id", "right_cell"])

    right = polygons.select("polygon_id", "rings").mapInArrow(covered, "right_id long, right_cell long")
    # Cells are tested once, however many targets have them.
    own = cells.select(F.col("cell").alias("left_id"), F.col("cell").alias("left_cell")).filter("left_cell IS NOT NULL").distinct()
    pairs = spread(cell_overlap(own, right).select("left_cell", "right_id").distinct())
    pairs = pairs.join(polygons.select(F.col("polygon_id").alias("right_id"), "rings"), "right_id")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meets, holds = [], []
            for cell, rings in zip(b.column("left_cell").to_pylist(), _values(b.column("rings")), strict=True):
                c = np.array([cell], np.int64)
                a, z = (np.concatenate(x) for x in zip(*((r, np.roll(r, -1, axis=0)) for r in rings if len(r)), strict=True))
                border = (cell_distance.to_edge(np.repeat(c, len(a)), a, z) == 0).any()
                middle = bool(shapes.contains([r for r in rings if len(r) >= 3], grid.center(c))[0])
                meets.append(bool(border or middle))
                holds.append(bool(middle and not border))
            keep = pa.array(meets, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("left_cell").filter(keep), b.column("right_id").filter(keep), pa.array(holds, pa.bool_()).filter(keep)], ["cell", "polygon_id", "contains"])

    found = pairs.select("left_cell", "right_id", "rings").mapInArrow(test, "cell long, polygon_id long, contains boolean")
    return cells.select(F.col("target_id").cast("long").alias("target_id"), "cell").join(found, "cell").select("target_id", "polygon_id", "contains").distinct()
