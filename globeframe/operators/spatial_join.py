"""Spatial joins as equi-joins on cells, refined by exact distance or containment.

One side of each join is exploded to the cells that cover it; the other gives each point
its cell at the same levels.  Spark picks and adapts the join; nothing is broadcast
unchecked and no pair is made but under a common cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import vectors as V
from ..kernels import cover, grid, shapes
from ..kernels import predicates as P
from .lineage import cut, spread

#: The level of joins on discs: the cell is about as wide as the radius.
DEEPEST = 24


def points_array(column) -> np.ndarray:
    """(n, 3) of an Arrow struct column of x, y, z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.stack([column.field(i).to_numpy(zero_copy_only=False) for i in range(3)], -1)


def chain_array(value) -> np.ndarray:
    return shapes.unpack(value.as_py() or []) if value is not None else np.zeros((0, 3))


def level_for(radius: float) -> int:
    return max(0, min(DEEPEST, C.metric_max_level("min_width", radius)))


#: Points of a chunk: a pair of chunks is a row of 16 kB.
CHUNK = 256


def _chunks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """cell, ``name`` (ids) and their coordinates in rows of at most ``CHUNK`` points (key, x, y, z, cell)."""
    kind = rows.schema[key].dataType.simpleString()
    lists = [name, *(f"{name}_{c}" for c in "xyz")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = b.column("cell").to_numpy()
                starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [b.num_rows]])
                cuts = np.unique(np.concatenate([np.arange(u, v, CHUNK) for u, v in zip(starts[:-1], starts[1:], strict=True)]))
                offsets = pa.array(np.append(cuts, b.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cell[cuts]), *(pa.ListArray.from_arrays(offsets, b.column(c)) for c in (key, *"xyz"))], ["cell", *lists])

    sorted_ = spread(rows.select("cell", key, *"xyz").filter("cell IS NOT NULL"), "cell").sortWithinPartitions("cell")
    return sorted_.mapInArrow(run, f"cell long, {name} array<{kind}>, " + ", ".join(f"{c} array<double>" for c in lists[1:]))


def _radius_hits(points: DataFrame, queries: DataFrame, radius: float, pairs: bool) -> DataFrame:
    """query_id, id, chord2 of the pairs within a radius; or query_id alone, once for each chunk of
    points with one.

    Chunks of points and of queries in a cell are joined, so the join has a row for 65,000 pairs;
    the pairs are only told apart in arrays, of which one has 256 times 256 numbers."""
    level = level_for(radius)
    left = _chunks(C.with_cell(points.select("id", "p"), "p", "cell", level).select("id", "p.*", "cell"), "id", "ids")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], -1)
                rows, cells = _arc_cells(q, q, level, radius)
                yield b.take(pa.array(rows, pa.int64())).append_column("cell", pa.array(cells, pa.int64()))

    kind, id_kind = queries.schema["query_id"].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    entered = queries.select("query_id", *(F.col("q")[c].alias(c) for c in "xyz")).filter("x IS NOT NULL")
    right = _chunks(entered.mapInArrow(enter, f"query_id {kind}, x double, y double, z double, cell long"), "query_id", "asked")
    limit = 4 * math.sin(min(radius, math.pi) / 2) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: (b.column(c).offsets.to_numpy(), b.column(c).values) for c in ("ids", "asked")}
            xyz = {c: [b.column(f"{c}_{k}").values.to_numpy() for k in "xyz"] for c in ("ids", "asked")}
            base = {c: [b.column(f"{c}_{k}").offsets[0].as_py() if b.num_rows else 0 for k in "xyz"] for c in ("ids", "asked")}
            who, whom, far, n = [], [], [], 0
            for r in range(b.num_rows):
                (u, v), (s, t) = (at[c][0][r : r + 2] for c in ("ids", "asked"))
                d = 0.0
                for k in range(3):
                    shift = [base[c][k] - at[c][0][0] for c in ("ids", "asked")]
                    e = xyz["ids"][k][u + shift[0] : v + shift[0], None] - xyz["asked"][k][None, s + shift[1] : t + shift[1]]
                    d = d + e * e
                d = np.minimum(d, 4.0)
                if pairs:
                    i, j = np.nonzero(d <= limit)
                    who.append(i + u), far.append(d[i, j])
                else:
                    j = np.flatnonzero((d <= limit).any(0))
                whom.append(j + s)
                n += len(j)
                if n and (n >= 1 << 18 or r == b.num_rows - 1):
                    out = [at["asked"][1].take(pa.array(np.concatenate(whom), pa.int64()))]
                    if pairs:
                        out += [at["ids"][1].take(pa.array(np.concatenate(who), pa.int64())), pa.array(np.concatenate(far))]
                    yield pa.RecordBatch.from_arrays(out, ["query_id", "id", "chord2"][: len(out)])
                    who, whom, far, n = [], [], [], 0

    return left.join(right, "cell").drop("cell").mapInArrow(run, f"query_id {kind}" + (f", id {id_kind}, chord2 double" if pairs else ""))


def radius_candidates(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Pairs of (id, p) and (query_id, q) at most ``radius`` (radians) apart, with their chord."""
    return _radius_hits(points, queries, radius, True)


def radius_join(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """query_id, id, chord2 for pairs within the radius; a point has one cell, so no pair twice."""
    return radius_candidates(points, queries, radius)


def radius_semi(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """The queries with some point within the radius."""
    return queries.join(_radius_hits(points, queries, radius, False).distinct(), "query_id", "left_semi")


def radius_anti(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    return queries.join(_radius_hits(points, queries, radius, False).distinct(), "query_id", "left_anti")


def knn_join(points: DataFrame, queries: DataFrame, k: int, max_distance: float | None = None, first_radius: float | None = None) -> DataFrame:
    """query_id, rank, id, chord2: the k nearest points of each query, ties by id.

    Radius joins with a growing radius; a query is finished once k points lie within it, so
    the result is exact.  Each round's rows are written, so no round is run again.
    ``max_distance`` is exclusive.
    """
    n = points.count()
    if first_radius is None:
        # A disc that holds about 4 k points where they are spread evenly.
        first_radius = math.acos(max(-1.0, 1 - 2 * min(1.0, 4 * k / max(1, n))))
    limit = math.pi if max_distance is None else min(math.pi, max_distance)
    best = Window.partitionBy("query_id").orderBy("chord2", "id")
    radius, todo, out = max(first_radius, 1e-7), queries.select("query_id", "q"), None
    while True:
        last = radius >= limit
        pairs = radius_join(points, todo, min(radius, limit))
        if max_distance is not None and last:
            pairs = pairs.filter(F.col("chord2") < 4 * math.sin(limit / 2) ** 2)
        ranked = cut(pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        full = ranked.filter(F.col("rank") == k).select("query_id")
        part = ranked if last else ranked.join(full, "query_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if last:
            break
        todo = cut(todo.join(full, "query_id", "left_anti"))
        if todo.isEmpty():
            break
        radius *= 3
    return out.select("query_id", "rank", "id", "chord2")


def furthest_points(points: DataFrame, queries: DataFrame, k: int, min_distance: float = 0.0) -> DataFrame:
    """The k furthest points of each query: the nearest of its antipode."""
    turned = queries.select("query_id", V.scale("q", -1.0).alias("q"))
    limit = None if min_distance <= 0 else math.pi - min_distance
    near = knn_join(points, turned, k, limit)
    return near.select("query_id", "rank", "id", (4 - F.col("chord2")).alias("chord2"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, max_cells: int = 32, max_level: int = 18, level_mod: int = 3, id_type: str = "long") -> DataFrame:
    """id, polygon_id: polygons as ``rings`` (array of arrays of points), semi-open borders.

    Cells that lie inside a polygon are sure and skip the exact test; the others are tested
    by parity of crossings.  Rings are fetched by polygon for the pairs that need the test,
    so they do not travel with the cells.
    """
    min_level = max_level % level_mod

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cover.Polygon([shapes.unpack(r) for r in x.as_py() or []]) for x in b.column("rings")]
            cells = [cover.cover(r, max_cells, min_level, max_level, level_mod) for r in found]
            sure = [r.holds(c) if len(c) else np.zeros(0, bool) for r, c in zip(found, cells, strict=True)]
            ids = b.column("polygon_id").take(pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in cells])))
            flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            yield pa.RecordBatch.from_arrays([ids, flat(cells, pa.int64()), flat(sure, pa.bool_())], ["polygon_id", "cell", "sure"])

    covered = polygons.select("polygon_id", "rings").mapInArrow(run, "polygon_id long, cell long, sure boolean")
    levels = list(range(min_level, max_level + 1, level_mod))
    keyed = C.with_cell(points.select("id", "p"), "p", "leaf").withColumn("cell", F.explode(F.array(*(C.parent("leaf", k) for k in levels)))).drop("leaf")
    pairs = keyed.join(covered, "cell").select("id", "polygon_id", "p", "sure")
    # Sure pairs carry no rings.
    rings = polygons.select(F.col("polygon_id").alias("_of"), "rings")
    tested = pairs.join(rings, (F.col("polygon_id") == F.col("_of")) & ~F.col("sure"), "left").select("id", "polygon_id", "p", "sure", "rings")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, inside = b.column("polygon_id").to_numpy(), b.column("sure").to_numpy(zero_copy_only=False).copy()
            p = points_array(b.column("p"))
            for polygon in np.unique(ids[~inside]):
                k = np.flatnonzero((ids == polygon) & ~b.column("sure").to_numpy(zero_copy_only=False))
                inside[k] = shapes.contains([shapes.unpack(r) for r in b.column("rings")[int(k[0])].as_py()], p[k])
            yield b.select(["id", "polygon_id"]).filter(pa.array(inside))

    return tested.mapInArrow(test, f"id {id_type}, polygon_id long")


def _arc_cells(a: np.ndarray, b: np.ndarray, level: int, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Arc by arc the cells of a level that it, or a point within ``margin`` of it, may meet."""
    rows, cells = np.repeat(np.arange(len(a)), 6), np.tile(grid.faces(), len(a))
    for k in range(level + 1):
        few, at = np.unique(cells, return_inverse=True)
        center, reach = grid.cell_bound(few)
        hit = P.segment_distance(center[at], a[rows], b[rows]) <= reach[at] + margin + 1e-15
        rows, cells = rows[hit], cells[hit]
        if k < level:
            rows, cells = np.repeat(rows, 4), grid.children(cells).ravel()
    return rows, cells


def _block_crossings(cell: int, left: tuple, right: tuple, own: bool, least: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Crossings of two sets of arcs (ids, a, b, cells) that share a cell, but for the pairs
    that share a smaller cell too: those are found there."""
    ids, a, b, cells = left
    others, c, d, more = right
    seen = np.unique(np.concatenate([x[x < cell] for x in (*cells, *more)] or [np.zeros(0, np.int64)]))

    def member(lists):
        at = np.zeros((len(lists), len(seen)), np.float32)
        for k, x in enumerate(lists):
            at[k, np.searchsorted(seen, x[x < cell])] = 1
        return at

    first, second = member(cells), member(more)
    n, m = np.cross(a, b), np.cross(c, d)
    for k in range(0, len(ids), rows):
        r = slice(k, k + rows)
        s1, s2, s3, s4 = n[r] @ c.T, n[r] @ d.T, a[r] @ m.T, b[r] @ m.T
        # Signs of products well above the rounding of doubles are certain.
        worst = np.maximum(np.maximum(s1 * s2, s3 * s4), s1 * s3)
        keep = (worst <= 1e-14) & ~(first[r] @ second.T > 0)
        if own:
            keep &= ids[r][:, None] < others[None]
        i, j = np.nonzero(keep)
        open_ = np.flatnonzero(worst[i, j] >= -1e-14)
        kind = np.ones(len(i), np.int8)
        kind[open_] = P.crossing(a[r][i[open_]], b[r][i[open_]], c[j[open_]], d[j[open_]])
        i, j = i[kind >= least], j[kind >= least]
        yield pa.RecordBatch.from_arrays([pa.array(ids[r][i], pa.int64()), pa.array(others[j], pa.int64())], ["left_id", "right_id"])


def crossings_in_order(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of arcs that cross inside both, for one block of i after the other."""
    n = np.cross(a, b)
    k = 0
    while k < len(a):
        # The first arcs of a long chain often cross something: begin with few.
        rows = min(512, max(16, k))
        r = slice(k, k + rows)
        c, d, m = a[k:], b[k:], n[k:]
        s1, s2, s3, s4 = n[r] @ c.T, n[r] @ d.T, a[r] @ m.T, b[r] @ m.T
        worst = np.maximum(np.maximum(s1 * s2, s3 * s4), s1 * s3)
        i, j = np.nonzero(np.triu(worst <= 1e-14, 1))
        open_ = np.flatnonzero(worst[i, j] >= -1e-14)
        kind = np.ones(len(i), np.int8)
        kind[open_] = P.crossing(a[r][i[open_]], b[r][i[open_]], c[j[open_]], d[j[open_]])
        yield i[kind > 0] + k, j[kind > 0] + k
        k += rows


def crossing_pairs(left: DataFrame, right: DataFrame | None = None, level: int = 6, touching: bool = False) -> DataFrame:
    """left_id, right_id of arcs (id, a, b) that cross; within one set each pair once.

    Arcs are entered under all cells of a level that they may meet, and those of a cell are
    compared there.  ``touching`` counts shared end points too.
    """
    own = right is None
    point = left.schema["a"].dataType.simpleString()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, cells = _arc_cells(points_array(b.column("a")), points_array(b.column("b")), level)
            found = np.split(cells, np.cumsum(np.bincount(rows, minlength=b.num_rows))[:-1])
            taken = b.append_column("cells", pa.array(found, pa.list_(pa.int64()))).take(pa.array(rows, pa.int64()))
            yield taken.append_column("cell", pa.array(cells, pa.int64()))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        side = t.column("side").to_numpy()

        def arcs(k: int):
            x = t.filter(pa.array(side == k)).combine_chunks()
            return x.column("id").to_numpy(), points_array(x.column("a")), points_array(x.column("b")), [np.array(v) for v in x.column("cells").to_pylist()]

        yield from _block_crossings(t.column("cell")[0].as_py(), arcs(0), arcs(0 if own else 1), own, 0 if touching else 1)

    rows = left.select("id", "a", "b", F.lit(0).alias("side"))
    if not own:
        rows = rows.unionByName(right.select("id", "a", "b", F.lit(1).alias("side")))
    entered = rows.filter("id IS NOT NULL").mapInArrow(enter, f"id long, a {point}, b {point}, side int, cells array<long>, cell long")
    return entered.groupBy("cell").applyInArrow(test, "left_id long, right_id long")


def _tile_counts(left: tuple, right: tuple, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each arc of a set (ids, a, b): how many of another set, of larger ids or the same set, cross it
    and have a larger id, and the sum of their ids."""
    (ids, a, b), (others, c, d) = left, right
    own = left is right
    n, m = np.cross(a, b), np.cross(c, d)
    to = [np.ascontiguousarray(v.T) for v in (c, -d, -m, m)]
    # Sums of ids as doubles are whole while they are under 2**53: ids go in two parts.
    parts = np.stack([np.ones(len(others)), others & 0xFFFFFF, others >> 24], -1).astype(float)
    sums = np.zeros((len(ids), 3))
    open_i, open_j = [], []
    eps = 1e-14
    for k in range(0, len(ids), tile):
        r = slice(k, k + tile)
        sides = (n[r], n[r], a[r], b[r])
        # Tiles stay in the processor's cache.
        for e in range(0, len(others), tile):
            t = slice(e, e + tile)
            # Both ends of either arc lie on different sides of the other, turned to one sign.
            s = [x @ y[:, t] for x, y in zip(sides, to, strict=True)]
            low, high = np.minimum(s[0], s[1]), np.maximum(s[0], s[1])
            for v in s[2:]:
                np.minimum(low, v, out=low)
                np.maximum(high, v, out=high)
            hit = (low > eps) | (high < -eps)
            # A sign within rounding decides where no two other signs are sure to differ.
            near = (low > -eps) & (low <= eps) | (high < eps) & (high >= -eps)
            if own:
                later = ids[r, None] < others[None, t]
                hit &= later
                near &= later
            if near.any():
                i, j = np.nonzero(near)
                open_i.append(i + k), open_j.append(j + e)
            sums[r] += hit.astype(float) @ parts[t]
    if open_i:
        i, j = np.concatenate(open_i), np.concatenate(open_j)
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            cross = P.crossing(a[x], b[x], c[y], d[y]) > 0
            np.add.at(sums, x[cross], parts[y[cross]])
    whole = sums.astype(np.int64)
    return whole[:, 0], whole[:, 1] + (whole[:, 2] << 24)


def crossing_counts(arcs: DataFrame, block: int = 1 << 13) -> DataFrame:
    """left_id, n, right_ids: for each arc (id, a, b) that crosses arcs of larger ids, their number and
    the sum of their ids.

    Arcs that are long against any cell meet most others' cells, so all pairs are compared, each
    once: blocks of arcs in the order of ids, a group for each pair of blocks.  The work is that
    of all pairs; no pair becomes a row, and a task holds two blocks."""
    own = cut(arcs.select("id", *(F.col(e)[c].alias(f"{e}{c}") for e in "ab" for c in "xyz")).filter("id IS NOT NULL AND ax IS NOT NULL AND bx IS NOT NULL"))
    # Where the cuts fall changes the blocks' sizes, not what is counted.
    blocks = max(1, -(-own.count() // block))
    cuts = sorted({int(v) for v in own.approxQuantile("id", [k / blocks for k in range(1, blocks)], 0.1 / blocks)}) if blocks > 1 else []
    sent = np.array(cuts, np.int64)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = np.arange(len(sent) + 1)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                mine = np.repeat(np.searchsorted(sent, b.column("id").to_numpy(), "right"), len(others))
                other = np.tile(others, b.num_rows)
                out = b.take(pa.array(np.repeat(np.arange(b.num_rows), len(others))))
                for name, v in (("block", mine), ("x", np.minimum(mine, other)), ("y", np.maximum(mine, other))):
                    out = out.append_column(f"_{name}", pa.array(v, pa.int64()))
                yield out

    def count(t: pa.Table) -> pa.Table:
        which, x, y = t.column("_block").to_numpy(), t.column("_x")[0].as_py(), t.column("_y")[0].as_py()

        def side(k: int):
            s = t.filter(pa.array(which == k))
            return s.column("id").to_numpy(), *(np.stack([s.column(f"{e}{c}").to_numpy() for c in "xyz"], -1) for e in "ab")

        left = side(x)
        n, ids = _tile_counts(left, left if x == y else side(y))
        out = pa.table([pa.array(v, pa.int64()) for v in (left[0], n, ids)], ["left_id", "n", "right_ids"])
        return out.filter(pa.array(n > 0))

    met = own.mapInArrow(enter, schema + ", _block long, _x long, _y long")
    each = spread(met, "_x", "_y").groupBy("_x", "_y").applyInArrow(count, "left_id long, n long, right_ids long")
    return each.groupBy("left_id").agg(F.sum("n").alias("n"), F.sum("right_ids").alias("right_ids"))


def closest_edges(edges: DataFrame, queries: DataFrame, k: int, radius: float) -> DataFrame:
    """query_id, rank, id, radians: the k nearest arcs within a radius of each query."""
    level = level_for(radius)

    point = edges.schema["a"].dataType.simpleString()

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, cells = _arc_cells(points_array(b.column("a")), points_array(b.column("b")), level, radius)
                yield b.take(pa.array(rows, pa.int64())).append_column("cell", pa.array(cells, pa.int64()))

    covered = edges.select("id", "a", "b").mapInArrow(enter, f"id long, a {point}, b {point}, cell long")
    asked = C.with_cell(queries.select("query_id", "q"), "q", "cell", level)
    pairs = covered.join(asked, "cell").withColumn("radians", V.segment_distance("q", "a", "b")).filter(F.col("radians") <= radius)
    best = Window.partitionBy("query_id").orderBy("radians", "id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "radians")


def cell_overlap(left: DataFrame, right: DataFrame, min_level: int = 0, max_level: int = 30) -> DataFrame:
    """left_id, left_cell, right_id, right_cell of cells where one lies within the other.

    A cell is entered under itself and marked, and under its ancestors unmarked: two cells
    overlap exactly if one's own entry meets an entry of the other.
    """
    up = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(min_level), F.greatest(F.lit(min_level), C.level(c))), lambda k: C.parent(c, k)))
    a_up = left.select("left_id", "left_cell", F.explode(up("left_cell")).alias("cell"))
    b_own = right.select("right_id", "right_cell", F.col("right_cell").alias("cell"))
    inside = a_up.join(b_own, "cell").select("left_id", "left_cell", "right_id", "right_cell")
    b_up = right.select("right_id", "right_cell", F.explode(up("right_cell")).alias("cell")).filter("cell <> right_cell")
    a_own = left.select("left_id", "left_cell", F.col("left_cell").alias("cell"))
    around = b_up.join(a_own, "cell").select("left_id", "left_cell", "right_id", "right_cell")
    return inside.unionAll(around)
