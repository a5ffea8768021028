"""Coverings of regions by cells: whole levels of candidates are tested at once.

A region gives two tests on arrays of cells: ``may_hit`` (false only if the cell is surely
outside) and ``holds`` (true only if it is surely inside).
"""

from __future__ import annotations

import numpy as np

from . import grid, shapes
from . import predicates as P


class Cap:
    def __init__(self, center, radius: float):
        self.center, self.radius = np.asarray(center, float), radius

    def may_hit(self, cells):
        c, r = grid.cell_bound(cells)
        near = shapes.angle(c, self.center) <= self.radius + r
        if not near.any():
            return near
        # Nearer look: the cell's border or inside comes within the radius.
        k = np.flatnonzero(near)
        q = grid.corners(cells[k])
        d = P.segment_distance(self.center, q, np.roll(q, -1, axis=1)).min(1)
        near[k] = (d <= self.radius + 1e-15) | (grid.parent(grid.from_xyz(self.center[None]), grid.level_of(cells[k])) == cells[k])
        return near

    def holds(self, cells):
        # Discs up to a hemisphere are convex.
        if self.radius > np.pi / 2:
            c, r = grid.cell_bound(cells)
            return shapes.angle(c, self.center) + r <= self.radius
        return (shapes.angle(grid.corners(cells), self.center) <= self.radius - 1e-15).all(1)


class Rect:
    """Degrees; lng_lo > lng_hi goes through the date line."""

    def __init__(self, lat_lo, lng_lo, lat_hi, lng_hi):
        self.lat, self.lng = (lat_lo, lat_hi), (lng_lo, lng_hi)
        self.width = (lng_hi - lng_lo) % 360 if lng_hi - lng_lo < 360 else 360.0

    def _box(self, cells):
        """Bounds of each cell: latitudes, and longitudes as middle and half width."""
        c, r = grid.cell_bound(cells)
        lat, lng = grid.xyz_to_latlng(c)
        r = np.degrees(r) + 1e-12
        lo, hi = lat - r, lat + r
        polar = (lo <= -90) | (hi >= 90)
        with np.errstate(all="ignore"):
            half = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(1, np.sin(np.radians(r)) / np.cos(np.radians(lat))))))
        corner_lat, corner_lng = grid.xyz_to_latlng(grid.corners(cells))
        return lo, hi, lng, half, corner_lat, corner_lng

    def may_hit(self, cells):
        lo, hi, lng, half, _, _ = self._box(cells)
        mid = self.lng[0] + self.width / 2
        off = np.abs((lng - mid + 180) % 360 - 180)
        return (hi >= self.lat[0]) & (lo <= self.lat[1]) & (off <= half + self.width / 2)

    def holds(self, cells):
        lo, hi, lng, half, _, _ = self._box(cells)
        mid = self.lng[0] + self.width / 2
        off = np.abs((lng - mid + 180) % 360 - 180)
        return (lo >= self.lat[0]) & (hi <= self.lat[1]) & ((off + half <= self.width / 2) | (self.width >= 360))


class Polygon:
    def __init__(self, rings: list[np.ndarray]):
        self.rings = [r for r in rings if len(r) >= 3]
        self.a = np.concatenate([r for r in self.rings]) if self.rings else np.zeros((0, 3))
        self.b = np.concatenate([np.roll(r, -1, axis=0) for r in self.rings]) if self.rings else np.zeros((0, 3))

    def _border(self, cells):
        """Whether the border may pass through each cell."""
        c, r = grid.cell_bound(cells)
        out = np.zeros(len(cells), bool)
        step = max(1, 100_000 // max(1, len(self.a)))
        for s in range(0, len(cells), step):
            d = P.segment_distance(c[s : s + step, None], self.a[None], self.b[None]).min(1)
            out[s : s + step] = d <= r[s : s + step] + 1e-15
        return out

    def may_hit(self, cells):
        if not len(self.a):
            return np.zeros(len(cells), bool)
        out = self._border(cells)
        rest = ~out
        out[rest] = shapes.contains(self.rings, grid.center(cells[rest]))
        return out

    def holds(self, cells):
        if not len(self.a):
            return np.zeros(len(cells), bool)
        out = ~self._border(cells)
        out[out] = shapes.contains(self.rings, grid.center(cells[out]))
        return out


class Chain:
    """A polyline, with all points within ``radius`` of it."""

    def __init__(self, points: np.ndarray, radius: float = 0.0):
        self.a, self.b = (points[:-1], points[1:]) if len(points) > 1 else (points, points)
        self.radius = radius

    def may_hit(self, cells):
        c, r = grid.cell_bound(cells)
        return P.segment_distance(c[:, None], self.a[None], self.b[None]).min(1) <= r + self.radius + 1e-15

    def holds(self, cells):
        c, r = grid.cell_bound(cells)
        return P.segment_distance(c[:, None], self.a[None], self.b[None]).min(1) + r <= self.radius


class Near:
    """All points within a radius of a polygon, its inside included."""

    def __init__(self, rings: list[np.ndarray], radius: float):
        self.polygon, self.radius = Polygon(rings), radius

    def _far(self, cells):
        c, r = grid.cell_bound(cells)
        if not len(self.polygon.a):
            return np.full(len(cells), np.inf), r
        d = P.segment_distance(c[:, None], self.polygon.a[None], self.polygon.b[None]).min(1)
        return np.where(shapes.contains(self.polygon.rings, c), 0.0, d), r

    def may_hit(self, cells):
        d, r = self._far(cells)
        return d <= self.radius + r + 1e-15

    def holds(self, cells):
        d, r = self._far(cells)
        return d + r <= self.radius


class Point:
    """One point, which no cell lies within."""

    def __init__(self, p):
        self.leaf = int(grid.from_xyz(np.asarray(p, float)[None])[0])

    def may_hit(self, cells):
        return grid.parent(np.array([self.leaf]), grid.level_of(cells)) == cells

    def holds(self, cells):
        return np.zeros(len(cells), bool)


class Any:
    """The union of regions."""

    def __init__(self, regions: list):
        self.regions = regions

    def may_hit(self, cells):
        return np.any([r.may_hit(cells) for r in self.regions], axis=0) if self.regions else np.zeros(len(cells), bool)

    def holds(self, cells):
        return np.any([r.holds(cells) for r in self.regions], axis=0) if self.regions else np.zeros(len(cells), bool)


class All:
    """The intersection of regions; of none, the whole sphere."""

    def __init__(self, regions: list):
        self.regions = regions

    def may_hit(self, cells):
        return np.all([r.may_hit(cells) for r in self.regions], axis=0) if self.regions else np.ones(len(cells), bool)

    def holds(self, cells):
        return np.all([r.holds(cells) for r in self.regions], axis=0) if self.regions else np.ones(len(cells), bool)


class Union:
    def __init__(self, cells: np.ndarray):
        self.cells = grid.normalize(cells)

    def may_hit(self, cells):
        return grid.union_intersects(self.cells, cells)

    def holds(self, cells):
        return grid.union_contains(self.cells, cells)


def cover(region, max_cells: int = 8, min_level: int = 0, max_level: int = 30, level_mod: int = 1, interior: bool = False) -> np.ndarray:
    """Cells that cover the region, or with ``interior`` cells inside it.

    Level by level, the largest unfinished cells are split while the budget allows; cells
    below ``min_level`` are always split, so the budget may be exceeded there.
    """
    top = max_level - (max_level - min_level) % level_mod
    done: list[int] = []
    todo = grid.faces()
    todo = todo[region.may_hit(todo)]
    level = 0
    while len(todo):
        inside = region.holds(todo) if level >= min_level else np.zeros(len(todo), bool)
        if level >= min_level and (level - min_level) % level_mod == 0:
            done += todo[inside].tolist()
            todo = todo[~inside]
        if level >= top:
            if not interior:
                done += todo.tolist()
            break
        step = min_level - level if level < min_level else level_mod - (level - min_level) % level_mod if level > min_level else level_mod
        nxt = todo[:, None]
        for _ in range(step):
            nxt = grid.children(nxt).reshape(len(todo), -1)
        hit = region.may_hit(nxt.ravel()).reshape(nxt.shape)
        fewest = hit.sum(1)
        if level >= min_level:
            # Split those that cost least first; what the budget does not allow stays whole.
            order = np.argsort(fewest, kind="stable")
            room = max_cells - len(done) - len(todo)
            keep = np.cumsum(fewest[order] - 1) > room
            whole = np.zeros(len(todo), bool)
            whole[order[keep]] = True
            if interior:
                whole &= False
                if len(done) >= max_cells or len(todo) > 64 * max_cells:
                    break
            done += todo[whole].tolist()
            nxt, hit = nxt[~whole], hit[~whole]
        todo = nxt[hit]
        level += step
    out = np.array(done, np.int64)
    if interior and len(out) > max_cells:
        out = out[np.argsort(-grid.lsb(out).astype(float), kind="stable")][:max_cells]
    out = grid.normalize(out)
    return grid.denormalize(out, min_level, level_mod) if min_level > 0 or level_mod > 1 else out


def at_level(region, level: int) -> np.ndarray:
    """All cells of one level that may meet the region."""
    todo = grid.faces()
    for _ in range(level):
        todo = grid.children(todo[region.may_hit(todo)]).ravel()
    return todo[region.may_hit(todo)]


def flood_fill(region, start: int) -> list[int]:
    """Cells of start's level, joined by edges to it, that meet the region."""
    seen, todo, out = {start}, [start], []
    while todo:
        now = np.array(todo, np.int64)
        now = now[region.may_hit(now)]
        out += now.tolist()
        todo = []
        for c in grid.edge_neighbors(now).ravel().tolist() if len(now) else []:
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return out


def is_canonical(cells: np.ndarray, max_cells: int = 8, min_level: int = 0, max_level: int = 30, level_mod: int = 1) -> bool:
    """Whether a covering meets the options: sorted, apart, allowed levels, nothing to merge."""
    cells = np.asarray(cells, np.int64)
    if not len(cells):
        return True
    levels = grid.level_of(cells)
    top = max_level - (max_level - min_level) % level_mod
    if (levels < min_level).any() or (levels > top).any() or ((levels - min_level) % level_mod).any():
        return False
    low, high = grid.order_key(grid.range_min(cells)), grid.order_key(grid.range_max(cells))
    if (high[:-1] >= low[1:]).any():
        return False
    up = levels - level_mod
    full = 4**level_mod
    ok = up >= min_level
    parents = np.where(ok, grid.parent(cells, np.maximum(up, 0)), cells)
    _, n = np.unique(np.stack([parents, levels])[:, ok], axis=1, return_counts=True)
    if (n == full).any():
        return False
    if len(cells) > max_cells:
        xor = (cells[:-1] ^ cells[1:]).view(np.uint64)
        same_face = (xor >> np.uint64(61)) == 0
        common = np.where(same_face, (60 - np.floor(np.log2(np.maximum(xor, 1).astype(float)))).astype(int) // 2, -1)
        return not (common >= min_level).any()
    return True


def canonicalize(cells: np.ndarray, max_cells: int = 8, min_level: int = 0, max_level: int = 30, level_mod: int = 1) -> np.ndarray:
    """Cells replaced by ancestors, nearest pairs first, until the options hold."""
    top = max_level - (max_level - min_level) % level_mod
    fit = lambda level: np.where(level > min_level, level - (level - min_level) % level_mod, level)
    now = np.asarray(cells, np.int64)
    levels = np.minimum(grid.level_of(now), top)
    now = grid.denormalize(grid.normalize(grid.parent(now, fit(levels))), min_level, level_mod)
    while len(now) > max_cells:
        xor = (now[:-1] ^ now[1:]).view(np.uint64)
        common = np.where(xor >> np.uint64(61) == 0, (60 - np.floor(np.log2(np.maximum(xor, 1).astype(float)))).astype(int) // 2, -1)
        common = fit(common)
        if common.max() < min_level:
            break
        k = int(common.argmax())
        now = np.append(now[grid.parent(now, np.minimum(common[k], grid.level_of(now))) != grid.parent(now[k], common[k])], grid.parent(now[k], common[k]))
        now = grid.denormalize(grid.normalize(now), min_level, level_mod)
    return now


def cap_bound(center, radius: float) -> np.ndarray:
    """At most four cells that hold a disc: those around its centre's nearest corner, at the
    deepest level whose cells are twice as wide; the six faces for a wide one."""
    level = next((k for k in range(30, -1, -1) if 2 * np.sqrt(2) / 3 * 2.0**-k >= 2 * radius), -1) if radius >= 0 else 0
    if radius < 0:
        return np.zeros(0, np.int64)
    if level < 1:
        return grid.faces()
    leaf = int(grid.from_xyz(np.asarray(center, float)[None])[0])
    return np.sort(grid.vertex_neighbors(leaf, level - 1))


def fast_cover(region, max_level: int = 30, max_cells: int = 8) -> np.ndarray:
    """A quick covering: cells of the deepest level at which few are enough."""
    best = grid.faces()[region.may_hit(grid.faces())]
    while len(best) and grid.level_of(best).max() < max_level:
        finer = grid.children(best).ravel()
        finer = finer[region.may_hit(finer)]
        if len(finer) > max_cells:
            break
        best = finer
    return grid.normalize(best)


def simple_cover(region, start: np.ndarray, level: int) -> np.ndarray:
    """The cells of a level joined by edges to that of a point of the region, that meet it."""
    return np.array(sorted(flood_fill(region, int(grid.from_xyz(np.asarray(start, float)[None], level)[0])), key=lambda x: x & (2**64 - 1)), np.int64)
