"""Snap rounding: edges moved onto sites, cleaned by policies and joined into shapes.

Vertices move to their snapped places; an edge that then passes within the snap radius of
another site is led through it, so that edges which met stay together.  Crossing edges can
be split first.  What comes out is a graph of directed edges between sites, which layers
turn into points, polylines or rings.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np

from . import grid, overlay, shapes
from . import predicates as P


@dataclass(frozen=True)
class Options:
    """``snap`` is none, ("cell", level) or ("degrees", exponent); the policies say what becomes of
    edges without length, of several equal ones, and of pairs in both directions."""

    snap: tuple[str, int] | None = None
    split_crossing: bool = False
    simplify: float = 0.0
    undirected: bool = False
    degenerate: str = "discard"  # discard, keep
    duplicates: str = "merge"  # merge, keep
    siblings: str = "keep"  # keep, discard


def snapped(points: np.ndarray, snap: tuple[str, int] | None) -> np.ndarray:
    if snap is None or not len(points):
        return points
    kind, at = snap
    if kind == "cell":
        return grid.center(grid.from_xyz(points, at))
    if kind == "degrees":
        lat, lng = grid.xyz_to_latlng(points)
        unit = 10.0**at
        return grid.latlng_to_xyz(np.round(lat * unit) / unit, np.round(lng * unit) / unit)
    raise ValueError("snap is cell or degrees")


def snap_radius(snap: tuple[str, int] | None) -> float:
    """How far a vertex may move."""
    if snap is None:
        return 0.0
    kind, at = snap
    return 2.438654594434021 / 2 * 2.0**-at if kind == "cell" else np.radians(np.sqrt(0.5) * 10.0**-at)


class Graph:
    """Sites and directed edges (pairs of their numbers)."""

    def __init__(self, edges: np.ndarray, options: Options):
        """``edges`` is (n, 2, 3); points are edges without length."""
        o = options
        a, b = edges[:, 0], edges[:, 1]
        if o.split_crossing and len(a):
            points = overlay._Points()
            pairs = overlay._pieces(a, b, a, b, points)
            flat = [i for i in range(len(a)) if (a[i] == b[i]).all()]
            a, b = (np.array([points.all[p[k]] for p in pairs] + [x[i] for i in flat]).reshape(-1, 3) for k, x in ((0, a), (1, b)))
        ends = snapped(np.concatenate([a, b]), o.snap)
        self.sites, number = np.unique(ends, axis=0, return_inverse=True) if len(ends) else (np.zeros((0, 3)), np.zeros(0, int))
        number = number.ravel()
        n = len(a)
        out: list[tuple[int, int]] = []
        for i, j, p, q in zip(number[:n].tolist(), number[n:].tolist(), a, b, strict=True):
            out += self._led(i, j, p, q, snap_radius(o.snap))
        if o.degenerate == "discard":
            out = [e for e in out if e[0] != e[1]]
        if o.undirected:
            out = [(min(e), max(e)) for e in out]
        if o.siblings == "discard":
            n_of = Counter(out)
            out = [e for e in n_of for _ in range(max(0, n_of[e] - n_of[e[1], e[0]]) if e[0] != e[1] else n_of[e])]
        if o.duplicates == "merge":
            out = list(dict.fromkeys(out))
        self.edges = out

    def _led(self, i: int, j: int, p: np.ndarray, q: np.ndarray, radius: float) -> list[tuple[int, int]]:
        """The edge from site i to j through the sites that it comes near."""
        if i == j or not radius:
            return [(i, j)]
        near = np.flatnonzero(P.segment_distance(self.sites, p, q) <= radius)
        between = [int(k) for k in near if k not in (i, j) and float(P.segment_distance(self.sites[k], self.sites[i], self.sites[j])) <= radius]
        along = sorted(between, key=lambda k: float(shapes.angle(self.sites[i], self.sites[k])))
        along = [k for k in along if shapes.angle(self.sites[i], self.sites[k]) < shapes.angle(self.sites[i], self.sites[j])]
        path = [i, *along, j]
        return list(zip(path[:-1], path[1:], strict=True))

    def points(self) -> np.ndarray:
        """The sites of edges without length."""
        return self.sites[[i for i, j in self.edges if i == j]]

    def chains(self) -> list[np.ndarray]:
        """Maximal walks: they start where edges do not pass straight through a site."""
        out_of, into = defaultdict(list), Counter(j for i, j in self.edges if i != j)
        for i, j in self.edges:
            if i != j:
                out_of[i].append(j)
        starts = [i for i in list(out_of) for _ in range(len(out_of[i])) if len(out_of[i]) != 1 or into[i] != 1]
        found = []
        for i in [*starts, *list(out_of)]:
            while out_of[i]:
                path = [i]
                while out_of[path[-1]] and (len(path) == 1 or len(out_of[path[-1]]) == 1 and into[path[-1]] == 1):
                    path.append(out_of[path[-1]].pop(0))
                found.append(self.sites[path])
                if i not in starts:
                    break
        return found

    def chain(self) -> np.ndarray:
        """The one walk over all edges; an error if there is none."""
        found = self.chains()
        if len(found) > 1:
            raise ValueError("the edges make several chains")
        return found[0] if found else np.zeros((0, 3))

    def rings(self) -> list[np.ndarray]:
        """Rings with the inside on the left; edges that come back the same way enclose nothing."""
        n_of = Counter(e for e in self.edges if e[0] != e[1])
        kept = [e for e in n_of for _ in range(max(0, n_of[e] - n_of[e[1], e[0]]))]
        return overlay._join(kept, list(self.sites))


def polygon(rings: list[np.ndarray], options: Options) -> list[np.ndarray]:
    """A polygon's rings built anew."""
    if options.simplify:
        rings = [r[[k for k in shapes.simplify(np.concatenate([r, r[:1]]), options.simplify) if k < len(r)]] for r in rings]
    edges = [np.stack(shapes.edges(r), 1) for r in rings if len(r) >= 3]
    return Graph(np.concatenate(edges), options).rings() if edges else []


def polylines(chains: list[np.ndarray], options: Options) -> list[np.ndarray]:
    if options.simplify:
        chains = [c[shapes.simplify(c, options.simplify)] for c in chains]
    edges = [np.stack([c[:-1], c[1:]], 1) for c in chains if len(c) > 1]
    return Graph(np.concatenate(edges), options).chains() if edges else []


def degeneracies(rings: list[np.ndarray]) -> list[tuple[int, int, str]]:
    """(ring, index, kind) of the sides without length and of those that another goes back along."""
    sides = {}
    for k, r in enumerate(rings):
        for i, (p, q) in enumerate(zip(*shapes.edges(r), strict=True)):
            sides.setdefault((tuple(p), tuple(q)), []).append((k, i))
    out = []
    for (p, q), places in sides.items():
        if p == q:
            out += [(*x, "point") for x in places]
        elif (q, p) in sides:
            out += [(*x, "sibling") for x in places]
    return sorted(out)


# Operations on shapes of several dimensions: (points, chains, rings).


def _on_chain(points: np.ndarray, chains: list[np.ndarray]) -> np.ndarray:
    """Points that are a vertex of a chain."""
    ends = {tuple(v) for c in chains for v in c.tolist()}
    return np.array([tuple(p) in ends for p in points.tolist()], bool)


def combine(a: tuple, b: tuple, op: str, polygon_model: str = "semi_open") -> tuple:
    """union, intersection, difference or symmetric_difference of (points, chains, rings).

    A polygon takes in the chains and points inside it, a chain the points at its vertices.
    Points at a polygon's vertices count as inside if it is ``closed``, as outside if ``open``."""
    if op == "symmetric_difference":
        x, y = combine(a, b, "difference", polygon_model), combine(b, a, "difference", polygon_model)
        return combine(x, y, "union", polygon_model)
    (p, c, r), (q, d, s) = a, b

    def within(points, rings):
        hit = shapes.contains(rings, points) if len(points) else np.zeros(0, bool)
        corner = _on_chain(points, rings)
        return hit | corner if polygon_model == "closed" else hit & ~corner if polygon_model == "open" else hit

    def parts(chains, rings, inside):
        return [x for one in chains for x in overlay.chain_parts(one, rings, inside)] if rings else [] if inside else list(chains)

    def equal(points, others):
        known = {tuple(v) for v in others.tolist()}
        return np.array([tuple(v) in known for v in points.tolist()], bool)

    rings = overlay.combine(r, s, op)
    if op == "intersection":
        chains = parts(c, s, True) + parts(d, r, True)
        kept = p[within(p, s) | _on_chain(p, d) | equal(p, q)]
        more = q[(within(q, r) | _on_chain(q, c)) & ~equal(q, p)]
        return np.concatenate([kept, more]), chains, rings
    if op == "difference":
        return p[~(within(p, s) | _on_chain(p, d) | equal(p, q))], parts(c, s, False), rings
    chains = parts(c, s, False) + parts(d, r, False)
    kept = p[~(within(p, s) | _on_chain(p, d))]
    more = q[~(within(q, r) | _on_chain(q, c) | equal(q, p))]
    return np.concatenate([kept, more]), chains, rings


def is_empty(shape: tuple) -> bool:
    return not any(len(x) for x in shape)
