"""Chains of vertices on arrays: loops, polygons, polylines.  A ring has its inside on the
left; a polygon is a list of rings, a point being inside if the parity of crossings says so."""

from __future__ import annotations

import numpy as np

from . import grid
from . import predicates as P

ORIGIN = np.array([-0.00999946643502502, 0.002592454260932412, 0.999946643502502])


def unpack(chain) -> np.ndarray:
    """(n, 3) from a list of x, y, z triples or structs."""
    if isinstance(chain, np.ndarray):
        return chain
    if len(chain) and isinstance(chain[0], dict):
        return np.array([(p["x"], p["y"], p["z"]) for p in chain])
    return np.asarray(chain, float).reshape(-1, 3)


def angle(a, b):
    return 2 * np.arctan2(np.linalg.norm(a - b, axis=-1), np.linalg.norm(a + b, axis=-1))


def edges(ring: np.ndarray):
    return ring, np.roll(ring, -1, axis=0)


def origin_inside(ring: np.ndarray) -> bool:
    """Whether the far reference point is inside: decided at the ring's second vertex."""
    if len(ring) < 3:
        return False
    ref = P.reference_dir(ring[1:2])[0]
    want = not bool(P.ordered_ccw(ref, ring[2 % len(ring)], ring[0], ring[1]))
    a, b = edges(ring)
    odd = bool(P.edge_or_vertex_crossing(ORIGIN[None], ring[1][None], a, b).sum() % 2)
    return want != odd


def ring_contains(ring: np.ndarray, points: np.ndarray, origin: bool | None = None) -> np.ndarray:
    """Points inside a ring; a boundary point belongs to one of two rings that share it."""
    if len(ring) < 3:
        return np.zeros(len(points), bool)
    inside = origin_inside(ring) if origin is None else origin
    a, b = edges(ring)
    out = np.empty(len(points), bool)
    step = max(1, 200_000 // len(ring))
    for s in range(0, len(points), step):
        p = points[s : s + step]
        out[s : s + step] = (P.edge_or_vertex_crossing(ORIGIN[None, None], p[:, None], a[None], b[None]).sum(1) % 2 == 1) != inside
    return out


def contains(rings: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Points inside a polygon: what lies left of its rings, holes running the other way round; of
    rings that all run counterclockwise, those in an odd number of them."""
    rings = [r for r in rings if len(r) >= 3]
    out = np.zeros(len(points), bool)
    for r in rings:
        out ^= ring_contains(r, points)
    # Left of the first ring's first side is inside; that settles which parity is.
    if len(rings) > 1:
        mid = grid.unit(rings[0][:1] + rings[0][1:2])
        out ^= bool(sum(bool(ring_contains(r, mid)[0]) for r in rings[1:]) % 2)
    return out


def signed_area(ring: np.ndarray) -> float:
    """Area on the left of a ring, in (-2 pi, 2 pi]: negative beyond a hemisphere."""
    if len(ring) < 3:
        return 0.0
    o = ring[0]
    b, c = ring[1:-1], ring[2:]
    num = (o * np.cross(b - o, c - o)).sum(-1)
    den = 1 + b @ o + c @ o + (b * c).sum(-1)
    total = float((2 * np.arctan2(num, den)).sum())
    return float(np.remainder(total + 2 * np.pi, 4 * np.pi) - 2 * np.pi)


def area(rings: list[np.ndarray]) -> float:
    """Of a polygon whose holes are rings of the other direction."""
    total = sum(signed_area(r) for r in rings)
    return total if total >= 0 else total + 4 * np.pi


def curvature(ring: np.ndarray) -> float:
    """Sum of the exterior angles: 2 pi less the area."""
    a, b, c = np.roll(ring, 1, axis=0), ring, np.roll(ring, -1, axis=0)
    u, v = np.cross(a - b, a + b), np.cross(b - c, b + c)
    turn = np.arctan2(np.linalg.norm(np.cross(u, v), axis=-1), (u * v).sum(-1))
    return float((turn * P.orientation(a, b, c)).sum())


def perimeter(ring: np.ndarray) -> float:
    return float(angle(*edges(ring)).sum()) if len(ring) > 1 else 0.0


def length(chain: np.ndarray) -> float:
    return float(angle(chain[:-1], chain[1:]).sum()) if len(chain) > 1 else 0.0


def centroid(ring: np.ndarray) -> np.ndarray:
    """Integral of position over a ring's area: half the sum of the sides' normals by length."""
    a, b = edges(ring)
    n = np.cross(a, b)
    size = np.linalg.norm(n, axis=-1, keepdims=True)
    with np.errstate(all="ignore"):
        part = np.where(size > 0, n / size * angle(a, b)[:, None], 0)
    return part.sum(0) / 2


def chain_centroid(chain: np.ndarray) -> np.ndarray:
    a, b = chain[:-1], chain[1:]
    s, d = np.linalg.norm(a + b, axis=-1, keepdims=True), np.linalg.norm(a - b, axis=-1, keepdims=True)
    return np.where(s > 0, (a + b) * d / np.maximum(s, 1e-300), 0).sum(0)


def is_normalized(ring: np.ndarray) -> bool:
    """At most a hemisphere."""
    return curvature(ring) >= -1e-14


def canonical(ring: np.ndarray) -> np.ndarray:
    """The rotation that starts at the least vertex."""
    k = min(range(len(ring)), key=lambda i: tuple(ring[i]))
    return np.roll(ring, -k, axis=0)


def regular(center: np.ndarray, radius: float, n: int) -> np.ndarray:
    """A regular ring of n vertices about a unit vector."""
    z = center / np.linalg.norm(center)
    x = P.reference_dir(z[None])[0]
    y = np.cross(z, x)
    t = 2 * np.pi * np.arange(n) / n
    return grid.unit(np.cos(radius) * z + np.sin(radius) * (np.cos(t)[:, None] * x + np.sin(t)[:, None] * y))


def fractal(center: np.ndarray, radius: float, levels: int, dimension: float = np.log(4) / np.log(3)) -> np.ndarray:
    """A snowflake-like ring: every side of a triangle is bent ``levels`` times."""
    share = 4.0 ** (-1 / dimension)
    bump = np.sqrt(max(0.0, share * share - (0.5 - share) ** 2))
    xy = np.array([[np.cos(t), np.sin(t)] for t in 2 * np.pi * np.arange(3) / 3])
    for _ in range(levels):
        a, b = xy, np.roll(xy, -1, axis=0)
        d = b - a
        out = np.stack([a, a + share * d, (a + b) / 2 + bump * np.stack([d[:, 1], -d[:, 0]], 1), b - share * d], 1)
        xy = out.reshape(-1, 2)
    z = center / np.linalg.norm(center)
    x = P.reference_dir(z[None])[0]
    return grid.unit(z + np.tan(radius) * (xy[:, :1] * x + xy[:, 1:] * np.cross(z, x)))


def interpolate(chain: np.ndarray, fraction: float) -> tuple[np.ndarray, int]:
    """The point at a share of the length, and the index of the vertex after it."""
    if fraction <= 0 or len(chain) == 1:
        return chain[0], 1
    d = angle(chain[:-1], chain[1:])
    target = fraction * d.sum()
    for i, step in enumerate(d):
        if target < step:
            a, b = chain[i], chain[i + 1]
            t = np.cross(np.cross(a, b), a)
            p = np.cos(target) * a + np.sin(target) * t / np.linalg.norm(t)
            return p, i + 2 if (p == b).all() else i + 1
        target -= step
    return chain[-1], len(chain)


def project(chain: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, int]:
    """The chain's nearest point, and the index of the vertex after it."""
    if len(chain) == 1:
        return chain[0], 1
    a, b = chain[:-1], chain[1:]
    k = int(P.segment_distance(p[None], a, b).argmin())
    n = np.cross(a[k] - b[k], a[k] + b[k])
    inside = (np.cross(n, a[k]) @ p > 0) and (np.cross(b[k], n) @ p > 0)
    if inside:
        foot = p - n * (n @ p) / (n @ n)
        return foot / np.linalg.norm(foot), k + 1
    first = angle(p, a[k]) <= angle(p, b[k])
    return (a[k], k + 1) if first else (b[k], k + 2)


def uninterpolate(chain: np.ndarray, p: np.ndarray, next_vertex: int) -> float:
    d = angle(chain[:-1], chain[1:])
    total = d.sum()
    return float(min(1.0, (d[: next_vertex - 1].sum() + angle(p, chain[next_vertex - 1])) / total)) if total else 0.0


def is_on_right(chain: np.ndarray, p: np.ndarray) -> bool:
    q, nxt = project(chain, p)
    if (q == chain[nxt - 1]).all() and 1 < nxt < len(chain) + 1 and nxt - 1 < len(chain) - 1:
        return bool(P.ordered_ccw(chain[nxt - 2], p, chain[nxt], chain[nxt - 1]))
    nxt = min(nxt, len(chain) - 1)
    return bool(P.orientation(p, chain[nxt], chain[nxt - 1]) > 0)


def polylines_intersect(a: np.ndarray, b: np.ndarray) -> bool:
    return bool((P.crossing(a[:-1, None], a[1:, None], b[None, :-1], b[None, 1:]) >= 0).any())


def subsample(chain: np.ndarray, tolerance: float) -> list[int]:
    """Indices of a subset of vertices whose chain stays within tolerance of all others.

    From each kept vertex, the farthest next one whose arc passes near those between and
    that is reached by moving away."""
    out, i, n = [], 0, len(chain)
    if n:
        out.append(0)
    while i < n - 1:
        best = i + 1
        for k in range(i + 2, n):
            step = chain[i + 1 : k]
            away = angle(chain[i], chain[k])
            if away > np.pi / 2 or (P.segment_distance(step, chain[i], chain[k]) > tolerance).any() or (np.diff(angle(chain[i], chain[i + 1 : k + 1])) < -tolerance).any():
                break
            best = k
        if (chain[best] != chain[out[-1]]).any() or best == n - 1 and len(out) > 1:
            out.append(best)
        i = best
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counterclockwise; fewer than three as they are.

    Sorted by angle about a point outside and closed by a chain that turns left only.
    Points that fill more than a hemisphere have no convex hull: an empty result."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts
    mid = pts.sum(0)
    if np.linalg.norm(mid) < 1e-12 or (pts @ (mid / np.linalg.norm(mid)) <= 0).any():
        # A single extreme direction may still see all of them.
        for axis in (*np.eye(3), *-np.eye(3)):
            if (pts @ axis > 0).all():
                mid = axis
                break
        else:
            return np.zeros((0, 3))
    z = mid / np.linalg.norm(mid)
    x = P.reference_dir(z[None])[0]
    y = np.cross(z, x)
    # Central projection keeps great circles straight, so the order in the plane serves.
    w = pts @ z
    u, v = pts @ x / w, pts @ y / w
    order = np.lexsort((v, u))

    def half(ids):
        chain: list[int] = []
        for k in ids:
            while len(chain) >= 2 and P.orientation(pts[chain[-2]], pts[chain[-1]], pts[k]) <= 0:
                chain.pop()
            chain.append(int(k))
        return chain[:-1]

    ring = half(order) + half(order[::-1])
    return pts[ring]


def dtw_cost(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> float:
    """The cost that ``dtw`` finds, by diagonals: no path, and memory of the chains' length."""
    n, m = len(a), len(b)
    before = last = np.full(n, np.inf)
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        if radius is not None:
            i = i[np.abs(k - i - i * m // n) <= radius]
        best = np.zeros(1)
        if k:
            step = np.concatenate([[np.inf], last])
            best = np.minimum(np.minimum(last[i], step[i]), np.concatenate([[np.inf], before])[i])
        now = np.full(n, np.inf)
        now[i] = best + ((a[i] - b[k - i]) ** 2).sum(-1)
        before, last = last, now
    return float(last[n - 1])


def dtw_costs(left: list[np.ndarray], right: list[np.ndarray], radius: int | None = None) -> np.ndarray:
    """``dtw_cost`` of many pairs, each diagonal for all pairs at once."""
    n, m = (np.array([len(c) for c in x]) for x in (left, right))
    pad = lambda x, size: np.stack([np.concatenate([c, np.full((size - len(c), 3), np.nan)]).T for c in x], -1)
    big_n, big_m = int(n.max()), int(m.max())
    # Axes: coordinate, place, pair; the second chain runs backwards, so a diagonal is a slice.
    a, b = pad(left, big_n), pad(right, big_m)[:, ::-1]
    before = last = np.full((big_n + 1, len(left)), np.inf)
    out = np.full(len(left), np.inf)
    for k in range(big_n + big_m - 1):
        low, high = max(0, k - big_m + 1), min(big_n, k + 1)
        d = a[:, low:high] - b[:, big_m - 1 - k + low : big_m - 1 - k + high]
        d *= d
        cost = d[0] + d[1]
        cost += d[2]
        if k:
            cost += np.minimum(np.minimum(last[low + 1 : high + 1], last[low:high]), before[low:high])
        # Beyond the end of a chain there is nothing; the row before the first stays infinite.
        np.copyto(cost, np.inf, where=np.isnan(cost))
        if radius is not None:
            i = np.arange(low, high)[:, None]
            cost[np.abs(k - i - i * m // n) > radius] = np.inf
        now = np.full((big_n + 1, len(left)), np.inf)
        now[low + 1 : high + 1] = cost
        ends = np.flatnonzero(n + m - 2 == k)
        out[ends] = now[n[ends], ends]
        before, last = last, now
    return out


def dtw(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest monotone alignment by summed squared chords, within a band if asked."""
    n, m = len(a), len(b)
    cost = ((a[:, None] - b[None]) ** 2).sum(-1)
    total = np.full((n, m), np.inf)
    for i in range(n):
        lo, hi = (0, m) if radius is None else (max(0, i * m // n - radius), min(m, i * m // n + radius + 1))
        for j in range(lo, hi):
            if i == 0 and j == 0:
                best = 0.0
            else:
                best = min(total[i - 1, j - 1] if i and j else np.inf, total[i - 1, j] if i else np.inf, total[i, j - 1] if j else np.inf)
            total[i, j] = best + cost[i, j]
    path, i, j = [], n - 1, m - 1
    while True:
        path.append((i, j))
        if i == 0 and j == 0:
            break
        steps = [(total[p, q], (p, q)) for p, q in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p >= 0 and q >= 0]
        i, j = min(steps, key=lambda s: s[0])[1]
    return float(total[-1, -1]), path[::-1]


def consensus(chains: list[np.ndarray], rounds: int = 5) -> np.ndarray:
    """A mean chain: starts at the medoid, moves each vertex to the mean of what aligns with it."""
    sums = [sum(dtw(a, b)[0] for b in chains) for a in chains]
    now = chains[int(np.argmin(sums))].copy()
    for _ in range(rounds):
        new = np.zeros_like(now)
        for c in chains:
            for i, j in dtw(now, c)[1]:
                new[i] += c[j]
        new = grid.unit(new)
        if np.allclose(new, now, atol=1e-15):
            break
        now = new
    return now


def tessellate(a: np.ndarray, b: np.ndarray, project, unproject, tolerance: float, start: tuple[float, float] | None = None, period: float | None = None, depth: int = 24) -> list[tuple[float, float]]:
    """Plane points of the arc ab, as many as keep the plane chain within tolerance.

    Where the plane is periodic in x each point is taken within half a period of the one
    before it, the first of ``start``."""

    def beside(q, base):
        return q if period is None or base is None else (q[0] - period * round((q[0] - base[0]) / period), q[1])

    def bend(a, pa, b, pb, left):
        mid = a + b
        mid = mid / np.linalg.norm(mid)
        at = lambda t: unproject((pa[0] + (pb[0] - pa[0]) * t, pa[1] + (pb[1] - pa[1]) * t))
        off = max(float(angle(mid, at(0.5))), *(float(P.segment_distance(at(t), a, b)) for t in (0.25, 0.75)))
        if not left or off <= tolerance:
            return [pb]
        first = bend(a, pa, mid, beside(project(mid), pa), left - 1)
        return first + bend(mid, first[-1], b, beside(pb, first[-1]), left - 1)

    pa = beside(project(a), start)
    return [pa, *bend(a, pa, b, beside(project(b), pa), depth)]


def tessellate_chains(chains: list[np.ndarray], project, unproject, tolerance: float, period: float | None = None, depth: int = 24) -> list[np.ndarray]:
    """``tessellate`` of all arcs of many chains, halving all open arcs at once: (n, 2) for each chain.

    Whether an arc is halved hangs on its plane ends' difference alone, so x is set beside the
    point before only at the end; a place on an arc is a binary fraction and orders its points."""
    turn = (lambda x: x - period * np.rint(x / period)) if period else (lambda x: x)
    sizes = np.array([len(c) for c in chains])
    if not sizes.sum():
        return [np.zeros((0, 2)) for _ in chains]
    points = np.concatenate([c.reshape(-1, 3) for c in chains])
    plane = np.stack(project(points), -1)
    lone = np.zeros(len(points), bool)
    lone[(np.cumsum(sizes) - 1)[sizes > 0]] = True
    arc = np.flatnonzero(~lone)
    a, b, pa, pb = points[arc], points[arc + 1], plane[arc], plane[arc + 1]
    low, width = np.zeros(len(arc)), np.ones(len(arc))
    # A chain's first vertex comes before its arcs.
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    done = [(first.astype(np.int64), np.zeros(len(first)), plane[first])]
    for left in range(depth, -1, -1):
        if not len(arc):
            break
        mid = a + b
        with np.errstate(all="ignore"):
            mid = mid / np.linalg.norm(mid, axis=-1, keepdims=True)
        dx, dy = turn(pb[:, 0] - pa[:, 0]), pb[:, 1] - pa[:, 1]
        at = lambda t: unproject((pa[:, 0] + dx * t, pa[:, 1] + dy * t))  # noqa: E731,B023
        off = np.maximum(angle(mid, at(0.5)), np.maximum(P.segment_distance(at(0.25), a, b), P.segment_distance(at(0.75), a, b)))
        end = (off <= tolerance) if left else np.ones(len(arc), bool)
        done.append((arc[end], (low + width)[end], pb[end]))
        go = ~end
        pm = np.stack(project(mid[go]), -1)
        a, b, pa, pb = np.concatenate([a[go], mid[go]]), np.concatenate([mid[go], b[go]]), np.concatenate([pa[go], pm]), np.concatenate([pm, pb[go]])
        half = width[go] / 2
        arc, low, width = np.tile(arc[go], 2), np.concatenate([low[go], low[go] + half]), np.tile(half, 2)
    arc, place, xy = (np.concatenate(v) for v in zip(*done, strict=True))
    order = np.lexsort((place, arc))
    of = np.repeat(np.arange(len(chains)), sizes)[arc[order]]
    xy = xy[order].copy()
    parts = np.split(xy, np.searchsorted(of, np.arange(1, len(chains))))
    for part in parts:
        if period and len(part):
            part[:, 0] = part[0, 0] + np.concatenate([[0.0], np.cumsum(turn(np.diff(part[:, 0])))])
    return parts


def hausdorff(target: np.ndarray, source: np.ndarray) -> float:
    """Directed: the largest distance from a vertex of target to the chain source."""
    a, b = (source[:-1], source[1:]) if len(source) > 1 else (source, source)
    return float(P.segment_distance(target[:, None], a[None], b[None]).min(1).max())


# Polygons as lists of rings.


def distance(rings: list[np.ndarray], p: np.ndarray) -> float:
    """From a point to a polygon: 0 inside."""
    return float(distances(rings, p[None])[0])


def distances(rings: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    return np.where(contains(rings, points), 0.0, border_distances(rings, points))


def border_distance(rings: list[np.ndarray], p: np.ndarray) -> float:
    return float(border_distances(rings, p[None])[0])


def border_distances(rings: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    out = np.full(len(points), np.inf)
    for r in rings:
        if len(r):
            a, b = edges(r)
            step = max(1, 200_000 // len(r))
            for s in range(0, len(points), step):
                out[s : s + step] = np.minimum(out[s : s + step], P.segment_distance(points[s : s + step, None], a[None], b[None]).min(1))
    return out


def project_polygon(rings: list[np.ndarray], p: np.ndarray, border: bool = False) -> np.ndarray:
    """A polygon's nearest point to p: p itself inside, unless only the border counts."""
    return project_on_polygon(rings, p[None], border)[0]


def project_on_polygon(rings: list[np.ndarray], points: np.ndarray, border: bool = False) -> np.ndarray:
    """The same for many points."""
    whole = [r for r in rings if len(r)]
    a, b = (np.concatenate(x) for x in zip(*map(edges, whole), strict=True))
    out = np.empty_like(points)
    step = max(1, 200_000 // len(a))
    for s in range(0, len(points), step):
        p = points[s : s + step]
        k = P.segment_distance(p[:, None], a[None], b[None]).argmin(1)
        u, v = a[k], b[k]
        n = np.cross(u - v, u + v)
        inside = ((np.cross(n, u) * p).sum(-1) > 0) & ((np.cross(v, n) * p).sum(-1) > 0)
        with np.errstate(all="ignore"):
            foot = p - n * ((n * p).sum(-1) / (n * n).sum(-1))[:, None]
            foot = foot / np.linalg.norm(foot, axis=-1, keepdims=True)
        ends = np.where((angle(p, u) <= angle(p, v))[:, None], u, v)
        out[s : s + step] = np.where(inside[:, None], foot, ends)
    return out if border else np.where(contains(rings, points)[:, None], points, out)


def smaller_side(ring: np.ndarray) -> np.ndarray:
    """The ring in the direction that has the smaller side of its border on the left."""
    return ring if signed_area(ring) >= 0 else ring[::-1]


def nesting(rings: list[np.ndarray]) -> list[tuple[int, int]]:
    """(parent, depth) of each ring: the smallest ring around it, or -1."""
    small = [smaller_side(r) for r in rings]
    areas = [signed_area(r) for r in small]
    out = []
    for k, r in enumerate(rings):
        around = [j for j in range(len(rings)) if j != k and areas[j] >= areas[k] and bool(ring_contains(small[j], r[:1])[0])]
        out.append((min(around, key=lambda j: areas[j]) if around else -1, len(around)))
    return out


def oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings as shells and holes by how deep they lie in each other."""
    return [smaller_side(r) if depth % 2 == 0 else smaller_side(r)[::-1] for r, (_, depth) in zip(rings, nesting(rings), strict=True)]


def groups(rings: list[np.ndarray]) -> list[list[int]]:
    """The polygons of a set of rings: each shell with the holes just inside it."""
    tree = nesting(rings)
    shells = [k for k, (_, d) in enumerate(tree) if d % 2 == 0]
    return [[k, *(j for j, (up, d) in enumerate(tree) if up == k and d % 2 == 1)] for k in shells]


def compare_border(a: np.ndarray, b: np.ndarray) -> int:
    """1 if ring a holds the border of b, -1 if it keeps it out, 0 if the borders cross."""
    (p, q), (r, s) = edges(a), edges(b)
    if (P.crossing(p[:, None], q[:, None], r[None], s[None]) > 0).any():
        return 0
    inside = ring_contains(a, grid.unit(r + s))
    return 1 if inside.all() else -1 if not inside.any() else 0


def ring_holds(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the region of ring a holds that of ring b."""
    return compare_border(a, b) == 1 and not bool(ring_contains(b, a[:1])[0] and signed_area(b) > signed_area(a))


def rings_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the regions of two rings share a point inside both."""
    return compare_border(a, b) != -1 or bool(ring_contains(b, grid.unit(np.add(*edges(a)))).any())


def border_equal(a: np.ndarray, b: np.ndarray, tolerance: float = 0.0) -> bool:
    """Whether two rings have the same vertices in the same order, from any start, each within a
    distance."""
    return len(a) == len(b) and any((angle(a, np.roll(b, k, axis=0)) <= tolerance).all() for k in range(max(1, len(b))))


def border_near(a: np.ndarray, b: np.ndarray, tolerance: float) -> bool:
    """Whether each vertex of either ring is within a distance of the other's border."""
    one = lambda x, y: P.segment_distance(x[:, None], y[None], np.roll(y, -1, axis=0)[None]).min(1).max()
    return bool(max(one(a, b), one(b, a)) <= tolerance)


class Window:
    """Directions from a point in which an arc passes within discs and keeps clear of others."""

    def __init__(self, source: np.ndarray):
        self.source = source
        self.x = P.reference_dir(source[None])[0]
        self.y = np.cross(source, self.x)
        self.low, self.high, self.full = 0.0, 0.0, True

    def _towards(self, p: np.ndarray) -> float:
        return float(np.arctan2(p @ self.y, p @ self.x))

    def _half(self, p: np.ndarray, radius: float) -> float:
        """Half the angle that a disc takes up as seen from the source."""
        far = float(angle(self.source, p))
        return np.pi if far <= radius else float(np.arcsin(min(1.0, np.sin(radius) / np.sin(far))))

    def _turn(self, a: float) -> float:
        return float(np.remainder(a - (self.low + self.high) / 2 + np.pi, 2 * np.pi) - np.pi)

    def target(self, p: np.ndarray, radius: float) -> bool:
        """Keeps the directions that pass within the disc; whether any are left."""
        half = self._half(p, radius)
        if half >= np.pi:
            return True
        at = self._towards(p)
        if self.full:
            self.low, self.high, self.full = at - half, at + half, False
            return True
        mid, t = (self.low + self.high) / 2, self._turn(at)
        low, high = max(self.low, mid + t - half), min(self.high, mid + t + half)
        self.low, self.high = low, high
        return low <= high

    def avoid(self, p: np.ndarray, radius: float, on_left: bool) -> bool:
        """Keeps the directions that leave the disc on the asked side."""
        half = self._half(p, radius)
        if half >= np.pi or self.full:
            return half < np.pi
        mid, t = (self.low + self.high) / 2, self._turn(self._towards(p))
        if on_left:
            self.high = min(self.high, mid + t - half)
        else:
            self.low = max(self.low, mid + t + half)
        return self.low <= self.high

    def reaches(self, p: np.ndarray) -> bool:
        """Whether the arc from the source to p is allowed."""
        if self.full:
            return True
        t = self._turn(self._towards(p))
        return abs(t) <= (self.high - self.low) / 2 + 1e-15


def simplify(chain: np.ndarray, tolerance: float) -> list[int]:
    """Indices of a subset of vertices: from each kept one the arc goes on as far as it passes within
    the tolerance of all vertices between, in their order."""
    return simplify_chains([chain], tolerance)[0].tolist()


def simplify_chains(chains: list[np.ndarray], tolerance: float, ahead: int = 8, block: int = 1 << 15) -> list[np.ndarray]:
    """``simplify`` of many chains at once.

    Where an arc goes on to hangs on its first vertex alone, so that is first found for all vertices
    together, as far as the next ``ahead`` ones tell; of the others only those that are kept are
    followed further."""
    sizes = np.array([len(c) for c in chains], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in chains]
    points = np.concatenate([c.reshape(-1, 3) for c in chains])
    last = np.repeat(np.cumsum(sizes) - 1, sizes)
    reached, kept = np.full(len(points), -1), np.zeros(len(points), bool)
    for s in range(0, len(points), block):
        i = np.arange(s, min(s + block, len(points)))
        i = i[i < last[i]]
        reached[i] = _arc_ends(points, i, last[i], tolerance, ahead)
    first = np.cumsum(sizes) - sizes
    at = first[sizes > 0]
    while len(at):
        unknown = []
        while len(at):
            kept[at] = True
            at = at[at < last[at]]
            to = reached[at]
            unknown.append(at[to < 0])
            at = to[to >= 0]
        at = np.concatenate(unknown)
        reached[at] = _arc_ends(points, at, last[at], tolerance)
    k = np.flatnonzero(kept)
    parts = np.split(k, np.searchsorted(k, first[1:]))
    return [part - f for part, f in zip(parts, first, strict=True)]


def _arc_ends(points: np.ndarray, i: np.ndarray, last: np.ndarray, tolerance: float, limit: int | None = None) -> np.ndarray:
    """The vertex up to ``last`` that the arc from each vertex i goes on to in ``simplify``; -1 where
    ``limit`` vertices do not settle it.

    Windows of directions as those of ``Window``, of all arcs at once; the distances of the vertices
    between are taken from the farthest end that a window allows, and of nearer ones if that fails."""
    best, source = i + 1, points[i]
    x = P.reference_dir(source)
    y = np.cross(source, x)
    low, high, far, full = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i)), np.ones(len(i), bool)
    rows, allowed, d, c = np.arange(len(i)), [], 1, 1
    while len(rows) and (limit is None or d <= limit):
        # Some of the next vertices at once where few arcs are left.
        c = max(1, min(2 * c if d > 1 else 1, 4096 // len(rows), 256, limit - d + 1 if limit else 256))
        k = i[rows, None] + np.arange(d, d + c)
        inside = k <= last[rows, None]
        p = points[np.minimum(k, last[rows, None])]
        away = angle(source[rows, None], p)
        towards = np.arctan2((p * y[rows, None]).sum(-1), (p * x[rows, None]).sum(-1))
        with np.errstate(all="ignore"):
            share = np.sin(tolerance) / np.sin(away)
            half = np.where(away <= tolerance, np.pi, np.arcsin(np.where(share < 1, share, 1.0)))
        most = np.fmax.accumulate(np.concatenate([far[rows, None], away], 1), 1)
        goes = inside & ~(away > np.pi / 2) & ~(away < most[:, :-1] - tolerance)
        live, lo, hi, whole = np.ones(len(rows), bool), low[rows], high[rows], full[rows]
        for j in range(c):
            live &= goes[:, j]
            mid = (lo + hi) / 2
            turn = np.remainder(towards[:, j] - mid + np.pi, 2 * np.pi) - np.pi
            ok = live & (whole | (np.abs(turn) <= (hi - lo) / 2 + 1e-15))
            if d + j > 1 and ok.any():
                allowed.append((rows[ok], k[ok, j]))
            h, free = half[:, j], half[:, j] >= np.pi
            # A first disc sets the window, others narrow it; one around the source leaves it as it is.
            under, over = mid + turn - h, mid + turn + h
            under, over = np.where(under > lo, under, lo), np.where(over < hi, over, hi)
            at = towards[:, j]
            lo, hi = np.where(free, lo, np.where(whole, at - h, under)), np.where(free, hi, np.where(whole, at + h, over))
            live &= free | whole | (lo <= hi)
            whole = whole & free
            if not live.any():
                break
        low[rows], high[rows], full[rows], far[rows] = lo, hi, whole, most[:, -1]
        rows, d = rows[live], d + c
    settled = np.ones(len(i), bool)
    settled[rows] = False
    if allowed:
        row, k = (np.concatenate(v) for v in zip(*allowed, strict=True))
        order = np.lexsort((k, row))
        k = k[order]
        start, stop = (np.searchsorted(row[order], np.arange(len(i)), side) for side in ("left", "right"))
        left = np.flatnonzero(settled & (start < stop))
        while len(left):
            stop[left] -= 1
            end = k[stop[left]]
            near = _passes_near(points, i[left], end, tolerance)
            best[left[near]] = end[near]
            left = left[~near]
            left = left[start[left] < stop[left]]
    return np.where(settled, best, -1)


def _passes_near(points: np.ndarray, i: np.ndarray, k: np.ndarray, tolerance: float, block: int = 1 << 15) -> np.ndarray:
    """Whether the arc from each vertex i to k is within the tolerance of all vertices between."""
    out, ends = np.ones(len(i), bool), np.cumsum(k - i - 1)
    for s in range(0, int(ends[-1]) if len(i) else 0, block):
        pair = np.arange(s, min(s + block, ends[-1]))
        arc = np.searchsorted(ends, pair, "right")
        near = P.segment_distance(points[k[arc] - (ends[arc] - pair)], points[i[arc]], points[k[arc]]) <= tolerance
        out[arc[~near]] = False
    return out


def medoid(chains: list[np.ndarray], radius: int | None = None) -> int:
    """The chain with the least summed cost of alignment with all others; the first of equals."""
    sums = np.zeros(len(chains))
    for i, a in enumerate(chains):
        for j in range(i + 1, len(chains)):
            c = dtw_cost(a, chains[j], radius)
            sums[i] += c
            sums[j] += c
    return int(sums.argmin())
