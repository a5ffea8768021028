"""Exact geometric tests on arrays: floating point decides almost all, rationals the rest."""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np

EPS = 2.0**-52
#: Bound on the rounding error of det(a, b, c) for unit vectors.
DET_ERROR = 3.6548 * EPS / 2


def det(a, b, c) -> np.ndarray:
    return (np.cross(a, b) * c).sum(-1)


def _exact_det(a, b, c) -> int:
    fa, fb, fc = ([Fraction(float(x)) for x in v] for v in (a, b, c))
    d = (
        fa[0] * (fb[1] * fc[2] - fb[2] * fc[1])
        - fa[1] * (fb[0] * fc[2] - fb[2] * fc[0])
        + fa[2] * (fb[0] * fc[1] - fb[1] * fc[0])
    )
    return (d > 0) - (d < 0)


def _perturbed(a, b, c) -> int:
    """Sign of a zero determinant after moving each point by its own infinitesimal.

    Sorted points a < b < c get perturbations of falling size, coordinate z before y before
    x, the smallest point moved least; the first non-zero term of the expansion decides.
    """
    pts = [tuple(Fraction(float(x)) for x in v) for v in (a, b, c)]
    order = sorted(range(3), key=lambda k: pts[k])
    flips = 1 if [order[0], order[1], order[2]] in ([0, 1, 2], [1, 2, 0], [2, 0, 1]) else -1
    a, b, c = (pts[k] for k in order)
    # Cofactors in the order in which their infinitesimals shrink.
    terms = [
        b[0] * c[1] - b[1] * c[0],
        b[2] * c[0] - b[0] * c[2],
        b[1] * c[2] - b[2] * c[1],
        c[0] * a[1] - c[1] * a[0],
        c[0],
        -c[1],
        c[2] * a[0] - c[0] * a[2],
        c[2],
        a[0] * b[1] - a[1] * b[0],
        -b[0],
        b[1],
        a[0],
        Fraction(1),
    ]
    first = next(t for t in terms if t != 0)
    return flips * (1 if first > 0 else -1)


def orientation(a, b, c) -> np.ndarray:
    """1 counterclockwise, -1 clockwise, 0 only where two points are equal."""
    a, b, c = np.broadcast_arrays(a, b, c)
    d = det(a, b, c)
    out = np.where(d > DET_ERROR, 1, np.where(d < -DET_ERROR, -1, 0)).astype(np.int8)
    open_ = (out == 0) & (a != b).any(-1) & (b != c).any(-1) & (c != a).any(-1)
    for k in np.argwhere(open_):
        k = tuple(k)
        out[k] = _exact_det(a[k], b[k], c[k]) or _perturbed(a[k], b[k], c[k])
    return out


def ordered_ccw(a, b, c, o) -> np.ndarray:
    """Whether going counterclockwise about o meets a, b, c in this order (b may equal either)."""
    votes = (orientation(b, o, a) >= 0).astype(int) + (orientation(c, o, b) >= 0) + (orientation(a, o, c) > 0)
    return votes >= 2


def crossing(a, b, c, d) -> np.ndarray:
    """Of arcs ab and cd: 1 cross inside both, 0 share an end point, -1 do not."""
    a, b, c, d = np.broadcast_arrays(a, b, c, d)
    shared = (a == c).all(-1) | (a == d).all(-1) | (b == c).all(-1) | (b == d).all(-1)
    degenerate = (a == b).all(-1) | (c == d).all(-1)
    acb, bda = -orientation(a, b, c), orientation(a, b, d)
    cbd, dac = -orientation(c, d, b), orientation(c, d, a)
    inside = (acb == bda) & (bda == cbd) & (cbd == dac) & (acb != 0)
    return np.where(shared & ~degenerate, 0, np.where(inside & ~shared & ~degenerate, 1, -1)).astype(np.int8)


def reference_dir(p) -> np.ndarray:
    """A fixed direction at each point, as functions.vectors.ortho."""
    t = np.broadcast_to(np.array([0.012, 0.0053, 0.00457]), p.shape).copy()
    x, y, z = np.abs(p[..., 0]), np.abs(p[..., 1]), np.abs(p[..., 2])
    axis = np.where((x > y) & (x > z), 0, np.where(~((x > y) & (x > z)) & (y > z), 1, 2))
    np.put_along_axis(t, np.choose(axis, [2, 0, 1])[..., None], 1.0, -1)
    v = np.cross(p, t)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def vertex_crossing(a, b, c, d) -> np.ndarray:
    """Whether arcs that share a vertex count as crossing, so that a vertex of tiling
    polygons belongs to one of them."""
    eq = lambda p, q: (p == q).all(-1)
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape, c.shape, d.shape)[:-1], bool)
    a, b, c, d = np.broadcast_arrays(a, b, c, d)
    done = eq(a, b) | eq(c, d)
    whole = (eq(a, c) & eq(b, d)) | (eq(a, d) & eq(b, c))
    for same, first, at, other in ((eq(a, c), d, a, b), (eq(b, d), c, b, a), (eq(a, d), c, a, b), (eq(b, c), d, b, a)):
        k = same & ~done
        if k.any():
            out[k] = whole[k] | ordered_ccw(reference_dir(at[k]), first[k], other[k], at[k])
        done |= same
    return out


def edge_or_vertex_crossing(a, b, c, d) -> np.ndarray:
    x = crossing(a, b, c, d)
    out = x > 0
    k = x == 0
    if k.any():
        a, b, c, d = np.broadcast_arrays(a, b, c, d)
        out[k] = vertex_crossing(a[k], b[k], c[k], d[k])
    return out


def intersection(a, b, c, d) -> np.ndarray:
    """Unit vector where the crossing arcs ab and cd meet, on the arcs' side."""
    n1, n2 = np.cross(a - b, a + b), np.cross(c - d, c + d)
    x = np.cross(n1, n2)
    x = x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    side = ((a + b) * x).sum(-1) + ((c + d) * x).sum(-1)
    return np.where(side[..., None] < 0, -x, x)


def compare_distances(x, a, b) -> np.ndarray:
    """-1, 0 or 1 as x is nearer to a than to b; ties by rationals, then by the points' order."""
    x, a, b = np.broadcast_arrays(x, a, b)
    d = ((x - a) ** 2).sum(-1) - ((x - b) ** 2).sum(-1)
    out = np.where(d > 32 * EPS, 1, np.where(d < -32 * EPS, -1, 0)).astype(np.int8)
    for k in np.argwhere(out == 0):
        k = tuple(k)
        fx, fa, fb = ([Fraction(float(v)) for v in w[k]] for w in (x, a, b))
        dots = [sum(p * q for p, q in zip(fx, f, strict=True)) for f in (fa, fb)]
        norms = [sum(p * p for p in f) for f in (fa, fb)]
        # cos XA - cos XB without roots: compare signed squares.
        left, right = (u * abs(u) / n for u, n in zip(dots, norms, strict=True))
        out[k] = (right > left) - (right < left) or (tuple(b[k]) > tuple(a[k])) - (tuple(b[k]) < tuple(a[k]))
    return out


def segment_distance(x, a, b) -> np.ndarray:
    """Angle from points to arcs."""
    n = np.cross(a - b, a + b)
    size = np.linalg.norm(n, axis=-1)
    ang = lambda p, q: 2 * np.arctan2(np.linalg.norm(p - q, axis=-1), np.linalg.norm(p + q, axis=-1))
    ends = np.minimum(ang(x, a), ang(x, b))
    within = ((np.cross(n, a) * x).sum(-1) > 0) & ((np.cross(b, n) * x).sum(-1) > 0)
    with np.errstate(all="ignore"):
        plane = np.abs(np.arcsin(np.clip((n * x).sum(-1) / size, -1, 1)))
    return np.where((size > 0) & within, np.minimum(plane, ends), ends)


def segment_pair_distance(a, b, c, d) -> np.ndarray:
    """Angle between arcs; 0 where they cross or touch."""
    ends = np.minimum(
        np.minimum(segment_distance(a, c, d), segment_distance(b, c, d)),
        np.minimum(segment_distance(c, a, b), segment_distance(d, a, b)),
    )
    return np.where(crossing(a, b, c, d) >= 0, 0.0, ends)


def wedge_relation(a0, ab1, a2, b0, b2) -> str:
    """How the corner (a0, ab1, a2) lies to (b0, ab1, b2)."""
    eq = lambda p, q: bool((p == q).all())
    ccw = lambda p, q, r: bool(ordered_ccw(p, q, r, ab1))
    if eq(a0, b0) and eq(a2, b2):
        return "equals"
    if ccw(a0, a2, b2):
        if ccw(b2, b0, a0):
            return "properly_contains"
        return "is_properly_contained" if eq(a2, b2) else "properly_overlaps"
    if ccw(a0, b0, b2):
        return "is_properly_contained"
    return "is_disjoint" if ccw(a0, b0, a2) else "properly_overlaps"


def wedge_contains(a0, ab1, a2, b0, b2) -> bool:
    return bool(ordered_ccw(a2, b2, b0, ab1) & ordered_ccw(b0, a0, a2, ab1))


def wedge_intersects(a0, ab1, a2, b0, b2) -> bool:
    return not bool(ordered_ccw(a0, b2, b0, ab1) & ordered_ccw(b0, a2, a0, ab1))


# Exact comparisons: doubles decide where they can, rationals the rest.


def _exact(p) -> list[Fraction]:
    return [Fraction(float(v)) for v in p]


def _dot(a, b) -> Fraction:
    return sum(x * y for x, y in zip(a, b, strict=True))


def _cross(a, b) -> list[Fraction]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _sign(x) -> int:
    return (x > 0) - (x < 0)


def _settled(value: np.ndarray, error: float, exact) -> np.ndarray:
    out = np.where(value > error, 1, np.where(value < -error, -1, 0)).astype(np.int8)
    for k in np.argwhere(out == 0):
        out[tuple(k)] = exact(tuple(k))
    return out


def sign_dot(a, b) -> np.ndarray:
    """Sign of a.b."""
    a, b = np.broadcast_arrays(a, b)
    return _settled((a * b).sum(-1), 4 * EPS, lambda k: _sign(_dot(_exact(a[k]), _exact(b[k]))))


def compare_distance(x, y, chord2) -> np.ndarray:
    """-1, 0 or 1 as the angle between the directions x and y is below, at or above that of a squared
    chord."""
    x, y = np.broadcast_arrays(x, y)
    limit = np.broadcast_to(np.asarray(chord2, float), x.shape[:-1])

    def exact(k):
        p, q, c = _exact(x[k]), _exact(y[k]), 1 - Fraction(float(limit[k])) / 2
        # cos = dot / (|x| |y|) against c: signed squares, so without roots.
        dot = _dot(p, q)
        left, right = dot * abs(dot), c * abs(c) * _dot(p, p) * _dot(q, q)
        return _sign(right - left)

    return _settled(((x - y) ** 2).sum(-1) - limit, 32 * EPS, exact)


def compare_edge_distance(x, a, b, chord2) -> np.ndarray:
    """The same for the distance of x to the arc ab."""
    x, a, b = np.broadcast_arrays(x, a, b)
    limit = np.broadcast_to(np.asarray(chord2, float), x.shape[:-1])
    n = np.cross(a - b, a + b)
    within = (sign_dot(np.cross(n, a), x) > 0) & (sign_dot(np.cross(b, n), x) > 0)
    ends = np.minimum(compare_distance(x, a, limit), compare_distance(x, b, limit))
    sin2 = limit * (1 - limit / 4)
    with np.errstate(all="ignore"):
        value = (n * x).sum(-1) ** 2 / (n * n).sum(-1) - sin2

    def exact(k):
        p, q, r = _exact(x[k]), _exact(a[k]), _exact(b[k])
        m, c = _cross(q, r), Fraction(float(limit[k]))
        return _sign(_dot(m, p) ** 2 - c * (1 - c / 4) * _dot(m, m) * _dot(p, p))

    line = np.where(limit >= 2, -1, _settled(np.where(within, value, 1.0), 64 * EPS, exact))
    return np.where(within, np.minimum(line, ends), ends).astype(np.int8)


def compare_edge_pair_distance(a, b, c, d, chord2) -> np.ndarray:
    """The same for the distance of two arcs; touching and crossing ones are at distance 0."""
    limit = np.asarray(chord2, float)
    near = np.minimum(np.minimum(compare_edge_distance(a, c, d, limit), compare_edge_distance(b, c, d, limit)), np.minimum(compare_edge_distance(c, a, b, limit), compare_edge_distance(d, a, b, limit)))
    return np.where(crossing(a, b, c, d) >= 0, -np.sign(limit), near).astype(np.int8)


def compare_edge_directions(a, b, c, d) -> np.ndarray:
    """Sign of the cosine between the directions of travel of two arcs: 1 the same way, -1 against."""
    a, b, c, d = np.broadcast_arrays(a, b, c, d)
    value = (np.cross(a - b, a + b) * np.cross(c - d, c + d)).sum(-1)
    return _settled(value, 64 * EPS, lambda k: _sign(_dot(_cross(_exact(a[k]), _exact(b[k])), _cross(_exact(c[k]), _exact(d[k])))))


def circle_edge_sign(a, b, n, x) -> np.ndarray:
    """On which side of the great circle across from x the circles ab and across from n meet: the sign
    of ((a x b) x n).x."""
    a, b, n, x = np.broadcast_arrays(a, b, n, x)
    value = (n * a).sum(-1) * (x * b).sum(-1) - (n * b).sum(-1) * (x * a).sum(-1)

    def exact(k):
        p, q, m, y = (_exact(v[k]) for v in (a, b, n, x))
        return _sign(_dot(m, p) * _dot(y, q) - _dot(m, q) * _dot(y, p))

    return _settled(value, 16 * EPS, exact)


def circle_edge_order(a, b, c, d, m, n) -> np.ndarray:
    """-1, 0 or 1 as arc ab meets the great circle across from m nearer to that across from n than arc
    cd does, equally far, or farther."""
    a, b, c, d, m, n = np.broadcast_arrays(a, b, c, d, m, n)
    far = lambda p, q: np.cross(np.cross(p, q), m)
    with np.errstate(all="ignore"):
        share = [(u * n).sum(-1) ** 2 / (u * u).sum(-1) for u in (far(a, b), far(c, d))]

    def exact(k):
        sides = []
        for p, q in ((a[k], b[k]), (c[k], d[k])):
            u = _cross(_cross(_exact(p), _exact(q)), _exact(m[k]))
            sides.append((_dot(u, _exact(n[k])) ** 2, _dot(u, u)))
        (s, t), (v, w) = sides
        return _sign(s * w - v * t)

    return _settled(np.nan_to_num(share[0] - share[1]), 1e-12, exact)


def edge_circumcenter_sign(x0, x1, a, b, c) -> np.ndarray:
    """On which side of the arc x0 x1 the centre of the circle through a, b and c lies: 1 left, -1
    right, 0 on it or for two equal points.

    Directions count, not lengths: what doubles leave open is worked out with unit vectors of
    100 digits, and less than 1e-60 is on the arc."""
    x0, x1, a, b, c = np.broadcast_arrays(x0, x1, a, b, c)
    turn = orientation(a, b, c)
    value = (np.cross(x0 - x1, x0 + x1) * np.cross(b - a, c - a)).sum(-1) * turn

    def exact(k):
        with localcontext() as context:
            context.prec = 100
            one = lambda p: [Decimal(float(v)) for v in p]
            unit = lambda p: [v / _dot(p, p).sqrt() for v in p]
            p, q, r = (unit(one(v[k])) for v in (a, b, c))
            less = lambda u, v: [i - j for i, j in zip(u, v, strict=True)]
            got = _dot(_cross(one(x0[k]), one(x1[k])), _cross(less(q, p), less(r, p))) * int(turn[k])
            return 0 if abs(got) < Decimal("1e-60") else _sign(got)

    out = _settled(value, 128 * EPS, exact)
    return np.where(turn == 0, 0, out).astype(np.int8)


#: Which of two sites an edge does not need.
NEITHER, FIRST, SECOND = 0, 1, 2


def site_exclusion(a, b, x0, x1, radius: float) -> np.ndarray:
    """Of two sites within a radius of the edge x0 x1, a nearer to x0: the one whose stretch of the edge
    within the radius lies inside the other's (FIRST, SECOND), or NEITHER.  In doubles."""
    a, b, x0, x1 = np.broadcast_arrays(a, b, x0, x1)
    n = robust_cross(x0, x1)
    side = np.cross(n, x0)

    def stretch(s):
        off = np.clip((s * n).sum(-1), -1, 1)
        at = np.arctan2((s * side).sum(-1), (s * x0).sum(-1))
        half = np.arccos(np.clip(np.cos(radius) / np.sqrt(1 - off * off), -1, 1))
        return at - half, at + half

    (low_a, high_a), (low_b, high_b) = stretch(a), stretch(b)
    first, second = (low_a >= low_b) & (high_a <= high_b), (low_b >= low_a) & (high_b <= high_a)
    nearer = compare_distances(x1, a, b) < 0
    return np.where(nearer | second, SECOND, np.where(first, FIRST, NEITHER)).astype(np.int8)


def robust_cross(a, b) -> np.ndarray:
    """A unit vector across from a and b, never zero: exact, or from a point beside b, where the two
    are parallel in doubles."""
    a, b = np.broadcast_arrays(a, b)
    out = np.cross(a - b, a + b)
    size = np.linalg.norm(out, axis=-1)
    for k in np.argwhere(size < 1e-15):
        k = tuple(k)
        m = [2 * v for v in _cross(_exact(a[k]), _exact(b[k]))]
        scale = max(map(abs, m))
        out[k] = [float(v / scale) for v in m] if scale else reference_dir(a[k][None])[0]
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


# Clipping in the plane and to a cube face.

#: Each face's normal and the directions in which u and v grow.
FACE_AXES = (
    ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
    ((0, 0, 1), (-1, 0, 0), (0, -1, 0)),
    ((-1, 0, 0), (0, 0, -1), (0, -1, 0)),
    ((0, -1, 0), (0, 0, -1), (1, 0, 0)),
    ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
)


def clip_to_rect(a, b, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the part of each plane segment ab inside a rectangle, and whether there is one)."""
    a, b, low, high = (np.asarray(v, float) for v in (a, b, low, high))
    step = b - a
    with np.errstate(all="ignore"):
        t0, t1 = (low - a) / step, (high - a) / step
        enter = np.where(step == 0, np.where((a >= low) & (a <= high), -np.inf, np.inf), np.minimum(t0, t1)).max(-1)
        leave = np.where(step == 0, np.where((a >= low) & (a <= high), np.inf, -np.inf), np.maximum(t0, t1)).min(-1)
    enter, leave = np.maximum(enter, 0.0), np.minimum(leave, 1.0)
    some = enter <= leave
    first, last = np.where(some, enter, 0.0)[..., None], np.where(some, leave, 0.0)[..., None]
    return a + first * step, a + last * step, some


def clip_to_face(a, b, face: int, padding: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v) of the ends of the part of each arc on a cube face, grown by a padding, and whether there
    is one.

    In homogeneous coordinates the face's four borders are half spaces, as is its front."""
    axes, u_axis, v_axis = (np.array(x) for x in FACE_AXES[face])
    enter, leave = np.zeros(len(a)), np.ones(len(a))
    edge = 1 + padding
    for normal in (axes, axes * edge - u_axis, axes * edge + u_axis, axes * edge - v_axis, axes * edge + v_axis):
        p, q = a @ normal, b @ normal
        with np.errstate(all="ignore"):
            t = p / (p - q)
        enter = np.where((p < 0) & (q >= 0), np.maximum(enter, t), enter)
        leave = np.where((p >= 0) & (q < 0), np.minimum(leave, t), leave)
        enter = np.where((p < 0) & (q < 0), 2.0, enter)
    some = enter <= leave
    first, last = (a + np.where(some, t, 0.0)[:, None] * (b - a) for t in (enter, leave))
    with np.errstate(all="ignore"):
        uv = [np.stack([p @ u_axis / (p @ axes), p @ v_axis / (p @ axes)], -1) for p in (first, last)]
    return uv[0], uv[1], some
