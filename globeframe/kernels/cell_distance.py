"""Distances of cells, of rectangles and bounds of chains, on arrays."""

from __future__ import annotations

import numpy as np

from . import grid
from . import predicates as P


def holds(cells: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether each cell has its point, its border included with a few rounding errors."""
    face, ulo, uhi, vlo, vhi = grid.bound_uv(cells)
    p = np.broadcast_to(points, (len(face), 3))
    main = np.choose(face, [p[:, 0], p[:, 1], p[:, 2], -p[:, 0], -p[:, 1], -p[:, 2]])
    with np.errstate(all="ignore"):
        x, y, z = p[:, 0], p[:, 1], p[:, 2]
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    pad = 5 / 3 * 2.0**-52
    return (main > 0) & (u >= ulo - pad) & (u <= uhi + pad) & (v >= vlo - pad) & (v <= vhi + pad)


def _sides(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = grid.corners(cells)
    return a, np.roll(a, -1, axis=1)


def border_to_point(cells: np.ndarray, p: np.ndarray) -> np.ndarray:
    return P.segment_distance(p[:, None], *_sides(cells)).min(1)


def to_point(cells: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(holds(cells, p), 0.0, border_to_point(cells, p))


def to_edge(cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c, d = _sides(cells)
    near = P.segment_pair_distance(a[:, None], b[:, None], c, d).min(1)
    return np.where(holds(cells, a) | holds(cells, b), 0.0, near)


def to_cell(cells: np.ndarray, others: np.ndarray) -> np.ndarray:
    (a, b), (c, d) = _sides(cells), _sides(others)
    near = P.segment_pair_distance(a[:, :, None], b[:, :, None], c[:, None], d[:, None]).min((1, 2))
    inside = np.zeros(len(near), bool)
    for k in range(4):
        inside |= holds(cells, c[:, k]) | holds(others, a[:, k])
    return np.where(inside, 0.0, near)


def max_to_point(cells: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A corner's distance, or half a turn less the distance of the antipode."""
    corners = grid.corners(cells)
    far = 2 * np.arctan2(np.linalg.norm(corners - p[:, None], axis=-1), np.linalg.norm(corners + p[:, None], axis=-1)).max(1)
    return np.where(far <= np.pi / 2, far, np.pi - to_point(cells, -p))


def max_to_edge(cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = np.maximum(max_to_point(cells, a), max_to_point(cells, b))
    return np.where(far <= np.pi / 2, far, np.pi - to_edge(cells, -a, -b))


def max_to_cell(cells: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Half a turn less the distance to the antipodal region, which has the other's corners turned."""
    (a, b), (c, d) = _sides(cells), _sides(others)
    near = P.segment_pair_distance(a[:, :, None], b[:, :, None], -c[:, None], -d[:, None]).min((1, 2))
    inside = np.zeros(len(near), bool)
    for k in range(4):
        inside |= holds(cells, -c[:, k]) | holds(others, -a[:, k])
    return np.pi - np.where(inside, 0.0, near)


# Rectangles in radians: (lat_lo, lat_hi, lng_lo, lng_hi); lng_lo > lng_hi goes through the date line.


def _points(lat, lng) -> np.ndarray:
    return np.stack([np.cos(lng) * np.cos(lat), np.sin(lng) * np.cos(lat), np.sin(lat)], -1)


def _turn(x):
    """Into [0, 2 pi)."""
    return np.remainder(x, 2 * np.pi)


def _width(r):
    return np.where(r[3] - r[2] >= 2 * np.pi, 2 * np.pi, _turn(r[3] - r[2]))


def _lngs_meet(r, s):
    return (_turn(s[2] - r[2]) <= _width(r)) | (_turn(r[2] - s[2]) <= _width(s))


def rect_distance(r, s) -> np.ndarray:
    """Between rectangles given as four arrays each."""
    gap = np.maximum(0.0, np.maximum(r[0] - s[1], s[0] - r[1]))
    left, right = _turn(r[2] - s[3]), _turn(s[2] - r[3])
    a_lng, b_lng = np.where(left < right, r[2], r[3]), np.where(left < right, s[3], s[2])
    a, b, c, d = _points(r[0], a_lng), _points(r[1], a_lng), _points(s[0], b_lng), _points(s[1], b_lng)
    ends = np.minimum(
        np.minimum(P.segment_distance(a, c, d), P.segment_distance(b, c, d)),
        np.minimum(P.segment_distance(c, a, b), P.segment_distance(d, a, b)),
    )
    return np.where(_lngs_meet(r, s), gap, ends)


def _lng_reach(r, s) -> np.ndarray:
    """The largest turn from a longitude of r to the nearest one of s."""
    w, v = _width(r), _width(s)
    free = 2 * np.pi - v
    # Along the gap of s, from its end: distance rises to the middle of the gap and falls.
    start = _turn(r[2] - s[3])
    inside = np.where(start <= free, start, 0.0)
    stop = np.where(start <= free, start + w, w - (2 * np.pi - start))
    stop = np.minimum(np.maximum(stop, 0.0), free)
    hit = np.minimum(inside, free - inside)
    hit = np.maximum(hit, np.minimum(stop, free - stop))
    hit = np.where((inside <= free / 2) & (stop >= free / 2), free / 2, hit)
    # A range that starts in the gap may come round into it again.
    again = np.maximum(0.0, np.where(start <= free, start + w - 2 * np.pi, -1.0))
    hit = np.maximum(hit, np.minimum(again, free / 2))
    covered = (start > free) & (w <= 2 * np.pi - start)
    return np.where(covered | (v >= 2 * np.pi), 0.0, hit)


def rect_directed_hausdorff(r, s) -> np.ndarray:
    """Over the points of r the largest distance to s.

    It is reached on the meridian of r that is farthest from s, at one of its ends, at the
    equator, where the ends of the meridian of s are equally far, or where the distance to one
    of them is greatest."""
    turn = _lng_reach(r, s)
    c, d = _points(s[0], 0 * turn), _points(s[1], 0 * turn)
    sum_lat = (s[0] + s[1]) / 2
    # Points (lat, turn) equally far from c and d lie on the plane through the middle's pole.
    middle = np.arctan2(np.cos(sum_lat + np.pi / 2) * np.cos(turn) * -1.0, np.sin(sum_lat + np.pi / 2))
    farthest = [np.arctan2(-np.sin(x), -np.cos(x) * np.cos(turn)) for x in (s[0], s[1])]
    best = np.zeros(len(turn))
    for lat in (r[0], r[1], 0 * turn, middle, *farthest):
        inside = (lat >= r[0]) & (lat <= r[1])
        far = P.segment_distance(_points(lat, turn), c, d)
        best = np.where(inside, np.maximum(best, far), best)
    below = np.maximum(0.0, np.maximum(s[0] - r[0], r[1] - s[1]))
    return np.where(turn == 0, below, best)


def rect_expanded(r, distance) -> list[np.ndarray]:
    """A rectangle grown so that it holds all points within a distance of it, or shrunk by a negative
    one so that all points within that distance of its inside lie in the old one.

    What is left of nothing is empty: lat_lo > lat_hi, and the longitudes pi to -pi."""
    lat_lo, lat_hi, lng_lo, lng_hi = (np.asarray(x, float) for x in r)
    d, width = np.broadcast_to(np.asarray(distance, float), lat_lo.shape), _width(r)
    whole = width >= 2 * np.pi
    pole = np.pi / 2
    grow = d >= 0
    low, high = np.maximum(-pole, lat_lo - d), np.minimum(pole, lat_hi + d)
    # A disc about a corner reaches this far in longitude; one over a pole reaches all round.
    with np.errstate(all="ignore"):
        turn = [np.where(np.abs(x) + d >= pole, np.inf, np.arcsin(np.minimum(1, np.sin(d) / np.cos(x)))) for x in (lat_lo, lat_hi)]
        out = np.maximum(*turn)
        in_low, in_high = np.where((lat_lo <= -pole) & whole, -pole, lat_lo - d), np.where((lat_hi >= pole) & whole, pole, lat_hi + d)
        share = np.sin(-d) / np.cos(np.maximum(-in_low, in_high))
        inner = -np.where(share < 1, np.arcsin(np.clip(share, -1, 1)), pole)
    by = np.where(grow, out, inner)
    size = width + 2 * by
    full = whole & (grow | (inner > -pole)) | (size >= 2 * np.pi)
    lat = [np.where(grow, x, y) for x, y in ((low, in_low), (high, in_high))]
    empty = (lat[0] > lat[1]) | (~full & (size < 0))
    with np.errstate(invalid="ignore"):
        west, east = (np.remainder(x + np.pi, 2 * np.pi) - np.pi for x in (lng_lo - by, lng_hi + by))
    lng = [np.where(full, -np.pi, west), np.where(full, np.pi, east)]
    return [np.where(empty, e, v) for e, v in ((1.0, lat[0]), (0.0, lat[1]), (np.pi, lng[0]), (-np.pi, lng[1]))]


def chain_rect(chain: np.ndarray) -> tuple[float, float, float, float]:
    """lat_lo, lat_hi, lng_lo, lng_hi (radians) that hold all arcs of a chain, with a margin of
    rounding; all longitudes if an arc passes over a pole."""
    if not len(chain):
        return np.pi / 2, -np.pi / 2, np.pi, -np.pi
    lat = np.arctan2(chain[:, 2], np.hypot(chain[:, 0], chain[:, 1]))
    lng = np.arctan2(chain[:, 1], chain[:, 0])
    lo, hi = lat.min(), lat.max()
    a, b = chain[:-1], chain[1:]
    if len(a):
        n = np.cross(a - b, a + b)
        size = np.linalg.norm(n, axis=1)
        some = size > 0
        n, a, b = n[some] / size[some, None], a[some], b[some]
        # The highest point of a great circle: across from its normal towards the pole.
        top = np.arccos(np.clip(np.abs(n[:, 2]), 0, 1))
        up = np.stack([-n[:, 0] * n[:, 2], -n[:, 1] * n[:, 2], 1 - n[:, 2] ** 2], 1)
        for sign in (1, -1):
            within = ((np.cross(n, a) * up).sum(1) * sign > 0) & ((np.cross(b, n) * up).sum(1) * sign > 0)
            if within.any():
                hi, lo = (max(hi, top[within].max()), lo) if sign > 0 else (hi, min(lo, -top[within].max()))
    pad = 2 * 2.0**-52
    lo, hi = max(-np.pi / 2, lo - 2 * pad), min(np.pi / 2, hi + 2 * pad)
    # Longitudes: each arc takes the shorter way round.
    step = np.remainder(np.diff(lng) + np.pi, 2 * np.pi) - np.pi
    walk = np.concatenate([[0.0], np.cumsum(step)]) + lng[0]
    if np.ptp(walk) >= 2 * np.pi or (np.abs(np.abs(step) - np.pi) < 1e-15).any():
        return lo, hi, -np.pi, np.pi
    west, east = lng[walk.argmin()] - pad, lng[walk.argmax()] + pad
    west, east = (west + 2 * np.pi if west < -np.pi else west), (east - 2 * np.pi if east > np.pi else east)
    return (lo, hi, -np.pi, np.pi) if hi >= np.pi / 2 or lo <= -np.pi / 2 else (lo, hi, west, east)
