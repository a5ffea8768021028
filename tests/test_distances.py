"""Distances of cells and rectangles and bounds of chains, against sampled points."""

import numpy as np
import pytest

from globeframe.kernels import cell_distance as D
from globeframe.kernels import grid

RNG = np.random.default_rng(11)


def unit(n):
    p = RNG.normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def angles(a, b):
    return 2 * np.arcsin(np.minimum(1, np.linalg.norm(a[:, None] - b[None], axis=-1) / 2))


def cell_points(cell, n=40):
    """Points of a cell's whole rectangle, its border included."""
    face, ulo, uhi, vlo, vhi = (x[0] for x in grid.bound_uv(np.array([cell])))
    u, v = (x.ravel() for x in np.meshgrid(np.linspace(ulo, uhi, n), np.linspace(vlo, vhi, n)))
    return grid.unit(grid.uv_to_xyz(np.full(len(u), face), u, v))


def test_cells_to_points_edges_and_cells():
    for level in (0, 1, 2, 4):
        cells, others = grid.from_xyz(unit(12), level), grid.from_xyz(unit(12), level + 1)
        p, a, b = unit(12), unit(12), unit(12)
        b = grid.unit(a + 0.5 * b)
        near, far = D.to_point(cells, p), D.max_to_point(cells, p)
        edge, far_edge = D.to_edge(cells, a, b), D.max_to_edge(cells, a, b)
        cell, far_cell = D.to_cell(cells, others), D.max_to_cell(cells, others)
        share = np.linspace(0, 1, 200)[:, None]
        for k in range(12):
            mine, theirs = cell_points(cells[k]), cell_points(others[k])
            arc = grid.unit((1 - share) * a[k] + share * b[k])
            tol = 0.06 / 2**level
            for got, low, points in ((near[k], True, p[k : k + 1]), (far[k], False, p[k : k + 1]), (edge[k], True, arc), (far_edge[k], False, arc), (cell[k], True, theirs), (far_cell[k], False, theirs)):
                d = angles(mine, points)
                want = d.min() if low else d.max()
                assert (want - tol <= got <= want + 1e-9) if low else (want - 1e-9 <= got <= want + tol)


def test_cell_holds_its_points():
    cells = grid.from_xyz(unit(20), 3)
    assert D.holds(cells, grid.center(cells)).all() and D.holds(cells, grid.corners(cells)[:, 2]).all()
    assert not D.holds(cells, -grid.center(cells)).any()


def rect_points(r, n=60):
    lat, width = np.linspace(r[0], r[1], n), np.remainder(r[3] - r[2], 2 * np.pi)
    lng = r[2] + np.linspace(0, width, n)
    lat, lng = (x.ravel() for x in np.meshgrid(lat, lng))
    return np.stack([np.cos(lng) * np.cos(lat), np.sin(lng) * np.cos(lat), np.sin(lat)], -1)


def draw_rect():
    lat, lng = sorted(RNG.uniform(-np.pi / 2, np.pi / 2, 2)), RNG.uniform(-np.pi, np.pi)
    return lat[0], lat[1], lng, np.remainder(lng + RNG.uniform(0, 4) + np.pi, 2 * np.pi) - np.pi


def test_rectangles():
    for _ in range(60):
        r, s = draw_rect(), draw_rect()
        one = lambda x: [np.array([v]) for v in x]
        d = angles(rect_points(r), rect_points(s))
        got = D.rect_distance(one(r), one(s))[0]
        assert d.min() - 0.12 <= got <= d.min() + 1e-9
        got = D.rect_directed_hausdorff(one(r), one(s))[0]
        assert got == pytest.approx(d.min(1).max(), abs=0.13)
        assert got >= d.min(1).max() - 0.13


def test_chain_bounds_hold_the_chain():
    share = np.linspace(0, 1, 50)[:, None]
    for _ in range(60):
        chain = unit(6)
        lo, hi, west, east = D.chain_rect(chain)
        for a, b in zip(chain[:-1], chain[1:]):
            p = grid.unit((1 - share) * a + share * b)
            lat, lng = np.arctan2(p[:, 2], np.hypot(p[:, 0], p[:, 1])), np.arctan2(p[:, 1], p[:, 0])
            assert (lat >= lo).all() and (lat <= hi).all()
            inside = (lng >= west) & (lng <= east) if west <= east else (lng >= west) | (lng <= east)
            assert inside.all()
    assert D.chain_rect(np.zeros((0, 3)))[0] > D.chain_rect(np.zeros((0, 3)))[1]


def test_expanded_rectangles():
    one = lambda x: [np.array([v]) for v in x]
    for _ in range(60):
        r, d = draw_rect(), RNG.uniform(0, 0.4)
        points = rect_points(r, 25)
        lo, hi, west, east = (x[0] for x in D.rect_expanded(one(r), d))
        around = np.concatenate([points * np.cos(d * 0.999) + np.sin(d * 0.999) * t for t in (tangent(points) for _ in range(6))])
        lat, lng = np.arcsin(np.clip(around[:, 2], -1, 1)), np.arctan2(around[:, 1], around[:, 0])
        assert ((lat >= lo - 1e-12) & (lat <= hi + 1e-12)).all()
        assert ((np.remainder(lng - west, 2 * np.pi) <= np.remainder(east - west, 2 * np.pi) + 1e-9) | (east - west >= 2 * np.pi - 1e-9)).all()
        lo, hi, west, east = (x[0] for x in D.rect_expanded(one(r), -d / 4))
        if lo <= hi:
            inner = (lo, hi, west, east)
            assert D.rect_directed_hausdorff(one(inner), one(r))[0] < 1e-9
            back = [x[0] for x in D.rect_expanded(one(inner), d / 4)]
            assert back[0] >= r[0] - 1e-9 and back[1] <= r[1] + 1e-9
    assert D.rect_expanded(one((0.0, 0.1, 0.0, 0.1)), -0.2)[0][0] == 1


def tangent(points):
    t = np.cross(points, unit(len(points)))
    return t / np.linalg.norm(t, axis=1, keepdims=True)
