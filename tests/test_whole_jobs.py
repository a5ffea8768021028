"""Queries over all rows of their tables, against brute force and the rows that their SQL keeps."""

import tracemalloc

import numpy as np
import pytest

from globeframe.kernels import shapes
from globeframe.operators import geometry as G
from globeframe.operators import spatial_join as J
from globeframe.plans import catalogue
from globeframe.sources import derived

TABLES = "/root/testdata/sf0.001"


def _crossings(ids, a, b):
    """Pairs of arcs without a shared end that cross, by signs of determinants of all pairs."""
    n = np.cross(a, b)
    c, d = np.sign(n @ a.T), np.sign(n @ b.T)
    same = lambda p, q: (p[:, None] == q[None]).all(-1)
    shared = same(a, a) | same(a, b) | same(b, a) | same(b, b)
    k = (c * d < 0) & (c.T * d.T < 0) & (c * c.T < 0) & ~shared
    return {(int(x), int(y)) for x, y in zip(*(ids[i] for i in np.nonzero(k)), strict=True) if x < y}


def test_edge_crossing_join_looks_at_all_arcs(spark):
    rows = derived.edges(spark, TABLES).select("id", "a", "b").collect()
    a, b = (np.array([tuple(r[c]) for r in rows]) for c in "ab")
    want = {}
    for x, y in _crossings(np.array([r["id"] for r in rows]), a, b):
        n, total = want.get(x, (0, 0))
        want[x] = (n + 1, total + y)
    got = {r["left_id"]: (r["n"], r["right_ids"]) for r in catalogue.QUERIES["edge_crossing_join"](spark, TABLES).collect()}
    assert got == want and sum(n for n, _ in got.values()) > 10000


def test_crossing_pairs_of_two_sets_and_touching(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(60, 2, 3))
    p /= np.linalg.norm(p, axis=-1, keepdims=True)
    p[40:, 1] = p[40:, 0] + 0.01 * p[40:, 1]
    p /= np.linalg.norm(p, axis=-1, keepdims=True)
    p[1, 0] = p[0, 1]
    point = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([(i, tuple(map(float, x)), tuple(map(float, y))) for i, (x, y) in enumerate(p)], f"id long, a {point}, b {point}")
    want = _crossings(np.arange(60), p[:, 0], p[:, 1])
    assert {tuple(r) for r in J.crossing_pairs(df, level=4).collect()} == want
    assert {tuple(r) for r in J.crossing_pairs(df, level=4, touching=True).collect()} == want | {(0, 1)}
    halves = J.crossing_pairs(df.filter("id < 30"), df.filter("id >= 30"), level=2)
    assert sorted(tuple(r) for r in halves.collect()) == sorted(p for p in want if p[0] < 30 <= p[1])


def test_track_alignment_takes_whole_chains(spark):
    tracks = {r["user_id"]: np.array([tuple(p) for p in r["chain"]]) for r in derived.tracks(spark, TABLES).collect()}
    got = {r["user_id"]: r["cost"] for r in catalogue.QUERIES["track_alignment"](spark, TABLES).collect()}
    assert set(got) == set(tracks) and max(len(c) for c in tracks.values()) > 13
    for user, c in tracks.items():
        assert got[user] == pytest.approx(shapes.dtw(c, c[1:])[0], abs=1e-8)


def test_alignment_cost_equals_the_full_table():
    rng = np.random.default_rng(5)
    for n, m, radius in ((1, 1, None), (1, 7, None), (9, 1, None), (8, 5, None), (5, 8, None), (30, 29, None), (12, 12, 0), (12, 12, 3), (20, 11, 4), (11, 20, 4)):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        cost = shapes.dtw_cost(a, b, radius)
        table = np.full((n + 1, m + 1), np.inf)
        table[0, 0] = 0.0
        for i in range(n):
            for j in range(m):
                if radius is None or i * m // n - radius <= j <= i * m // n + radius:
                    table[i + 1, j + 1] = min(table[i, j], table[i, j + 1], table[i + 1, j]) + ((a[i] - b[j]) ** 2).sum()
        assert cost == pytest.approx(table[n, m], abs=1e-12)


def test_alignment_of_long_chains_keeps_no_table():
    c = np.random.default_rng(6).normal(size=(4000, 3))
    tracemalloc.start()
    shapes.dtw_cost(c, c[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000


def test_hausdorff_takes_all_vertices_and_arcs(spark):
    rows = G.with_regular_ring(derived.zones(spark, TABLES), "p", 0.15, 6).select("id", "ring").collect()
    rings = {r["id"]: np.array([tuple(p) for p in r["ring"]]) for r in rows}
    got = {(r["target_id"], r["source_id"]): r["radians"] for r in catalogue.QUERIES["hausdorff"](spark, TABLES).collect()}
    assert len(rings) == 25 and len(got) > 200 and {x for x, _ in got} <= set(rings)
    share = np.linspace(0, 1, 401)[:, None]
    for y, ring in rings.items():
        # Points along each side of the closed ring, instead of a formula for arcs.
        sides = np.concatenate([(1 - share) * a + share * b for a, b in zip(ring, np.roll(ring, -1, 0), strict=True)])
        sides /= np.linalg.norm(sides, axis=1, keepdims=True)
        for x, vertices in rings.items():
            if (x, y) not in got:
                continue
            near = 2 * np.arcsin(np.minimum(1, np.linalg.norm(vertices[:, None] - sides[None], axis=-1).min(1) / 2))
            assert got[x, y] == pytest.approx(near.max(), abs=2e-4)


def _rows(spark, name):
    return {r["id"]: r for r in catalogue.QUERIES[name](spark, TABLES).collect()}


def test_rects_at_the_antimeridian_and_the_poles(spark):
    hundredths = lambda k: ((k * 7919) % 17001 - 8500, (k * 104729) % 36000 - 18000)
    pairs = spark.read.parquet(f"{TABLES}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    area, relations = _rows(spark, "rect_area"), _rows(spark, "rect_relations")
    assert set(area) == set(relations) == {r[0] for r in pairs}
    for k, nation in pairs:
        (lat, lng), (zlat, zlng) = hundredths(k), hundredths(nation)
        lo, hi = np.radians(max(-9000, lat - 500) / 100), np.radians(min(9000, lat + 500) / 100)
        assert area[k]["area"] == pytest.approx(np.radians(10) * (np.sin(hi) - np.sin(lo)), abs=2e-8)
        turn = abs((lng - zlng + 18000) % 36000 - 18000)
        cut = lambda x, s: (max(-9000, x - s), min(9000, x + s))
        (a, b), (c, e) = cut(lat, 2000), cut(zlat, 1000)
        assert relations[k]["meets"] == (turn <= 3000 and c <= b and a <= e)
        assert relations[k]["holds"] == (turn <= 1000 and a <= c and e <= b)


def test_triangles_of_all_pairs(spark):
    got = _rows(spark, "triangle_area")
    pairs = catalogue._pairs(spark, TABLES).select("id", "p", "q").collect()
    assert set(got) == {r["id"] for r in pairs}
    for r in pairs:
        a, b, c = np.array(r["p"]), np.array(r["q"]), np.array([0.0, 0.0, 1.0])
        want = 2 * np.arctan2(abs(a @ np.cross(b, c)), 1 + a @ b + b @ c + c @ a)
        assert got[r["id"]]["area"] == pytest.approx(want, abs=2e-6)


def test_curve_steps_of_all_faces(spark):
    got = _rows(spark, "cell_curve_steps")
    cells = {r["id"]: r["cell"] for r in catalogue._cells(spark, TABLES, 9).collect()}
    assert set(got) == set(cells) and min(cells.values()) < 0
    for k, cell in cells.items():
        assert got[k]["steps"] == (cell % 2**64) >> 43
        assert got[k]["following"] == cell + 2 * (cell & -cell)
