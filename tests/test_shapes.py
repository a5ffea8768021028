"""Shapes without SQL: against sampled points, all pairs, or what must come back."""

import numpy as np
import pytest

from globeframe.kernels import codecs, cover, grid, overlay, shapes
from globeframe.kernels import predicates as P
from globeframe.plans import catalogue
from globeframe.sources import derived

TABLES = "/root/testdata/sf0.001"
RNG = np.random.default_rng(17)


def unit(n):
    p = RNG.normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def around(center, radius, n):
    """Points within a radius of a centre."""
    x = P.reference_dir(center[None])[0]
    y, t, r = np.cross(center, x), RNG.uniform(0, 2 * np.pi, n), radius * np.sqrt(RNG.uniform(0, 1, n))
    return grid.unit(np.cos(r)[:, None] * center + np.sin(r)[:, None] * (np.cos(t)[:, None] * x + np.sin(t)[:, None] * y))


def near_ring(ring, points):
    return P.segment_distance(points[:, None], ring[None], np.roll(ring, -1, axis=0)[None]).min(1)


def test_buffers_hold_what_is_near():
    c = unit(1)[0]
    hexagon = shapes.regular(c, 0.15, 6)
    points = around(c, 0.35, 4000)
    inside, far = shapes.contains([hexagon], points), near_ring(hexagon, points)
    grown = shapes.contains(overlay.buffer_polygon([hexagon], 0.05), points)
    assert grown[inside | (far < 0.05)].all() and not grown[~inside & (far > 0.0515)].any()
    shrunk = shapes.contains(overlay.buffer_polygon([hexagon], -0.03), points)
    assert shrunk[inside & (far > 0.031)].all() and not shrunk[~inside | (far < 0.03)].any()
    two = np.stack([c, shapes.regular(c, 0.05, 3)[0]])
    discs = shapes.contains(overlay.buffer_points(two, 0.04), points)
    d = shapes.angle(points[:, None], two[None]).min(1)
    assert discs[d < 0.04].all() and not discs[d > 0.0408].any()
    assert overlay.sides_for(0.02) >= 15


def test_polygons_with_holes():
    c = unit(1)[0]
    outer, hole = shapes.regular(c, 0.3, 8), shapes.regular(c, 0.1, 6)
    beside = shapes.regular(shapes.regular(c, 0.6, 3)[0], 0.1, 5)
    points = np.concatenate([around(c, 0.8, 2000), unit(500)])
    within = lambda r: shapes.ring_contains(r, points)
    want = within(outer) & ~within(hole) | within(beside)
    for rings in ([outer, hole[::-1], beside], [hole[::-1], beside, outer], [outer, hole, beside]):
        assert (shapes.contains(rings, points) == want).all()
    assert (shapes.contains(overlay.complement([outer, hole[::-1], beside]), points) == ~want).all()
    less = overlay.combine([outer], [hole], "difference")
    assert len(less) == 2 and (shapes.contains(less, points) == (within(outer) & ~within(hole))).all()
    back = overlay.combine(less, [hole], "union")
    assert shapes.area(back) == pytest.approx(shapes.area([outer]), abs=1e-9)


def test_overlay_by_points():
    for _ in range(6):
        c = unit(1)[0]
        a, b = [shapes.regular(c, 0.3, 7)], [shapes.regular(around(c, 0.3, 1)[0], 0.25, 5)]
        points = around(c, 0.6, 1500)
        sure = (near_ring(a[0], points) > 1e-6) & (near_ring(b[0], points) > 1e-6)
        x, y = shapes.contains(a, points), shapes.contains(b, points)
        for op, want in (("union", x | y), ("intersection", x & y), ("difference", x & ~y), ("symmetric_difference", x ^ y)):
            got = shapes.contains(overlay.combine(a, b, op), points)
            assert (got == want)[sure].all()
        for rule, want in (("positive", x | y), ("odd", x ^ y), ("non_zero", x | y)):
            assert (shapes.contains(overlay.wound(a + b, rule), points) == want)[sure].all()
        assert overlay.wound([r[::-1] for r in a], "positive") == [] and len(overlay.wound([r[::-1] for r in a], "negative")) == 1


def test_medoids_and_consensus(spark):
    tracks = {r["user_id"]: np.array([tuple(p) for p in r["chain"]]) for r in derived.tracks(spark, TABLES).collect()}
    got = {r["key"]: (r["id"], r["cost"]) for r in catalogue.QUERIES["track_medoids"](spark, TABLES).collect()}
    for key in range(5):
        own = {u: c for u, c in tracks.items() if u % 5 == key}
        sums = {u: sum(shapes.dtw(c, o)[0] for w, o in own.items() if w != u) for u, c in own.items()}
        best = min(sums, key=lambda u: (round(sums[u], 9), u))
        assert got[key][0] == best and got[key][1] == pytest.approx(sums[best], abs=1e-5)
    chain = unit(5)
    mean = shapes.consensus([chain, chain, chain])
    assert np.allclose(mean, chain) and shapes.medoid([chain, chain[::-1], chain]) == 0


def test_simplified_chains_stay_near():
    for _ in range(20):
        start = unit(1)[0]
        chain = [start]
        for _ in range(40):
            chain.append(around(chain[-1], 0.02, 1)[0])
        chain = np.array(chain)
        for tolerance in (0.0, 0.005, 0.03):
            kept = shapes.simplify(chain, tolerance)
            assert kept[0] == 0 and kept[-1] == len(chain) - 1 and kept == sorted(set(kept))
            for i, j in zip(kept[:-1], kept[1:]):
                assert (P.segment_distance(chain[i : j + 1], chain[i], chain[j]) <= tolerance + 1e-12).all()
    straight = np.array([[np.cos(t), np.sin(t), 0] for t in np.linspace(0, 0.5, 20)])
    assert shapes.simplify(straight, 1e-6) == [0, 19] and shapes.simplify(straight[:1], 0.1) == [0]


def test_subsampled_chains_stay_near(spark):
    rows = {r["user_id"]: r for r in catalogue.QUERIES["track_simplify"](spark, TABLES).collect()}
    for r in derived.tracks(spark, TABLES).collect():
        chain = np.array([tuple(p) for p in r["chain"]])
        kept = shapes.subsample(chain, 0.3)
        assert rows[r["user_id"]]["n"] == len(chain) and rows[r["user_id"]]["kept"] == len(kept)
        assert kept[0] == 0 and kept[-1] == len(chain) - 1 and kept == sorted(set(kept))
        for i, j in zip(kept[:-1], kept[1:]):
            assert (P.segment_distance(chain[i : j + 1], chain[i], chain[j]) <= 0.3 + 1e-12).all()


def test_buffered_chains(spark):
    rows = {r["id"]: r["area"] for r in catalogue.QUERIES["buffer_chain"](spark, TABLES).collect()}
    # Two half discs and a band about an arc of atan(0.1); polygons around circles add a little.
    exact = 2 * np.pi * (1 - np.cos(0.02)) + np.arctan(0.1) * 2 * np.sin(0.02)
    assert len(rows) == 25 and all(exact <= a <= 1.01 * exact for a in rows.values())


def test_coverings_of_zones(spark):
    zones = {r["id"]: np.array(tuple(r["p"])) for r in derived.zones(spark, TABLES).collect()}
    for r in catalogue.QUERIES["region_covering"](spark, TABLES).collect():
        cells = np.array(r["cells"], np.int64)
        points = around(zones[r["id"]], 0.0799, 300)
        assert len(cells) <= 8 and grid.union_contains(grid.normalize(cells), grid.from_xyz(points)).all()
    for r in catalogue.QUERIES["union_operations"](spark, TABLES).collect():
        a, b = (grid.normalize(cover.cover(cover.Cap(zones[r["id"]], x))) for x in (0.08, 0.05))
        want = (grid.normalize(np.concatenate([a, b])), grid.union_intersection(a, b), grid.union_difference(a, b))
        assert (r["union"], r["intersection"], r["difference"]) == tuple(map(len, want))


def test_tessellated_chains_keep_the_tolerance(spark):
    from globeframe.operators import polygons as PG

    t = PG.with_tessellated(derived.tracks(spark, TABLES), tolerance=0.01).collect()
    for r in t[:5]:
        plane = np.array([(q.x, q.y) for q in r["plane"]])
        chain = np.array([tuple(p) for p in r["chain"]])
        share = np.linspace(0, 1, 9)[1:-1]
        for (x0, y0), (x1, y1) in zip(plane[:-1], plane[1:]):
            mid = grid.latlng_to_xyz(y0 + share * (y1 - y0), x0 + share * (x1 - x0))
            assert (P.segment_distance(mid[:, None], chain[None, :-1], chain[None, 1:]).min(1) <= 0.02).all()
        assert len(plane) >= len(chain)


def test_contains_vertex_agrees_with_semi_open_rings(spark):
    signs = {r["id"]: r["sign"] for r in catalogue.QUERIES["contains_vertex"](spark, TABLES).collect()}
    for r in derived.zones(spark, TABLES).collect():
        ring = shapes.regular(np.array(tuple(r["p"])), 0.15, 6)
        inside = shapes.ring_contains(ring, ring)
        assert [signs[r["id"] * 10 + k] for k in range(6)] == [1 if x else -1 for x in inside]


def test_coverings():
    for _ in range(10):
        c, r = unit(1)[0], RNG.uniform(0.05, 0.6)
        cap, points = cover.Cap(c, r), around(c, r * 0.999, 300)
        outside = -around(c, 0.5, 50)
        leaf, away = grid.from_xyz(points), grid.from_xyz(outside)
        for cells in (cover.cover(cap), cover.fast_cover(cap), cover.cap_bound(c, r), cover.simple_cover(cap, c, 4)):
            assert grid.union_contains(grid.normalize(cells), leaf).all()
        inner = cover.cover(cap, 40, interior=True)
        assert len(inner) and (shapes.angle(grid.corners(inner), c) <= r + 1e-12).all()
        ring = [shapes.regular(c, r, 9)]
        hits = shapes.contains(ring, points)
        both = cover.All([cover.Polygon(ring), cover.Cap(c, r / 2)])
        small = hits & (shapes.angle(points, c) < r / 2 - 1e-9)
        assert grid.union_contains(cover.cover(both), leaf[small]).all()
        either = cover.Any([cover.Cap(c, r), cover.Cap(outside[0], 0.01), cover.Point(outside[1])])
        cells = cover.cover(either, 20)
        assert grid.union_contains(cells, leaf).all() and grid.union_contains(cells, away[:2]).all()
        grown = cover.cover(cover.Near(ring, 0.1), 16)
        assert grid.union_contains(grown, leaf[hits]).all()
    canon = cover.canonicalize(cover.cover(cover.Cap(unit(1)[0], 0.3), 30), 8)
    assert len(canon) <= 8 and cover.is_canonical(canon, 8)


def test_cell_unions():
    for _ in range(10):
        a, b = (grid.normalize(np.concatenate([grid.from_xyz(unit(6), k) for k in (1, 2, 3)])) for _ in range(2))
        union, both, less = grid.normalize(np.concatenate([a, b])), grid.union_intersection(a, b), grid.union_difference(a, b)
        count = grid.leaf_count
        assert count(union) + count(both) == count(a) + count(b) and count(less) + count(both) == count(a)
        p = grid.from_xyz(unit(500))
        x, y = grid.union_contains(a, p), grid.union_contains(b, p)
        assert (grid.union_contains(union, p) == (x | y)).all() and (grid.union_contains(less, p) == (x & ~y)).all()
        grown = grid.expand(a, 4)
        assert grid.union_contains(grown, a).all() and count(grown) > count(a)
        flat = grid.denormalize(a, 3, 2)
        assert count(flat) == count(a) and ((grid.level_of(flat) - 3) % 2 == 0).all()
    near = grid.expand_by_radius(grid.from_xyz(unit(1), 5), 0.02, 3)
    assert len(near)
    cells = grid.from_xyz(unit(40), 6)
    assert np.allclose(grid.approx_area(cells), grid.exact_area(cells), rtol=3e-2)


def test_byte_forms_of_bad_bytes():
    for kind in ("cell", "point", "cap", "rect", "cell_union", "polyline", "loop", "polygon", "lax_polygon", "point_vector"):
        for raw in (b"", b"\x09", b"\x01\xff\xff\xff\xff\xff\xff\xff\xff\x01", b"\xff" * 40):
            with pytest.raises(codecs.Malformed):
                codecs.decode(kind, raw)
    ids = grid.normalize(grid.from_xyz(unit(9), 7))
    assert (codecs.decode("cell_union", codecs.encode("cell_union", ids)) == ids).all()
    for vector in ([], [0], ids, grid.from_xyz(unit(50), 30), grid.from_xyz(unit(50), 4), grid.children(grid.from_xyz(unit(1), 12)).ravel(), grid.faces(), np.concatenate([grid.from_xyz(unit(3), k) for k in range(31)])):
        raw = codecs.encode("cell_vector", np.asarray(vector, np.int64))
        assert codecs.decode("cell_vector", raw).tolist() == list(vector)
    assert len(codecs.encode("cell_vector", grid.children(grid.from_xyz(unit(1), 12)).ravel())) <= 2 + 7 + 4
    for width, top in ((4, 2**32 - 1), (8, 2**64 - 1)):
        values = [0, 1, 255, 256, top]
        assert codecs.read_uints(codecs.Reader(codecs.encode_uints(values, width)), width).tolist() == values
    words = [b"", b"one", b"", b"three"]
    assert codecs.read_strings(codecs.Reader(codecs.encode_strings(words))) == words


def test_wedges():
    o = np.array([0.0, 0.0, 1.0])
    at = lambda t: grid.unit(np.array([np.cos(t), np.sin(t), 5.0]))
    cases = [((2.0, 0.0, 2.0, 0.0), "equals"), ((2.0, 0.0, 1.5, 0.5), "properly_contains"), ((1.5, 0.5, 2.0, 0.0), "is_properly_contained"), ((1.0, 0.0, 3.0, 2.0), "is_disjoint"), ((2.0, 0.0, 3.0, 1.0), "properly_overlaps")]
    for (a0, a2, b0, b2), want in cases:
        corner = (at(a0), o, at(a2), at(b0), at(b2))
        assert P.wedge_relation(*corner) == want
        assert P.wedge_contains(*corner) == (want in ("equals", "properly_contains"))
        assert P.wedge_intersects(*corner) == (want != "is_disjoint")
