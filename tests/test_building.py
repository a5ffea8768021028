"""Built and combined shapes, exact predicates, clipping and point terms."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from globeframe.functions import intervals as I
from globeframe.kernels import builder, grid, shapes
from globeframe.kernels import predicates as P
from globeframe.operators import terms as T

RNG = np.random.default_rng(23)


def unit(n):
    p = RNG.normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_snapped_polygons_lie_on_sites():
    for _ in range(5):
        ring = shapes.regular(unit(1)[0], 0.2, 20)
        for snap, near in ((("cell", 10), 2e-3), (("degrees", 1), 2e-3), (None, 0)):
            (out,) = builder.polygon([ring], builder.Options(snap=snap))
            assert shapes.border_near(ring, out, near + 1e-15)
            assert abs(shapes.area([out]) - shapes.area([ring])) < 0.01
            if snap and snap[0] == "cell":
                assert np.allclose(grid.center(grid.from_xyz(out, 10)), out)
            again = builder.polygon([out], builder.Options(snap=snap))
            assert len(again) == 1 and shapes.border_equal(again[0], out, 1e-13)
    # Rings smaller than a site vanish.
    assert builder.polygon([shapes.regular(unit(1)[0], 1e-6, 5)], builder.Options(snap=("cell", 5))) == []
    assert len(builder.polygon([ring], builder.Options(simplify=0.05))[0]) < 20


def test_crossing_edges_are_split():
    c = unit(1)[0]
    r = shapes.regular(c, 0.2, 4)
    cross = [np.stack([r[0], r[2]]), np.stack([r[1], r[3]])]
    whole = builder.polylines(cross, builder.Options())
    split = builder.polylines(cross, builder.Options(split_crossing=True))
    assert len(whole) == 2 and len(split) == 4
    assert sum(map(shapes.length, split)) == pytest.approx(sum(map(shapes.length, cross)))
    assert all(min(shapes.angle(s[0], c), shapes.angle(s[-1], c)) < 1e-9 for s in split)


def test_graph_policies():
    a, b, c = unit(3)
    edge = lambda *pairs: np.array(pairs)
    rows = edge((a, b), (a, b), (b, a), (c, c), (b, c))
    G, O = builder.Graph, builder.Options
    assert len(G(rows, O()).edges) == 3 and len(G(rows, O(duplicates="keep")).edges) == 4
    assert len(G(rows, O(duplicates="keep", degenerate="keep")).edges) == 5
    assert len(G(rows, O(siblings="discard")).edges) == 2
    assert len(G(rows, O(undirected=True)).edges) == 2
    assert (G(rows, O(degenerate="keep")).points() == c).all()
    chain = G(edge((a, b), (b, c)), O()).chain()
    assert (chain == np.stack([a, b, c])).all()
    with pytest.raises(ValueError):
        G(edge((a, b), (a, c)), O()).chain()
    d = unit(1)[0]
    kinds = ["sibling", "point", "sibling", "sibling", "sibling"]
    assert builder.degeneracies([np.stack([a, b, b, c, b])]) == [(0, k, kind) for k, kind in enumerate(kinds)]
    assert builder.degeneracies([np.stack([a, b, c, d])]) == []


def test_operations_on_several_dimensions():
    c = unit(1)[0]
    ring = shapes.regular(c, 0.3, 8)
    points = np.concatenate([grid.unit(c + 0.4 * RNG.uniform(-1, 1, (60, 3))), ring[:2]])
    inside = shapes.contains([ring], points)
    chain = np.stack([grid.unit(c + 0.6 * np.array(v)) for v in ([1, 0, 0], [0, 1, 0], [-1, 0.3, 0.2])])
    none = np.zeros((0, 3))
    a, b = (points, [chain], []), (none, [], [ring])
    both, less = builder.combine(a, b, "intersection"), builder.combine(a, b, "difference")
    assert len(both[0]) == inside.sum() and len(less[0]) == (~inside).sum()
    assert sum(map(shapes.length, both[1] + less[1])) == pytest.approx(shapes.length(chain))
    assert all(shapes.contains([ring], grid.unit(p[:-1] + p[1:])).all() for p in both[1])
    union = builder.combine(a, b, "union")
    assert len(union[2]) == 1 and len(union[0]) == len(less[0])
    for model, extra in (("open", 0), ("closed", 2)):
        got = builder.combine((ring[:2], [], []), b, "intersection", model)
        assert len(got[0]) == extra
    assert builder.is_empty(builder.combine((points, [], []), (points, [], []), "difference"))
    odd = builder.combine((points[:3], [], [ring]), (points[1:4], [], []), "symmetric_difference")
    assert len(odd[2]) == 1


def exact_sign(x):
    return (x > 0) - (x < 0)


def test_exact_predicates():
    x, y, a, b = unit(200), unit(200), unit(200), unit(200)
    f = lambda p: [Fraction(float(v)) for v in p]
    dot = lambda p, q: sum(u * v for u, v in zip(p, q))
    assert (P.sign_dot(x, y) == [exact_sign(dot(f(p), f(q))) for p, q in zip(x, y)]).all()
    e = np.array([1.0, 0, 0])
    assert P.sign_dot(e[None], np.array([[0.0, 1, 0]]))[0] == 0 and P.sign_dot(e[None], np.array([[1e-300, 1, 0]]))[0] == 1
    assert P.compare_distance(e[None], np.array([[0.0, 1, 0]]), 2.0)[0] == 0
    assert P.compare_distance(e[None], grid.unit(np.array([[1e-17, 1.0, 0]])), 2.0)[0] == -1
    chord = ((x - y) ** 2).sum(1)
    assert (P.compare_distance(x, y, chord + 1e-9) == -1).all() and (P.compare_distance(x, y, chord - 1e-9) == 1).all()
    d = P.segment_distance(x, a, b)
    for off, want in ((1e-6, -1), (-1e-6, 1)):
        limit = 4 * np.sin(np.clip(d + off, 0, np.pi) / 2) ** 2
        assert (P.compare_edge_distance(x, a, b, limit) == want).all()
    pair = P.segment_pair_distance(x, y, a, b)
    far = pair > 1e-3
    assert (P.compare_edge_pair_distance(x, y, a, b, 4 * np.sin((pair + 1e-6) / 2) ** 2) == -1).all()
    assert (P.compare_edge_pair_distance(x, y, a, b, 4 * np.sin((pair - 1e-6) / 2) ** 2)[far] == 1).all()
    same = P.compare_edge_directions(x, y, x, y)
    assert (same == 1).all() and (P.compare_edge_directions(x, y, y, x) == -1).all()
    n = P.robust_cross(x, y)
    assert np.allclose(np.abs((n * x).sum(1)), 0, atol=1e-14) and np.isfinite(P.robust_cross(x, x)).all() and np.isfinite(P.robust_cross(x, -x)).all()


def test_circle_and_site_predicates():
    a, b, c, n, x, y = (unit(150) for _ in range(6))
    want = np.sign((np.cross(np.cross(a, b), n) * x).sum(1))
    assert (P.circle_edge_sign(a, b, n, x) == want).all()
    e = np.eye(3)
    assert P.circle_edge_sign(e[:1], e[1:2], e[2:], e[2:])[0] == 0
    m = unit(150)
    far = lambda p, q: np.abs((grid.unit(np.cross(np.cross(p, q), m)) * n).sum(1))
    assert (P.circle_edge_order(a, b, c, x, m, n) == np.sign(far(a, b) - far(c, x))).all()
    assert (P.circle_edge_order(a, b, a, b, m, n) == 0).all()
    centre = grid.unit(np.cross(b - a, c - a)) * P.orientation(a, b, c)[:, None]
    assert np.allclose(np.ptp([shapes.angle(centre, p) for p in (a, b, c)], axis=0), 0, atol=1e-9)
    assert (P.edge_circumcenter_sign(x, y, a, b, c) == P.orientation(x, y, centre)).all()
    # The centre of a symmetric circle lies on the axis of symmetry.
    ring = np.array([[0.6, 0.3, 0.5], [0.6, -0.3, 0.5], [0.9, 0.0, 0.1]])
    assert P.edge_circumcenter_sign(e[0][None], e[2][None], *(p[None] for p in ring))[0] == 0
    assert P.edge_circumcenter_sign(a, b, c, c, x).tolist() == [0] * 150
    x0, x1 = np.array([1.0, 0, 0]), np.array([np.cos(0.5), np.sin(0.5), 0])
    at = lambda t, h: np.array([np.cos(t) * np.cos(h), np.sin(t) * np.cos(h), np.sin(h)])
    assert P.site_exclusion(at(0.2, 0.09), at(0.21, 0.0), x0, x1, 0.1) == P.FIRST
    assert P.site_exclusion(at(0.2, 0.0), at(0.21, 0.09), x0, x1, 0.1) == P.SECOND
    assert P.site_exclusion(at(0.1, 0.01), at(0.3, 0.01), x0, x1, 0.1) == P.NEITHER


def test_clipping():
    a, b = RNG.uniform(-2, 2, (300, 2)), RNG.uniform(-2, 2, (300, 2))
    p, q, some = P.clip_to_rect(a, b, [-1, -0.5], [1, 0.5])
    t = np.linspace(0, 1, 2001)[:, None, None]
    line = a + t * (b - a)
    inside = ((line >= [-1, -0.5]) & (line <= [1, 0.5])).all(-1)
    assert (some >= inside.any(0)).all()
    length = np.linalg.norm(q - p, axis=1) / np.linalg.norm(b - a, axis=1)
    assert np.allclose(np.where(some, length, 0), inside.mean(0), atol=2e-3)
    x, y = unit(100), unit(100)
    whole = shapes.angle(x, y)
    total = np.zeros(100)
    for face in range(6):
        u, v, some = P.clip_to_face(x, y, face)
        ends = [grid.unit(grid.uv_to_xyz(np.full(100, face), w[:, 0], w[:, 1])) for w in (u, v)]
        total += np.where(some, shapes.angle(*ends), 0)
        assert (np.abs(u[some]) <= 1 + 1e-9).all() and (np.abs(v[some]) <= 1 + 1e-9).all()
    assert np.allclose(total, whole)


def test_circle_intervals(spark):
    rows = [(k, *map(float, RNG.uniform(-np.pi, np.pi, 4))) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    x, y = I.interval(F.col("a"), F.col("b")), I.interval(F.col("c"), F.col("d"))
    out = df.select("id", I.s_union(x, y).alias("u"), I.s_intersection(x, y).alias("i"), I.s_from_pair("a", "b").alias("p")).collect()
    t = np.linspace(-np.pi, np.pi, 721)
    has = lambda lo, hi: (t >= lo) & (t <= hi) if lo <= hi else (t >= lo) | (t <= hi)
    none = lambda v: v["lo"] == np.pi and v["hi"] == -np.pi
    for (k, a, b, c, d), r in zip(rows, out):
        p, q = has(a, b), has(c, d)
        union = has(r["u"]["lo"], r["u"]["hi"])
        assert (union >= (p | q)).all()
        both = np.zeros(len(t), bool) if none(r["i"]) else has(r["i"]["lo"], r["i"]["hi"])
        assert (both >= (p & q)).all() and (both <= (p | q)).all()
        short = has(r["p"]["lo"], r["p"]["hi"])
        assert short.mean() <= 0.505 and {r["p"]["lo"], r["p"]["hi"]} == {a, b}


def test_point_terms(spark):
    p = unit(1)[0]
    leaf = int(grid.from_xyz(p[None])[0])
    df = spark.createDataFrame([(leaf,)], "leaf long")
    token = lambda k: format(int(grid.parent(np.array([leaf]), k)[0]) & 2**64 - 1, "016x").rstrip("0")
    for options in (T.TermOptions(), T.TermOptions(points_only=True), T.TermOptions(save_space=True), T.TermOptions(min_level=2, max_level=11, level_mod=3)):
        got = df.select(T.point_query_terms("leaf", options).alias("t")).first()["t"]
        assert got == [token(options.top), *(f"${token(k)}" for k in range(options.top, options.min_level - 1, -1))]
    for bad in ({"min_level": 5, "max_level": 4}, {"max_level": 31}, {"level_mod": 4}):
        with pytest.raises(ValueError):
            T.TermOptions(**bad)
