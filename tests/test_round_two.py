"""Findings of the second review: ties, degenerate shapes and jobs whose work must not grow too fast."""

import math

import pytest
from pyspark.sql import functions as F

from globeframe.functions import vectors as V
from globeframe.operators import aggregates as AG


def test_area_of_half_spheres(spark):
    # Points on one great circle with the pole: their arcs go all the way round, or back.
    rows = [(float(p), float(q)) for p in range(-80, 80, 7) for q in range(-80, 80, 9) if p + q]
    df = spark.createDataFrame(rows, "p double, q double")
    df = df.select("p", "q", V.from_degrees("p", F.lit(17.0)).alias("a"), V.from_degrees("q", F.lit(-163.0)).alias("b"))
    for r in df.select("p", "q", V.triangle_area("a", "b", V.vector(0.0, 0.0, 1.0)).alias("area")).collect():
        assert r.area == pytest.approx(2 * math.pi if r.p + r.q < 0 else 0.0, abs=1e-9)


def test_bounding_rect_of_equal_gaps(spark):
    # Points a hundredth of a degree apart: all gaps are equal but for rounding.
    lngs = [k / 100 - 180 for k in range(36000)]
    df = spark.createDataFrame([(1, 0.0, x) for x in lngs], "key int, lat double, lng double")
    r = AG.bounding_rect(df, "key").collect()[0]
    assert (r.lng_hi, r.lng_lo) == (-180.0, -179.99)


def _edges(spark, n, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    p = rng.normal(size=(2, n, 3))
    p /= np.linalg.norm(p, axis=-1, keepdims=True)
    point = lambda v: dict(zip("xyz", map(float, v), strict=True))
    rows = [(k % 7, k, point(p[0, k]), point(p[1, k])) for k in range(n)]
    sql = "struct<x:double,y:double,z:double>"
    return p, spark.createDataFrame(rows, f"shape_id long, edge_id int, a {sql}, b {sql}")


@pytest.mark.parametrize("radius", [0.01, 0.3, math.pi])
def test_edges_within_few_and_many_targets(spark, monkeypatch, radius):
    from globeframe.operators import edge_queries as Q

    p, edges = _edges(spark, 60)
    _, other = _edges(spark, 9, 4)
    targets = other.select(F.col("shape_id").alias("target_id"), "a", "b")
    rows = lambda: sorted(tuple(r) for r in Q.edges_within(edges, targets, radius).collect())
    few = rows()
    monkeypatch.setattr(Q, "FEW", 3)
    assert few == rows() and few


def test_long_edges_are_not_spread_over_cells(spark, monkeypatch):
    from globeframe.operators import edge_queries as Q

    monkeypatch.setattr(Q, "_entered", lambda *_: pytest.fail("edges entered under all their cells"))
    _, edges = _edges(spark, 50)
    targets = edges.limit(2).select(F.col("edge_id").cast("long").alias("target_id"), "a", F.col("a").alias("b"))
    assert Q.closest_edges(edges, targets, 3).count() == 6


def test_cells_at_equal_distance_by_their_order(spark):
    from globeframe.functions import cells as C
    from globeframe.kernels import grid
    from globeframe.operators import edge_queries as Q

    # From points far along a line of symmetry, the two cells beside it are equally far.
    import numpy as np

    cells = grid.from_xyz(grid.latlng_to_xyz(np.array([1e-3, -1e-3] * 8), np.repeat(np.linspace(-40, 40, 8), 2)), 6)
    df = spark.createDataFrame([(int(c), k) for k, c in enumerate(cells)], "cell long, label long")
    asked = [(k, float(x)) for k, x in enumerate(np.linspace(-39, 39, 23))]
    q = spark.createDataFrame(asked, "target_id long, lng double").select("target_id", V.from_degrees(F.lit(0.0), "lng").alias("q"))
    got = Q.closest_cells(df, Q.point_targets(q), 2).orderBy("target_id", "rank").collect()
    for first, second in zip(got[::2], got[1::2], strict=True):
        assert grid.order_key(np.int64(first.cell)) <= grid.order_key(np.int64(second.cell)) or second.radians - first.radians > 1e-12


def test_distances_of_many_points_to_one_polygon():
    import numpy as np

    from globeframe.kernels import predicates as P
    from globeframe.kernels import shapes

    rng = np.random.default_rng(1)
    p = rng.normal(size=(3000, 3))
    p /= np.linalg.norm(p, axis=-1, keepdims=True)
    c = np.array([0.0, 0.6, 0.8])
    rings = [shapes.regular(c, 0.5, 7), shapes.regular(c, 0.2, 5)[::-1]]
    near = np.min([P.segment_distance(p[:, None], r[None], np.roll(r, -1, axis=0)[None]).min(1) for r in rings], axis=0)
    held = shapes.contains(rings, p)
    assert np.allclose(shapes.border_distances(rings, p), near, atol=1e-15)
    assert (shapes.distances(rings, p)[held] == 0).all() and 0 < held.sum() < 500
    at = shapes.project_on_polygon(rings, p)
    assert np.allclose(shapes.angle(p, at), np.where(held, 0, near), atol=1e-12)


def test_tessellation_of_many_chains_at_once():
    import numpy as np

    from globeframe.kernels import grid, shapes

    rng = np.random.default_rng(5)
    draw = lambda n: grid.unit(rng.normal(size=(n, 3)))
    project = lambda p: grid.xyz_to_latlng(p)[::-1]
    unproject = lambda q: grid.latlng_to_xyz(q[1], q[0])
    chains = [draw(9), draw(0), draw(1), draw(2), draw(30)]
    for chain, got in zip(chains, shapes.tessellate_chains(chains, project, unproject, 0.02, 360.0), strict=True):
        want: list = []
        one = lambda p: tuple(map(float, project(p)))
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            part = shapes.tessellate(a, b, one, unproject, 0.02, want[-1] if want else None, 360.0)
            want += part[1:] if want else part
        want = want or [one(p) for p in chain]
        assert np.allclose(np.array(want).reshape(-1, 2), got, atol=1e-9)


@pytest.mark.parametrize("radius", [0.05, 0.6, math.pi])
def test_radius_join_by_chunks(spark, monkeypatch, radius):
    import numpy as np

    from globeframe.operators import spatial_join as J

    monkeypatch.setattr(J, "CHUNK", 4)
    p, edges = _edges(spark, 120)
    points = edges.select(F.col("edge_id").cast("long").alias("id"), F.col("a").alias("p"))
    asked = edges.filter("edge_id < 40").select(F.col("edge_id").cast("long").alias("query_id"), F.col("b").alias("q"))
    chord2 = ((p[0][None] - p[1][:40, None]) ** 2).sum(-1)
    want = {(int(q), int(i)) for q, i in np.argwhere(chord2 <= 4 * math.sin(radius / 2) ** 2)}
    got = J.radius_join(points, asked, radius).collect()
    assert len(got) == len(want) and {(r.query_id, r.id) for r in got} == want
    near = {q for q, _ in want}
    assert sorted(r.query_id for r in J.radius_semi(points, asked, radius).collect()) == sorted(near)
    assert sorted(r.query_id for r in J.radius_anti(points, asked, radius).collect()) == sorted(set(range(40)) - near)


def test_members_of_nested_cells(spark):
    import numpy as np

    from globeframe.kernels import grid
    from globeframe.operators import polygons as PG

    leaf = grid.from_xyz(grid.latlng_to_xyz(np.array([3.0, 3.0, -40.0]), np.array([5.0, 5.1, 80.0])))
    cells = [int(grid.parent(leaf[0], k)) for k in (3, 7, 7)]
    points = spark.createDataFrame([(k, int(c)) for k, c in enumerate(leaf)], "id long, leaf long")
    unions = spark.createDataFrame([(1, cells), (2, cells[1:]), (3, [])], "key long, cells array<long>")
    got = sorted((r.key, r.id) for r in PG.members(points, unions).collect())
    assert got[:2] == [(1, 0), (1, 1)] and (2, 0) in got and len(got) == len(set(got))


def test_self_intersections_of_shapes_apart(spark):
    import numpy as np

    from globeframe.kernels import predicates as P
    from globeframe.operators import edge_queries as Q

    p, edges = _edges(spark, 140)
    want = {}
    for i, j in np.argwhere(np.triu(P.crossing(p[0][:, None], p[1][:, None], p[0][None], p[1][None]) > 0, 1)):
        if i % 7 == j % 7:
            want.setdefault(int(i % 7), (int(i), int(j)))
    assert {r.shape_id: (r.left_edge, r.right_edge) for r in Q.self_intersections(edges).collect()} == want


def test_kernels_take_parts_of_batches():
    import pyarrow as pa

    from globeframe.operators import geometry as G

    b = pa.RecordBatch.from_pydict({"k": list(range(100)), "c": [[{"x": float(k), "y": 0.0, "z": 1.0}] * (k % 3) for k in range(100)]})
    parts = list(G.slices(b, 200))
    assert len(parts) > 5 and [k for part in parts for k in part.column("k").to_pylist()] == list(range(100))
    for part in parts:
        for k, v in zip(part.column("k").to_pylist(), G._values(part.column("c")), strict=True):
            assert v.tolist() == [[float(k), 0.0, 1.0]] * (k % 3)


@pytest.mark.parametrize("radius", [None, 2, 40])
def test_alignments_of_many_pairs(radius):
    import numpy as np

    from globeframe.kernels import shapes

    rng = np.random.default_rng(2)
    left, right = ([rng.normal(size=(int(n), 3)) for n in rng.integers(1, 30, 40)] for _ in range(2))
    want = [shapes.dtw_cost(a, b, radius) for a, b in zip(left, right, strict=True)]
    assert np.allclose(shapes.dtw_costs(left, right, radius), want, rtol=1e-12)


def test_medoids_by_blocks(spark):
    import numpy as np

    from globeframe.kernels import shapes
    from globeframe.operators import polygons as PG

    rng = np.random.default_rng(8)
    chains = [rng.normal(size=(int(n), 3)) for n in rng.integers(1, 12, 23)]
    rows = [(k % 2, k, [dict(zip("xyz", map(float, p), strict=True)) for p in c]) for k, c in enumerate(chains)]
    df = spark.createDataFrame(rows, "key long, id long, chain array<struct<x:double,y:double,z:double>>")
    for key, id_, cost in PG.medoids(df, "key", block=3).collect():
        sums = {k: sum(shapes.dtw_cost(chains[k], chains[j]) for j in range(key, 23, 2) if j != k) for k in range(key, 23, 2)}
        assert id_ == min(sums, key=sums.get) and cost == pytest.approx(sums[id_])


def test_crossings_counted_by_blocks(spark):
    import numpy as np

    from globeframe.kernels import predicates as P
    from globeframe.operators import spatial_join as J

    p, edges = _edges(spark, 150)
    # Shared ends and an arc on another's circle are left to the exact test.
    p[0, 1], p[0, 3], p[1, 3] = p[1, 0], p[0, 2], p[1, 2]
    big = 1 << 40
    point = lambda v: dict(zip("xyz", map(float, v), strict=True))
    sql = "struct<x:double,y:double,z:double>"
    arcs = spark.createDataFrame([(big + k, point(p[0, k]), point(p[1, k])) for k in range(150)], f"id long, a {sql}, b {sql}")
    hit = np.triu(P.crossing(p[0][:, None], p[1][:, None], p[0][None], p[1][None]) > 0, 1)
    want = {big + i: (int(hit[i].sum()), int((hit[i] * (big + np.arange(150))).sum())) for i in range(150) if hit[i].any()}
    for block in (20, 1000):
        assert {r.left_id: (r.n, r.right_ids) for r in J.crossing_counts(arcs, block).collect()} == want


def _simplified_plainly(chain, tolerance):
    # One vertex after the other, as the rule reads.
    import numpy as np

    from globeframe.kernels import predicates as P
    from globeframe.kernels import shapes

    out, i = [0] if len(chain) else [], 0
    while i < len(chain) - 1:
        window, best, far = shapes.Window(chain[i]), i + 1, 0.0
        for k in range(i + 1, len(chain)):
            away = float(shapes.angle(chain[i], chain[k]))
            if away > np.pi / 2 or away < far - tolerance:
                break
            if window.reaches(chain[k]) and (P.segment_distance(chain[i + 1 : k], chain[i], chain[k]) <= tolerance).all():
                best = k
            far = max(far, away)
            if not window.target(chain[k], tolerance):
                break
        out.append(best)
        i = best
    return out


def test_simplification_of_many_chains_at_once():
    import numpy as np

    from globeframe.kernels import grid, shapes

    rng = np.random.default_rng(11)
    draw = lambda n: grid.unit(rng.normal(size=(n, 3)))
    t = np.cumsum(rng.uniform(-0.005, 0.01, 150))
    noisy = grid.unit(np.stack([np.cos(t), np.sin(t), 0.05 * rng.normal(size=150)], -1))
    lat, lng = np.radians(rng.integers(-3, 4, (2, 60)) * 10)
    lattice = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], -1)
    walk = grid.unit(np.cumsum(0.02 * rng.normal(size=(120, 3)), 0) + draw(1))
    chains = [draw(80), draw(0), draw(1), draw(2), noisy, lattice, walk, np.repeat(draw(10), 3, 0), np.repeat(draw(1), 30, 0), np.stack([walk, -walk], 1).reshape(-1, 3)]
    for tolerance in (0.0, 0.005, 0.05, 0.3, 2.0):
        want = [_simplified_plainly(c, tolerance) for c in chains]
        for options in ({}, {"ahead": 1, "block": 7}):
            assert [k.tolist() for k in shapes.simplify_chains(chains, tolerance, **options)] == want


def test_work_of_simplification(monkeypatch):
    import numpy as np

    from globeframe.kernels import grid, shapes

    done: list = []
    plain = shapes.P.segment_distance
    monkeypatch.setattr(shapes.P, "segment_distance", lambda x, a, b: done.append(len(x)) or plain(x, a, b))
    t = np.linspace(0, 1.5, 1500)
    arc = np.stack([np.cos(t), np.sin(t), 0 * t], -1)
    # Along one arc the vertices between are compared once, not once for each end.
    assert shapes.simplify(arc, 1e-6) == [0, 1499] and sum(done) < 10 * len(arc)
    done.clear()
    rng = np.random.default_rng(12)
    assert len(shapes.simplify_chains([grid.unit(rng.normal(size=(60, 3))) for _ in range(500)], 0.3)) == 500
    assert len(done) < 100


def test_simplified_chains_column(spark):
    import numpy as np

    from globeframe.kernels import grid
    from globeframe.operators import geometry as G
    from globeframe.operators import polygons as PG

    rng = np.random.default_rng(13)
    chains = [grid.unit(rng.normal(size=(n, 3))) for n in (0, 1, 2, 50)]
    df = spark.createDataFrame([(-1, None), *((k, G.structs(c)) for k, c in enumerate(chains))], f"id int, chain {G.CHAIN_SQL}").coalesce(1)
    got = {r.id: r.kept for r in PG.with_simplified(df, 0.3).collect()}
    assert got == {-1: None} | {k: _simplified_plainly(c, 0.3) for k, c in enumerate(chains)}
    assert PG.with_simplified(df.filter("id > 9"), 0.3).collect() == []
