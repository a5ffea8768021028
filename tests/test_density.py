"""Walks over density trees: clusters, partitions and dilation on small trees."""

import pytest

from globeframe.kernels import density as D
from globeframe.operators import density
from globeframe.plans import catalogue

FACE = [(f << 61) | (1 << 60) for f in range(6)]


def child(cell, k):
    low = (cell & -cell) >> 2
    return cell + (2 * k - 3) * low


def tree(leaves):
    total = {}
    for cell, w in leaves:
        while True:
            total[cell] = total.get(cell, 0) + w
            if D.is_face(cell):
                break
            cell = D.parent(cell)
    return D.Tree(total.keys(), total.values())


def test_faces_are_clusters():
    t = tree([(f, 100) for f in FACE])
    assert [(w, b, e) for b, e, w in D.clusters(t, 80, 120)] == [(100, D.first_leaf(f), D.after(f)) if k else (100, D.START, D.after(f)) for k, f in enumerate(FACE)]
    assert len(D.clusters(t, 160, 240)) == 3


def test_clusters_divide_faces():
    a, b = FACE[0], FACE[1]
    c = child(b, 0)
    t = tree([(child(a, 1), 50), (child(a, 2), 50), (child(c, 0), 25), (child(c, 1), 25), (child(c, 2), 25), (child(child(b, 2), 0), 25)])
    found = D.clusters(t, 40, 60)
    assert [w for _, _, w in found] == [50, 50, 50, 50]
    assert found[0][1] == D.after(child(a, 1)) and found[1][1] == D.after(child(a, 2)) and found[2][1] == D.after(child(c, 1))


def test_heavy_leaf_is_cut():
    t = tree([(FACE[2], 1000)])
    found = D.clusters(t, 80, 120)
    assert [w for _, _, w in found] == [100] * 10
    assert all(e == b2 for (_, e, _), (b2, _, _) in zip(found, found[1:]))
    length = D.after(FACE[2]) - D.first_leaf(FACE[2])
    assert abs((found[3][1] - D.first_leaf(FACE[2])) / length - 0.4) < 1e-9
    with pytest.raises(ValueError):
        D.clusters(t, 0, 10)


def test_partition_rules():
    # Light siblings make way for their parent; heavy ones stay apart and close parts.
    a = FACE[0]
    light = tree([(child(a, k), 2) for k in range(4)] + [(FACE[1], 90)])
    assert D.partition(light, 100) == [(a, 8, 0), (FACE[1], 90, 0)]
    heavy = tree([(child(a, k), 60) for k in range(4)])
    assert D.partition(heavy, 100) == [(child(a, k), 60, k) for k in range(4)]
    # A split that gives every child its parent's whole weight is none.
    same = D.Tree([a, child(a, 0), child(a, 1)], [30, 30, 30])
    assert D.partition(same, 100) == [(a, 30, 0)]


def test_dilation_rings_a_leaf():
    leaf = child(child(FACE[0], 2), 0)
    out = D.dilate(tree([(leaf, 7)]), 4, 2)
    assert out[leaf] == 7 and set(out.values()) == {7}
    ring = [c for c in out if D.level(c) == 4]
    assert len(ring) == 4 * 4 + 4
    assert all(not (D.first_leaf(leaf) <= c < D.after(leaf)) for c in ring)
    assert D.dilate(D.Tree([], []), 4, 2) == {}


def test_on_tables(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    t = catalogue._cells(spark, sf).withColumnRenamed("cell", "leaf")
    total = t.count()
    parts = catalogue.QUERIES["density_partition"](spark, sf).collect()
    assert sum(r.weight for r in parts) == total
    by = {}
    for r in parts:
        by.setdefault(r.part, []).append(r.weight)
    assert all(sum(w) < 40 or len(w) == 1 for w in by.values())
    runs = catalogue.QUERIES["density_clusters"](spark, sf).orderBy("cluster").collect()
    assert all(a.end == b.begin for a, b in zip(runs, runs[1:]))
    assert all(80 <= r.weight <= 120 for r in runs[:-1])
    with pytest.raises(ValueError):
        old, density.MAX_CELLS = density.MAX_CELLS, 3
        try:
            density.partition(density.tree(t, 4), 40)
        finally:
            density.MAX_CELLS = old
