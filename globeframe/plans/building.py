"""Queries of edge predicates, snapped shapes, operations on several dimensions, conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import earth as E
from ..functions import vectors as V
from ..kernels.builder import Options
from ..operators import building as B
from ..operators import geometry as G
from ..sources import derived
from .catalogue import _HEX, CUSTOMERS, PAIRS, ZONES, _customers, _pairs, _polygons, _r, corner, det, far_sql, query, ring_sql, shifted_sql, sides_sql, xyz_sql

_P = "{'x': x, 'y': y, 'z': z}"
_FAR = far_sql("0.3")


def _arcs(spark, d):
    """Each customer p, its nation's centre q, and a point r beside that."""
    far = derived.zones(spark, d).select(F.col("id").alias("c_nationkey"), V.normalize(V.add("p", V.scale(V.ortho("p"), 0.3))).alias("r"))
    return _pairs(spark, d).join(far, "c_nationkey").select("id", "p", "q", "r")


_THREE = f"(SELECT a.id, {{'x': a.x, 'y': a.y, 'z': a.z}} AS p, {{'x': b.x, 'y': b.y, 'z': b.z}} AS q, {{'x': c.x, 'y': c.y, 'z': c.z}} AS r FROM {PAIRS} JOIN {_FAR} c ON c.id = b.id)"


@query(f"""SELECT id, sign({det('p', 'q', 'r')})::INTEGER AS turn, sign(power(p.x-q.x,2)+power(p.y-q.y,2)+power(p.z-q.z,2)-power(p.x-r.x,2)-power(p.y-r.y,2)-power(p.z-r.z,2))::INTEGER AS nearer,
  sign(power(p.x-q.x,2)+power(p.y-q.y,2)+power(p.z-q.z,2)-1)::INTEGER AS beyond, sign(p.x*q.x+p.y*q.y+p.z*q.z)::INTEGER AS side FROM {_THREE}""")
def point_predicates(spark, d):
    df = _arcs(spark, d).withColumn("one", F.lit(1.0))
    df = B.with_predicate(B.with_predicate(df, "orientation", "p", "q", "r", name="turn"), "compare_distances", "p", "q", "r", name="nearer")
    df = B.with_predicate(B.with_predicate(df, "compare_distance", "p", "q", "one", name="beyond"), "sign_dot", "p", "q", name="side")
    return df.select("id", "turn", "nearer", "beyond", "side")


_MEET = f"""(SELECT a.id, a.p AS a, a.q AS b, c.p AS c, c.q AS d FROM {_THREE} a JOIN (SELECT id + 1 AS id, r AS p, {{'x': -q.x, 'y': -q.y, 'z': q.z}} AS q FROM {_THREE}) c USING (id))"""
_CROSSES = f"({det('a', 'b', 'c')} * {det('a', 'b', 'd')} < 0 AND {det('c', 'd', 'a')} * {det('c', 'd', 'b')} < 0 AND {det('a', 'b', 'c')} * {det('c', 'd', 'b')} > 0)"
_N1, _N2 = (f"{{'x': {u}.y*{v}.z-{u}.z*{v}.y, 'y': {u}.z*{v}.x-{u}.x*{v}.z, 'z': {u}.x*{v}.y-{u}.y*{v}.x}}" for u, v in (("a", "b"), ("c", "d")))


@query(f"""SELECT id, CASE WHEN hit THEN 1 ELSE -1 END::INTEGER AS crossing, CASE WHEN hit THEN round(g*x.x/l, 7) + 0.0 END AS x, CASE WHEN hit THEN round(g*x.z/l, 7) + 0.0 END AS z FROM (
  SELECT *, sqrt(x.x*x.x+x.y*x.y+x.z*x.z) AS l, CASE WHEN x.x*(a.x+b.x)+x.y*(a.y+b.y)+x.z*(a.z+b.z) < 0 THEN -1 ELSE 1 END AS g FROM (
  SELECT id, a, b, hit, {{'x': n1.y*n2.z-n1.z*n2.y, 'y': n1.z*n2.x-n1.x*n2.z, 'z': n1.x*n2.y-n1.y*n2.x}} AS x FROM (SELECT *, {_CROSSES} AS hit, {_N1} AS n1, {_N2} AS n2 FROM {_MEET})))""")
def arc_intersections(spark, d):
    arcs = _arcs(spark, d)
    q = F.col("q")
    other = arcs.select((F.col("id") + 1).alias("id"), F.col("r").alias("c"), V.vector(-q["x"], -q["y"], q["z"]).alias("d"))
    df = arcs.select("id", F.col("p").alias("a"), F.col("q").alias("b")).join(other, "id")
    df = B.with_intersection(B.with_predicate(df, "crossing", "a", "b", "c", "d"), "a", "b", "c", "d")
    return df.select("id", "crossing", (_r("meets.x", 7) + 0.0).alias("x"), (_r("meets.z", 7) + 0.0).alias("z"))


_SNAPPED = f"(SELECT a.id // 8 AS id, a.id % 8 AS k, {_P} AS p FROM {xyz_sql(shifted_sql(8, '0.5', '0.5').replace(CUSTOMERS, f'(SELECT id * 8 + k AS id, x, y, z FROM {_HEX})'))} a)"


@query(f"SELECT a.id AS id, round(sum(coalesce({corner('o.p', 'a.p', 'b.p')}, 0)), 8) AS area FROM {_SNAPPED} a JOIN {_SNAPPED} b ON a.id = b.id AND b.k = (a.k + 1) % 6 JOIN {_SNAPPED} o ON o.id = a.id AND o.k = 0 GROUP BY 1")
def snapped_polygons(spark, d):
    df = B.with_snapped_polygon(_polygons(spark, d), "rings", Options(snap=("cell", 8)))
    return G.with_polygon_area(df, "built").select(F.col("polygon_id").alias("id"), _r("area", 8).alias("area"))


@query(f"""SELECT c_nationkey::BIGINT AS nation, count(*) FILTER (held) AS inside, count(*) FILTER (NOT held) AS outside, count(*) FILTER (NOT held) AS more
FROM (SELECT c.id, c.c_nationkey, bool_and({det('s.a', 's.b', 'c.p')} > 0) AS held FROM (SELECT id, c_nationkey, {_P} AS p FROM {CUSTOMERS}) c JOIN {sides_sql(ring_sql(ZONES, 0.5, 8), 8)} s ON s.id = c.c_nationkey GROUP BY 1, 2) GROUP BY 1""")
def mixed_operations(spark, d):
    # The points of a nation against a polygon about its centre.
    points = _customers(spark, d).groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.collect_list("p").alias("points"))
    rings = _polygons(spark, d, 0.5, 8).select(F.col("polygon_id").alias("nation"), "rings")
    none = F.filter("points", lambda p: F.lit(False))
    df = points.join(rings, "nation").withColumns({"no_points": none, "no_chains": F.array(none), "no_rings": F.array(none)})
    a, b = ("points", "no_chains", "no_rings"), ("no_points", "no_chains", "rings")
    for op, name in (("intersection", "inside"), ("difference", "outside"), ("union", "more")):
        df = B.with_combined(df, a, b, op, name=name)
    return df.select("nation", *(F.size(F.col(c)["points"]).cast("long").alias(c) for c in ("inside", "outside", "more")))


@query(f"""SELECT id, round(lat, 5) AS e5, round(lat, 6) AS e6, round(lng, 7) AS e7, round(radians(abs(lat)) * 6371.01, 6) AS km, round(abs(lat) * 1000 / 6371010.0, 12) AS radians,
  round(power(sin(radians(lat) / 2), 2), 9) AS hav, round(2*pi()*(1-cos(radians(abs(lat)))) * 6371.01 * 6371.01, 3) AS km2 FROM {CUSTOMERS}""")
def conversions(spark, d):
    lat = F.radians("lat")
    df = _customers(spark, d)
    return df.select(
        "id",
        *(_r(F.degrees(A.from_e(A.to_e(F.radians(c), k), k)), k).alias(f"e{k}") for c, k in (("lat", 5), ("lat", 6), ("lng", 7))),
        _r(E.to_km(F.abs(lat)), 6).alias("km"),
        _r(E.from_meters(F.abs("lat") * 1000), 12).alias("radians"),
        _r(E.haversine(lat), 9).alias("hav"),
        _r(E.square_km(2 * F.pi() * (1 - F.cos(F.abs(lat)))), 3).alias("km2"),
    )


@query("""SELECT n_nationkey::BIGINT AS id, ['', 'inconsistent_orientation', 'rings_cross', 'duplicate_edges', 'edges_cross'][(n_nationkey % 5 + 1)::BIGINT] AS faults FROM nation""")
def polygon_sets_validate(spark, d):
    # A ring with a hole; the hole turned; a ring across it; the ring twice; a bow tie.
    z = G.with_regular_ring(G.with_regular_ring(derived.zones(spark, d), "p", 0.3, 8, "outer"), "p", 0.1, 6, "hole")
    far = z.withColumn("far", V.normalize(V.add("p", V.scale(V.ortho("p"), 0.3))))
    z = G.with_regular_ring(far, "far", 0.1, 7, "across")
    k, at = F.col("id") % 5, lambda *i: F.array(*(F.element_at("outer", j) for j in i))
    rings = F.when(k == 1, F.array("outer", "hole")).when(k == 2, F.array("outer", "across")).when(k == 3, F.array("outer", "outer")).when(k == 4, F.array(at(1, 5, 4, 8))).otherwise(F.array("outer", F.reverse("hole")))
    p = z.select("id", rings.alias("rings"))
    found = G.validate(p).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("faults"))
    return p.select("id").join(found, "id", "left").select("id", F.coalesce("faults", F.lit("")).alias("faults"))
