"""Queries on polygons, chains and unions of cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import polygons as PG
from ..sources import derived
from .catalogue import (
    _BIG,
    _COMMON,
    _HEX,
    _SMALL,
    CHORD,
    CUSTOMERS,
    EVENTS,
    ZONES,
    _cells,
    _pairs,
    _polygons,
    _r,
    _shifted_rings,
    cells_sql,
    crossings_sql,
    det,
    inside_sql,
    query,
    regular_area_sql,
    segment_sql,
    shifted_sql,
    sides_sql,
    up,
    xyz_sql,
)

_P = "{'x': x, 'y': y, 'z': z}"
_HEX_SIDES = sides_sql(_HEX, 6)


@query(f"""SELECT id, round(CASE WHEN held THEN 0 ELSE near END, 7) AS radians, round(near, 7) AS border FROM (SELECT c.id, bool_and({det('s.a', 's.b', 'c.p')} > 0) AS held, min({segment_sql('c.p', 's.a', 's.b')}) AS near
  FROM (SELECT id, c_nationkey, {_P} AS p FROM {CUSTOMERS}) c JOIN {_HEX_SIDES} s ON s.id = c.c_nationkey GROUP BY 1)""")
def polygon_distance(spark, d):
    rings = _polygons(spark, d).select(F.col("polygon_id").alias("c_nationkey"), "rings")
    df = _pairs(spark, d).select("id", "c_nationkey", "p").join(rings, "c_nationkey")
    df = PG.with_polygon_distance(PG.with_polygon_distance(df, "rings", "p"), "rings", "p", border=True, name="border")
    return df.select("id", _r("radians", 7).alias("radians"), _r("border", 7).alias("border"))


@query(f"""SELECT id, round(CASE WHEN held THEN 0 ELSE near END, 7) AS radians, true AS on_it FROM (SELECT c.id, bool_and({det('s.a', 's.b', 'c.p')} > 0) AS held, min({segment_sql('c.p', 's.a', 's.b')}) AS near
  FROM (SELECT id, c_nationkey, {_P} AS p FROM {CUSTOMERS}) c JOIN {_HEX_SIDES} s ON s.id = c.c_nationkey GROUP BY 1)""")
def polygon_projection(spark, d):
    rings = _polygons(spark, d).select(F.col("polygon_id").alias("c_nationkey"), "rings")
    df = _pairs(spark, d).select("id", "c_nationkey", "p").join(rings, "c_nationkey")
    df = PG.with_polygon_distance(PG.with_polygon_projection(df, "rings", "p"), "rings", "projected", border=False, name="off")
    return df.select("id", _r(V.angle("p", "projected"), 7).alias("radians"), (F.col("off") < 1e-12).alias("on_it"))


@query(f"SELECT id AS polygon_id, round(area / ({regular_area_sql(0.25, 8)}), 6) AS of_a, round(area / ({regular_area_sql(0.25, 7)}), 6) AS of_b FROM ({_COMMON})")
def polygon_overlap(spark, d):
    df = _polygons(spark, d, 0.25, 8).select("polygon_id", F.col("rings").alias("a")).join(_shifted_rings(spark, d, 0.2, 0.25, 7), "polygon_id")
    return PG.with_overlap(df, "a", "b").select("polygon_id", _r("overlap.of_a").alias("of_a"), _r("overlap.of_b").alias("of_b"))


@query(f"SELECT id AS polygon_id, round(4*pi() - ({regular_area_sql(0.25, 8)}), 7) AS outside, round({regular_area_sql(0.25, 8)} + {regular_area_sql(0.25, 7)} - 2*area, 7) AS either FROM ({_COMMON})")
def polygon_complement(spark, d):
    df = _polygons(spark, d, 0.25, 8).select("polygon_id", F.col("rings").alias("a")).join(_shifted_rings(spark, d, 0.2, 0.25, 7), "polygon_id")
    df = G.with_polygon_area(PG.with_complement(df, "a"), "complement", "outside")
    df = G.with_polygon_area(G.with_overlay(df, "a", "b", "symmetric_difference", "either_rings"), "either_rings", "either")
    return df.select("polygon_id", _r("outside", 7).alias("outside"), _r("either", 7).alias("either"))


def _set_of_rings(spark, d):
    """Three rings about each zone's centre, the inner ones of another order for odd zones, and one
    beside them; all counterclockwise."""
    z = derived.zones(spark, d)
    for name, r in (("r1", 0.3), ("r2", 0.2), ("r3", 0.1)):
        z = G.with_regular_ring(z, "p", r, 8, name)
    far = z.withColumn("far", V.normalize(V.add("p", V.scale(V.ortho("p"), 0.6))))
    z = G.with_regular_ring(far, "far", 0.1, 5, "beside")
    odd = F.col("id") % 2 == 1
    return z.select("id", F.when(odd, F.array("r3", "beside", "r1", "r2")).otherwise(F.array("r1", "r2", "r3", "beside")).alias("rings"))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 1 THEN '3:2 -1:0 -1:0 2:1' ELSE '-1:0 0:1 1:2 -1:0' END AS nesting, CASE WHEN n_nationkey % 2 = 1 THEN '0 1 2,3' ELSE '0,1 2 3' END AS polygons FROM nation")
def ring_nesting(spark, d):
    df = PG.with_groups(PG.with_nesting(_set_of_rings(spark, d)))
    shown = F.array_join(F.transform("nesting", lambda n: F.concat_ws(":", n["parent"].cast("string"), n["depth"].cast("string"))), " ")
    return df.select("id", shown.alias("nesting"), F.array_join(F.transform("groups", lambda g: F.array_join(g.cast("array<string>"), ",")), " ").alias("polygons"))


@query(f"SELECT id, round({regular_area_sql(0.3, 8)} - {regular_area_sql(0.2, 8)} + {regular_area_sql(0.1, 8)} + {regular_area_sql(0.1, 5)}, 8) AS area FROM {ZONES}")
def ring_orientation(spark, d):
    return G.with_polygon_area(PG.with_oriented(_set_of_rings(spark, d)), "oriented").select("id", _r("area", 8).alias("area"))


@query(f"""WITH held AS ({inside_sql(_SMALL, _BIG, 8)}), cut AS ({crossings_sql(_BIG, 8, _SMALL, 5)})
SELECT id, CASE WHEN n.c > 0 THEN 0 WHEN n.h = 5 THEN 1 ELSE -1 END::INTEGER AS border, n.h = 5 AND n.c = 0 AS contains, n.h + n.c > 0 AS intersects, false AS equal
FROM (SELECT id, (SELECT count(*) FROM held WHERE held.id = z.id) AS h, (SELECT count(*) FROM cut WHERE cut.id = z.id) AS c FROM {ZONES} z) n""")
def ring_relations(spark, d):
    by = (F.col("id") % 4) * 0.1
    df = G.with_regular_ring(derived.zones(spark, d), "p", 0.25, 8, "a").join(_shifted_rings(spark, d, by, 0.1, 5).select(F.col("polygon_id").alias("id"), F.element_at("b", 1).alias("b")), "id")
    return PG.with_ring_relation(df, "a", "b").select("id", "relation.*")


@query(f"""SELECT polygon_id, round({regular_area_sql(0.25, 8)} + {regular_area_sql(0.25, 7)} - area, 6) AS positive, round({regular_area_sql(0.25, 8)} + {regular_area_sql(0.25, 7)} - 2*area, 6) AS odd, 0 AS negative FROM (SELECT id AS polygon_id, area FROM ({_COMMON}))""")
def winding_rules(spark, d):
    df = _polygons(spark, d, 0.25, 8).select("polygon_id", F.col("rings").alias("a")).join(_shifted_rings(spark, d, 0.2, 0.25, 7), "polygon_id")
    df = df.select("polygon_id", F.concat("a", "b").alias("rings"))
    for rule in ("positive", "odd", "negative"):
        df = G.with_polygon_area(PG.with_wound(df, "rings", rule, rule), rule, f"{rule}_area")
    return df.select("polygon_id", _r("positive_area").alias("positive"), _r("odd_area").alias("odd"), _r("negative_area").cast("int").alias("negative"))


@query(f"SELECT user_id, n, true AS whole FROM (SELECT user_id, count(*) - 1 AS n FROM {EVENTS} GROUP BY 1)")
def chain_in_polygon(spark, d):
    # What lies inside and outside of a zone adds up to the whole track.
    rings = _polygons(spark, d, 0.5, 8).select(F.col("polygon_id").alias("k"), "rings")
    t = derived.tracks(spark, d).withColumn("k", F.col("user_id") % 25).join(rings, "k")
    t = PG.with_chain_parts(PG.with_chain_parts(t, "chain", "rings", True, "inner"), "chain", "rings", False, "outer")
    length = lambda c: F.aggregate(F.transform(c, _chain_length), F.lit(0.0), lambda s, x: s + x)
    whole = F.abs(length("inner") + length("outer") - _chain_length(F.col("chain"))) < 1e-9
    return t.select("user_id", (F.size("chain") - 1).cast("long").alias("n"), whole.alias("whole"))


def _chain_length(c):
    from ..operators.aggregates import chain_length

    return chain_length(c)


@query()
def buffers(spark, d):
    z = G.with_regular_ring(derived.zones(spark, d), "p", 0.15, 6).withColumns({"rings": F.array("ring"), "points": F.array("p", V.normalize(V.add("p", V.scale(V.ortho("p"), 0.05))))})
    df = PG.with_buffered(PG.with_buffered(z, "rings", 0.05, "polygon", name="grown"), "rings", -0.03, "polygon", name="shrunk")
    df = PG.with_buffered(df, "points", 0.04, "points", name="discs")
    for c in ("grown", "shrunk", "discs"):
        df = G.with_polygon_area(df, c, f"{c}_area")
    return df.select("id", *(_r(f"{c}_area", 8).alias(c) for c in ("grown", "shrunk", "discs")))


@query(f"SELECT r_regionkey::BIGINT AS region, round(count(*) * ({regular_area_sql(0.02, 6)}), 8) AS area FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def polygon_union_all(spark, d):
    # Small rings lie apart; each is there twice, and the second changes nothing.
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("polygon_id"), F.col("n_regionkey").cast("long").alias("region"))
    df = _polygons(spark, d, 0.02, 6).join(nation, "polygon_id").select("region", "rings")
    return G.with_polygon_area(PG.union_all(df.unionAll(df), "region")).select("region", _r("area", 8).alias("area"))


@query(f"SELECT c_nationkey, (count(DISTINCT {up('cell', 6)}) * {4**24}::HUGEINT)::BIGINT AS leaves FROM {cells_sql(CUSTOMERS, 'c_nationkey')} GROUP BY 1")
def cell_union_agg(spark, d):
    out = PG.cell_union(_cells(spark, d, 6).select("c_nationkey", "cell"), "c_nationkey")
    return out.select("c_nationkey", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + C.lsb(c)).alias("leaves"))


@query(f"SELECT user_id, least(50, count(*) - 1) AS edges, least(50, count(*)) AS vertices FROM {EVENTS} GROUP BY 1 HAVING count(*) > 1")
def shape_counts(spark, d):
    edges = derived.edges(spark, d).select(F.col("user_id").alias("shape_id"), "a", "b")
    return PG.shape_counts(edges, 50).select(F.col("shape_id").alias("user_id"), "edges", "vertices")


@query(f"SELECT a.id AS id, round(a.x, 9) + 0.0 AS x, round(a.y, 9) + 0.0 AS y, round(a.z, 9) + 0.0 AS z, round(c.lat + 0.003, 0) AS lat, round(c.lng + 0.003, 0) AS lng FROM {xyz_sql(shifted_sql(8, '0.5', '0.5'))} a JOIN {CUSTOMERS} c ON a.id = c.id")
def snapping(spark, d):
    df = PG.snap_to_cell(derived.customers(spark, d), "p", 8).withColumn("near", V.from_degrees(F.col("lat") + 0.003, F.col("lng") + 0.003)).withColumn("whole", PG.snap_to_degrees("near", 0))
    out = df.select("id", *(_r(F.col("snapped")[c], 9).alias(c) for c in "xyz"), _r(F.degrees(V.latitude("whole")), 7).alias("lat"), _r(F.degrees(V.longitude("whole")), 7).alias("lng"))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("x", "y", "z")})


@query(f"SELECT b.id AS key, count(*) AS n FROM {CUSTOMERS} a JOIN {ZONES} b ON {CHORD} <= power(2*sin(0.1),2) GROUP BY 1")
def covering_members(spark, d):
    # A disc's points by its covering, bound, fast and simple coverings: each must hold them all.
    z = derived.zones(spark, d).withColumn("r", F.lit(0.2))
    z = G.with_covering(z, "cap", ["p", "r"], "c0", max_cells=12)
    for k, (kind, options) in enumerate((("bound", {}), ("fast", {}), ("simple", {"level": 4})), 1):
        z = PG.with_other_covering(z, kind, "cap", ["p", "r"], f"c{k}", **options)
    points = _cells(spark, d).select("id", "p", F.col("cell").alias("leaf"))
    centre = z.select(F.col("id").alias("key"), F.col("p").alias("q"))
    counts = None
    for k in range(4):
        held = PG.members(points, z.select(F.col("id").alias("key"), F.col(f"c{k}").alias("cells")))
        held = held.join(centre, "key").filter(V.chord2("p", "q") <= 4 * math.sin(0.1) ** 2)
        n = held.groupBy("key").agg(F.count("*").alias(f"n{k}"))
        counts = n if counts is None else counts.join(n, "key", "full")
    return counts.select("key", F.least(*(F.coalesce(f"n{k}", F.lit(0)) for k in range(4))).alias("n"))


@query()
def track_medoids(spark, d):
    t = derived.tracks(spark, d).select((F.col("user_id") % 5).alias("key"), F.col("user_id").alias("id"), "chain")
    return PG.medoids(t, "key").select("key", "id", _r("cost", 6).alias("cost"))


@query()
def track_tessellation(spark, d):
    t = PG.with_tessellated(derived.tracks(spark, d), tolerance=0.01)
    return t.select("user_id", F.size("chain").alias("vertices"), F.size("plane").alias("plane"))


@query()
def chain_simplified(spark, d):
    t = PG.with_simplified(derived.tracks(spark, d), 0.3)
    return t.select("user_id", F.size("chain").alias("n"), F.size("kept").alias("kept"))
