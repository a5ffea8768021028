"""Queries of cell steps, positions out of range, and distances of cells and rectangles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import cells as C
from ..functions import regions as R
from ..functions import vectors as V
from ..operators import geometry as G
from ..sources import derived
from .catalogue import CHORD, CUSTOMERS, EVENTS, LAT_GAP, LNG_GAP, PAIRS, ZONES, _cells, _customers, _pairs, _r, _wrap, cells_sql, corners_sql, query, segment_sql, shifted_sql, signed, unsigned, up


@query(f"""SELECT id, lat * 2 BETWEEN -90 AND 90 AND lng * 3 BETWEEN -180 AND 180 AS valid, round(greatest(-90, least(90, lat * 2)), 7) AS lat,
  round(lng * 3 - round(lng * 3 / 360) * 360, 7) + 0.0 AS lng FROM {CUSTOMERS}""")
def latlng_normalized(spark, d):
    lat, lng = A.latlng_normalized(F.radians(F.col("lat") * 2), F.radians(F.col("lng") * 3))
    valid = A.latlng_is_valid(F.radians(F.col("lat") * 2), F.radians(F.col("lng") * 3))
    return _customers(spark, d).select("id", valid.alias("valid"), _r(F.degrees(lat), 7).alias("lat"), (_r(F.degrees(lng), 7) + 0.0).alias("lng"))


@query(f"""SELECT id, CASE WHEN c < 0 THEN 0 WHEN c >= 4 THEN 'Infinity'::DOUBLE ELSE c + e END AS up, CASE WHEN c <= 0 THEN -1 WHEN c > 4 THEN 4 ELSE c - (CASE WHEN c = b THEN e / 2 ELSE e END) END AS down
FROM (SELECT *, power(2, floor(log2(greatest(c, 1e-300))))::DOUBLE AS b, power(2, floor(log2(greatest(c, 1e-300))) - 52)::DOUBLE AS e FROM (SELECT id, CASE id % 8 WHEN 0 THEN -1 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 'Infinity'::DOUBLE ELSE (id % 997 + 1) / 256.0::DOUBLE END::DOUBLE AS c FROM {CUSTOMERS}))""")
def chord_neighbors(spark, d):
    k = F.col("id") % 8
    c = F.when(k == 0, -1.0).when(k == 1, 4.0).when(k == 2, 1.0).when(k == 3, math.inf).otherwise((F.col("id") % 997 + 1) / 256)
    return _customers(spark, d).select("id", c.alias("c")).select("id", A.chord_successor("c").alias("up"), A.chord_predecessor("c").alias("down"))


_AT9 = unsigned(up("cell", 9))
_LSB9 = f"{1 << 42}"
_STEP = "((id * 7919) % 4000000 - 2000000)"


@query(f"""SELECT id, {signed(f"(greatest(0, least(1572864, n + {_STEP})) * 8796093022208::HUGEINT + {_LSB9})")} AS clamped, {signed(f"((((n + {_STEP}) % 1572864 + 1572864) % 1572864) * 8796093022208::HUGEINT + {_LSB9})")} AS wrapped,
  {signed(f"(((n + 1) % 1572864) * 8796093022208::HUGEINT + {_LSB9})")} AS following, {signed(f"(((n + 1572863) % 1572864) * 8796093022208::HUGEINT + {_LSB9})")} AS before
FROM (SELECT id, ({_AT9} // 8796093022208)::BIGINT AS n FROM {cells_sql(CUSTOMERS)})""")
def cell_advance(spark, d):
    step = F.pmod(F.col("id") * 7919, F.lit(4000000)) - 2000000
    df = _cells(spark, d, 9)
    return df.select("id", C.advance("cell", step).alias("clamped"), C.advance_wrap("cell", step).alias("wrapped"), C.next_wrap("cell").alias("following"), C.previous_wrap("cell").alias("before"))


@query(f"""SELECT id, face, {up('cell', 0)} AS whole, cell AS leaf, {up('cell', 11)} AS at11, (SELECT {1 << 60}::BIGINT >> 22) AS first, cell AS parsed FROM {cells_sql(CUSTOMERS)}""")
def cell_builders(spark, d):
    df = C.with_cell(_customers(spark, d), "p", "cell", 30, keep_ij=True)
    first = C.begin(11)
    return df.select(
        "id",
        F.col("cell_face").cast("long").alias("face"),
        C.from_face("cell_face").alias("whole"),
        C.from_face_ij("cell_face", "cell_i", "cell_j").alias("leaf"),
        C.from_face_pos_level("cell_face", C.position("cell"), 11).alias("at11"),
        first.alias("first"),
        C.from_debug_string(C.debug_string("cell")).alias("parsed"),
    )


def _tile_levels() -> str:
    low = f"({unsigned(up('cell', 12))} - {(1 << 36) - 1})"
    stop = f"({unsigned(up('other', 5))} - {(1 << 50) - 1})"
    fits = ", ".join(f"CASE WHEN ({low} - 1) % {2 << (2 * (30 - k))}::HUGEINT = 0 AND {low} + {(2 << (2 * (30 - k))) - 2}::HUGEINT < {stop} THEN {low} + {(1 << (2 * (30 - k))) - 1}::HUGEINT END" for k in range(31))
    return f"CASE WHEN {low} >= {stop} THEN {up('other', 5)} ELSE {signed(f'coalesce({fits})')} END"


@query(f"SELECT id, {_tile_levels()} AS tile FROM (SELECT id, cell, nat FROM {cells_sql(f'(SELECT *, c_nationkey AS nat FROM {CUSTOMERS})', 'nat')}) a JOIN (SELECT id AS nat, cell AS other FROM {cells_sql(ZONES)}) b USING (nat)")
def cell_maximum_tile(spark, d):
    a = _cells(spark, d, 12).select("id", "c_nationkey", "cell")
    b = C.with_cell(derived.zones(spark, d), "p", "other", 5).select(F.col("id").alias("c_nationkey"), "other")
    return a.join(b, "c_nationkey").select("id", C.maximum_tile("cell", "other").alias("tile"))


_B = {"u_lo": ("0", "u"), "u_hi": ("1", "u"), "v_lo": ("0", "v"), "v_hi": ("1", "v")}
_LOW, _HIGH = shifted_sql(6, "0", "0"), shifted_sql(6, "1", "1")


@query(f"""SELECT a.id AS id, round(a.u, 10) AS u_lo, round(b.u, 10) AS u_hi, round(a.v, 10) AS v_lo, round(b.v, 10) AS v_hi, round(tan(atan(a.u) - asin(sin(0.01) * sqrt((1+a.u*a.u+w.v*w.v)/(1+a.u*a.u)))), 9) AS grown
FROM {_LOW} a JOIN {_HIGH} b ON a.id = b.id, LATERAL (SELECT greatest(abs(a.v), abs(b.v)) AS v) w""")
def cell_bound_uv(spark, d):
    df = _cells(spark, d, 6).select("id", C.bound_uv("cell").alias("b"))
    df = df.withColumn("g", C.expanded_by_distance_uv("b", 0.01))
    return df.select("id", *(_r(F.col("b")[k], 10).alias(k) for k in _B), _r(F.col("g")["u_lo"], 9).alias("grown"))


@query(f"SELECT id, face::INTEGER AS face, (2 * (i // 65536) + 1) * 65536 AS si, (2 * (j // 65536) + 1) * 65536 AS ti FROM {cells_sql(CUSTOMERS)}")
def cell_center_si_ti(spark, d):
    return _cells(spark, d, 14).select("id", C.center_si_ti("cell").alias("c")).select("id", "c.face", "c.si", "c.ti")


# Distances of each customer's cell of level 4 to its nation's centre.

_P = "{'x': x, 'y': y, 'z': z}"
_CORNERS = corners_sql(4)
_SIDES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
_NEAREST = "least(" + ", ".join(segment_sql("q", f"k.{x}", f"k.{y}") for x, y in _SIDES) + ")"
_TURNED = "least(" + ", ".join(segment_sql("o", f"k.{x}", f"k.{y}") for x, y in _SIDES) + ")"
_FAR = "greatest(" + ", ".join(f"(power(q.x-k.{x}.x,2)+power(q.y-k.{x}.y,2)+power(q.z-k.{x}.z,2))" for x in "abcd") + ")"
_OWN = f"(SELECT id, {up('cell', 4)} AS cell FROM {cells_sql(CUSTOMERS)})"


def _cell_of(sign: int) -> str:
    return f"(SELECT id, {up('cell', 4)} AS cell FROM {cells_sql(f'(SELECT id, {sign} * x AS x, {sign} * y AS y, {sign} * z AS z FROM {ZONES})')})"


@query(f"""SELECT k.id AS id, round(CASE WHEN s.cell = zc.cell THEN 0 ELSE near END, 7) AS near, round(near, 7) AS border,
  round(CASE WHEN far <= 2 THEN 2*asin(sqrt(far)/2) ELSE pi() - CASE WHEN s.cell = oc.cell THEN 0 ELSE turned END END, 7) AS far
FROM (SELECT k.id, nat, {_NEAREST} AS near, {_TURNED} AS turned, {_FAR} AS far FROM {_CORNERS} k JOIN (SELECT c_custkey AS id, c_nationkey AS nat FROM customer) n USING (id)
  JOIN (SELECT id AS nat, {_P} AS q, {{'x': -x, 'y': -y, 'z': -z}} AS o FROM {ZONES}) z USING (nat)) k
JOIN {_OWN} s ON s.id = k.id JOIN {_cell_of(1)} zc ON zc.id = k.nat JOIN {_cell_of(-1)} oc ON oc.id = k.nat""")
def cell_point_distances(spark, d):
    cells = C.with_cell(_pairs(spark, d), "p", "cell", 4).select("id", "cell", "q")
    for kind, name in (("point", "near"), ("border", "border"), ("max_point", "far")):
        cells = G.with_cell_distance(cells, kind, "cell", "q", name=name)
    return cells.select("id", *(_r(n, 7).alias(n) for n in ("near", "border", "far")))


@query(f"""SELECT a.id AS id, round(radians(CASE WHEN {LNG_GAP} <= 15 THEN greatest(0, round({LAT_GAP} - 15, 6)) ELSE NULL END), 8) AS straight FROM {PAIRS}""")
def rect_distance_straight(spark, d):
    # Rectangles whose longitudes meet: the gap of the latitudes; others are tested by points.
    box = lambda la, ln, s: R.rect_from_degrees(F.greatest(F.lit(-90.0), F.col(la) - s), _wrap(F.col(ln) - s), F.least(F.lit(90.0), F.col(la) + s), _wrap(F.col(ln) + s))
    df = _pairs(spark, d).select("id", "lng", "zlng", box("lat", "lng", 10).alias("a"), box("zlat", "zlng", 5 + 1e-9).alias("b"))
    df = G.with_rect_distance(df, "a", "b")
    apart = F.abs(F.pmod(F.col("lng") - F.col("zlng") + 540, F.lit(360.0)) - 180)
    return df.select("id", F.when(F.round(apart, 6) <= 15, _r(F.greatest(F.col("radians"), F.lit(0.0)), 8)).alias("straight"))


_ARCS = f"(SELECT user_id, id, lat, lng, x, y, z, lead(lat) OVER w AS lat2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))"


@query(f"""WITH n AS (SELECT *, y*z2-z*y2 AS nx, z*x2-x*z2 AS ny, x*y2-y*x2 AS nz FROM {_ARCS}), u AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM n),
t AS (SELECT *, acos(least(1, abs(nz)/l)) AS top, ((ny*z-nz*y)*(-nx*nz)+(nz*x-nx*z)*(-ny*nz)+(nx*y-ny*x)*(l*l-nz*nz)) AS s1, ((y2*nz-z2*ny)*(-nx*nz)+(z2*nx-x2*nz)*(-ny*nz)+(x2*ny-y2*nx)*(l*l-nz*nz)) AS s2 FROM u)
SELECT user_id, round(greatest(max(radians(lat)), coalesce(max(CASE WHEN s1 > 0 AND s2 > 0 THEN top END), -9)), 7) AS lat_hi, round(least(min(radians(lat)), coalesce(min(CASE WHEN s1 < 0 AND s2 < 0 THEN -top END), 9)), 7) AS lat_lo FROM t GROUP BY user_id""")
def chain_bounds(spark, d):
    df = G.with_chain_rect(derived.tracks(spark, d))
    return df.select("user_id", _r("bound.lat_hi", 7).alias("lat_hi"), _r("bound.lat_lo", 7).alias("lat_lo"))


_HALF = "CASE WHEN abs(lat {0} 5) + degrees(d) >= 90 THEN 9 ELSE asin(least(1, sin(d) / cos(radians(lat {0} 5)))) END"


@query(f"""SELECT id, round(greatest(-pi()/2, radians(lat - 5) - d), 8) AS lat_lo, round(least(pi()/2, radians(lat + 5) + d), 8) AS lat_hi,
  round(least(2*pi(), radians(10) + 2 * greatest({_HALF.format('-')}, {_HALF.format('+')})), 7) AS width FROM (SELECT *, (id % 7) / 50.0::DOUBLE AS d FROM {CUSTOMERS})""")
def rect_expanded(spark, d):
    box = R.rect_from_degrees(F.col("lat") - 5, _wrap(F.col("lng") - 5), F.col("lat") + 5, _wrap(F.col("lng") + 5))
    df = _customers(spark, d).select("id", box.alias("r"), (F.col("id") % 7 / 50).alias("d"))
    df = G.with_rect_expanded(df, "r", "d")
    e = F.col("expanded")
    width = F.when(e["lng_hi"] - e["lng_lo"] >= 2 * math.pi, 2 * math.pi).otherwise(F.pmod(e["lng_hi"] - e["lng_lo"], F.lit(2 * math.pi)))
    return df.select("id", _r(e["lat_lo"], 8).alias("lat_lo"), _r(e["lat_hi"], 8).alias("lat_hi"), _r(width, 7).alias("width"))


_IN_CAP = f"{CHORD} <= power(2*sin(0.6/2),2)"
_IN_RECT = f"({LAT_GAP} <= 20 AND {LNG_GAP} <= 40)"


@query(f"""SELECT a.id AS id, {up('c.cell', 1)} = {up('z.cell', 1)} AS in_cell, {up('c.cell', 1)} IN ({up('z.cell', 1)}, {up('o.cell', 1)}) AS in_union, {_IN_CAP} OR {_IN_RECT} AS in_either, {_IN_CAP} AND {_IN_RECT} AS in_both, a.x = b.x AND a.y = b.y AND a.z = b.z AS is_it
FROM {PAIRS} JOIN {cells_sql(CUSTOMERS)} c ON c.id = a.id JOIN {cells_sql(ZONES)} z ON z.id = b.id JOIN {cells_sql(f"(SELECT id, -x AS x, -y AS y, -z AS z FROM {ZONES})")} o ON o.id = b.id""")
def region_predicates(spark, d):
    # A cell, a union of two, a disc or a rectangle, both of them, and a point, for each pair.
    df = C.with_cell(C.with_cell(_pairs(spark, d), "p", "leaf"), "q", "one", 1)
    df = C.with_cell(df.withColumn("far", V.scale("q", -1.0)), "far", "two", 1).withColumn("cells", F.array("one", "two"))
    cap = R.cap_contains(R.cap("q", 0.6), "p")
    box = R.rect_from_degrees(F.col("zlat") - 20.000001, _wrap(F.col("zlng") - 40.000001), F.col("zlat") + 20.000001, _wrap(F.col("zlng") + 40.000001))
    rect = R.rect_contains(box, F.radians("lat"), F.radians("lng"))
    return df.select(
        "id",
        C.contains("one", "leaf").alias("in_cell"),
        F.exists("cells", lambda c: C.contains(c, F.col("leaf"))).alias("in_union"),
        (cap | rect).alias("in_either"),
        (cap & rect).alias("in_both"),
        (F.col("p") == F.col("q")).alias("is_it"),
    )
