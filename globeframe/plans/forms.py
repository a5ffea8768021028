"""Queries of byte forms, text forms and plain coordinates."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import geometry as G
from ..sources import derived, forms
from .catalogue import _HEX, CUSTOMERS, EVENTS, ZONES, _cells, _customers, _r, cells_sql, query, unsigned

_HEXED = f"lpad(lower(to_hex({unsigned('cell')}::UBIGINT)), 16, '0')"
_SWAPPED = " || ".join(f"substr({_HEXED}, {k}, 2)" for k in range(15, 0, -2))


@query(f"SELECT id, {_SWAPPED} AS bytes, true AS same FROM {cells_sql(CUSTOMERS)}")
def cell_bytes(spark, d):
    df = forms.with_decoded(forms.with_encoded(_cells(spark, d).select("id", "cell"), "cell_id", "cell"), "cell_id", "bytes")
    return df.select("id", F.lower(F.hex("bytes")).alias("bytes"), (F.col("value") == F.col("cell")).alias("same"))


@query(f"""SELECT user_id, 5 + 24 * n AS polyline, 24 * n + CASE WHEN n < 16 THEN 1 ELSE 2 END AS points, 24 * n + CASE WHEN n < 16 THEN 3 ELSE 4 END AS lax, true AS same
FROM (SELECT user_id, count(*) AS n FROM {EVENTS} GROUP BY 1)""")
def chain_bytes(spark, d):
    df = derived.tracks(spark, d).withColumn("rings", F.array("chain"))
    for kind, value, name in (("polyline", "chain", "polyline"), ("lax_polyline", "chain", "points"), ("lax_polygon", "rings", "lax")):
        df = forms.with_decoded(forms.with_encoded(df, kind, value, name), kind, name, f"{name}_back")
    same = (F.col("polyline_back") == F.col("chain")) & (F.col("points_back") == F.col("chain")) & (F.col("lax_back") == F.col("rings"))
    return df.select("user_id", *(F.octet_length(c).cast("long").alias(c) for c in ("polyline", "points", "lax")), same.alias("same"))


@query(f"SELECT id, 1 + 4 + 24 * 6 + 1 + 4 + 33 AS loop, 7 + 2 * (1 + 4 + 24 * 6 + 38) + 33 AS polygon, 32 AS cap, 33 AS rect, true AS same FROM {ZONES}")
def shape_bytes(spark, d):
    z = derived.zones(spark, d)
    df = G.with_regular_ring(G.with_regular_ring(z, "p", 0.15, 6), "p", 0.05, 6, "hole")
    df = df.withColumns(
        {
            "rings": F.array("ring", F.reverse("hole")),
            "disc": F.array(F.col("p")["x"], F.col("p")["y"], F.col("p")["z"], F.lit(0.01)),
            "box": F.array(F.radians(F.col("lat") - 1), F.radians(F.col("lat") + 1), F.lit(-0.5), F.lit(0.5)),
        }
    )
    same = F.lit(True)
    for kind, value in (("loop", "ring"), ("polygon", "rings"), ("cap", "disc"), ("rect", "box")):
        df = forms.with_decoded(forms.with_encoded(df, kind, value, kind), kind, kind, f"{kind}_back")
        same = same & (F.col(f"{kind}_back") == F.col(value))
    return df.select("id", *(F.octet_length(c).alias(c) for c in ("loop", "polygon", "cap", "rect")), same.alias("same"))


@query(f"SELECT id, round(lng, 7) AS x, round(lat, 7) AS y, true AS same FROM {CUSTOMERS}")
def plain_coordinates(spark, d):
    df = _customers(spark, d).withColumn("c", forms.to_xy("p")).withColumn("q", forms.from_xy("c"))
    return df.select("id", _r("c.x", 7).alias("x"), _r("c.y", 7).alias("y"), (V.angle("p", "q") < 1e-14).alias("same"))


@query(f"SELECT id, 7 AS points, true AS closed, true AS back FROM {ZONES}")
def ring_coordinates(spark, d):
    df = G.with_regular_ring(derived.zones(spark, d), "p", 0.15, 6).withColumn("xy", forms.chain_to_xy("ring", closed=True))
    df = df.withColumn("back", forms.chain_from_xy("xy", closed=True))
    near = F.forall(F.arrays_zip(F.col("ring").alias("a"), F.col("back").alias("b")), lambda e: V.angle(e["a"], e["b"]) < 1e-13)
    return df.select("id", F.size("xy").alias("points"), (F.element_at("xy", 1) == F.element_at("xy", -1)).alias("closed"), (near & (F.size("back") == F.size("ring"))).alias("back"))



@query(f"SELECT id, k, round(degrees(asin(z)), 5) + 0.0 AS lat, round(degrees(atan2(y, x)), 5) + 0.0 AS lng FROM {_HEX}")
def text_round_trip(spark, d):
    # Rings written as text and read back, through the forms of polygons and whole indexes.
    df = G.with_regular_ring(derived.zones(spark, d), "p", 0.15, 6).withColumn("rings", F.array("ring"))
    text = F.concat(F.lit("1:2 | 3:4 # 5:6, 7:8 # "), T.format_rings("rings"))
    df = df.select("id", T.parse_index(text).alias("i"))
    rings = F.element_at(F.element_at("i.polygons", 1), 1)
    df = df.filter((F.size("i.points") == 2) & (F.size("i.chains") == 1)).select("id", F.posexplode(rings).alias("k", "p"))
    return df.select("id", F.col("k").cast("long").alias("k"), (_r(F.degrees(V.latitude("p")), 5) + 0.0).alias("lat"), (_r(F.degrees(V.longitude("p")), 5) + 0.0).alias("lng"))
