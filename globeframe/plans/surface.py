"""Queries through the SQL names, and the stream geofence run over a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from .. import sql as names
from ..operators import geometry as G
from ..sources import derived
from ..streaming import geofence
from .catalogue import _HEX, ATAN, CHORD, CUSTOMERS, EVENTS, HAV, PAIRS, _pairs, cells_sql, det, query, sides_sql, token_sql, up


@query(f"""SELECT a.id AS id, round({ATAN}, 8) AS angle, round({CHORD}, 8) AS chord2, round({HAV} * 6371010.0, 2) AS meters, {CHORD} <= power(2*sin(0.25),2) AS near,
  round(2 * asin(sqrt({CHORD}) / 2), 6) AS back, {up('c.cell', 8)} AS cell, {token_sql(up('c.cell', 8))} AS token, 8 AS level, c.face::INTEGER AS face, true AS held
FROM {PAIRS} JOIN (SELECT id, cell, face FROM {cells_sql(CUSTOMERS)}) c ON c.id = a.id""")
def sql_names(spark, d):
    names.register(spark)
    _pairs(spark, d).createOrReplaceTempView("globe_pairs")
    return spark.sql(
        """SELECT id, round(globe_angle(p, q), 8) AS angle, round(globe_chord2(p, q), 8) AS chord2, round(globe_meters(lat, lng, zlat, zlng), 2) AS meters,
          globe_cap_contains(p, 0.5D, q) AS near, round(globe_chord_to_angle(globe_chord2(p, q)), 6) AS back, cell, globe_cell_token(cell) AS token, globe_cell_level(cell) AS level,
          globe_cell_face(cell) AS face, globe_cell_contains(globe_cell_parent(cell, 3), cell) AND globe_segment_distance(p, p, q) = 0 AS held
        FROM (SELECT *, globe_cell(p, 8) AS cell FROM globe_pairs)"""
    )


@query(f"""SELECT ts_hour AS hour, polygon_id, count(*) AS n FROM (SELECT p.id, date_trunc('hour', p.ts) AS ts_hour, s.id AS polygon_id FROM {EVENTS} p, {sides_sql(_HEX, 6)} s GROUP BY 1, 2, 3 HAVING bool_and({det('s.a', 's.b', 'p')} > 0)) GROUP BY 1, 2""")
def stream_geofence(spark, d):
    # The events as a stream of files, all that is there, into a table that is read back.
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    lat, lng = derived.position("event_id")
    placed = geofence.located(source.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), lat.alias("lat"), lng.alias("lng")))
    fences = G.with_regular_ring(derived.zones(spark, d), "p", 0.15, 6).select(F.col("id").alias("polygon_id"), F.array("ring").alias("rings"))
    hits = geofence.counts(placed, fences, late="36500 days")
    name = "globe_geofence"
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="globeframe-")
    run = hits.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{root}/{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "polygon_id", "n")
