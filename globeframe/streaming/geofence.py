"""Geofences on streams: positions that arrive are matched with polygons that stand.

The polygons' covering cells are a static table, so each micro-batch is the same stateless
equi-join on cells as a batch query; counts by window and fence are kept with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.spatial_join import point_in_polygon


def located(stream: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Adds the unit vector ``p`` of a position in degrees."""
    return stream.withColumn("p", V.from_degrees(lat, lng))


def inside(stream: DataFrame, polygons: DataFrame, max_cells: int = 32, max_level: int = 18) -> DataFrame:
    """id, polygon_id for every event (id, p) of a stream in a polygon (polygon_id, rings): a
    stream-static join, so the output can be appended."""
    return point_in_polygon(stream, polygons, max_cells, max_level)


def counts(stream: DataFrame, polygons: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 hour", max_cells: int = 32) -> DataFrame:
    """window, polygon_id, n: events by time window and polygon; later ones than ``late`` leave."""
    # The time goes through the join as part of the id.
    timed = stream.withWatermark(time, late)
    keyed = timed.select(F.struct(F.col("id").alias("id"), F.col(time).alias("ts")).alias("id"), "p")
    hits = point_in_polygon(keyed, polygons, max_cells, id_type="struct<id:bigint,ts:timestamp>")
    hits = hits.select(F.col("id.ts").alias("ts"), "polygon_id").withWatermark("ts", late)
    return hits.groupBy(F.window("ts", window).alias("window"), "polygon_id").agg(F.count("*").alias("n"))
