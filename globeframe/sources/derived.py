"""Positions for tables that have none: from integer keys, so that any engine agrees.

lat = ((key * 7919) mod 17001) / 100 - 85, lng = ((key * 104729) mod 36000) / 100 - 180.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.lineage import spread


def position(key) -> tuple[Column, Column]:
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(k * 7919, F.lit(17001)) / 100 - 85, F.pmod(k * 104729, F.lit(36000)) / 100 - 180


def points(spark: SparkSession, sf_dir: str, table: str, key: str, *columns: str, by: tuple[str, ...] | None = ()) -> DataFrame:
    """id, lat, lng, p and the asked columns of a table, spread over tasks (by columns), or as it is
    read if ``by`` is None."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("id"), *columns)
    df = df if by is None else spread(df, *by)
    lat, lng = position("id")
    df = df.withColumns({"lat": lat, "lng": lng})
    return df.withColumn("p", V.from_degrees("lat", "lng"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_nationkey")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "supplier", "s_suppkey")


def events(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return points(spark, sf_dir, "events", "event_id", "user_id", "ts", "value", by=by)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zone for each nation, centred by its key."""
    return points(spark, sf_dir, "nation", "n_nationkey", by=None)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of each user as arcs: user_id, id, a, b."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    df = events(spark, sf_dir, "user_id").withColumn("b", F.lead("p").over(w)).filter("b IS NOT NULL")
    return df.select("user_id", "id", F.col("p").alias("a"), "b", "lat", "lng")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and the chain of its events in order of time."""
    row = F.struct("ts", "id", "p")
    df = events(spark, sf_dir, "user_id").groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return df.select("user_id", F.transform("rows", lambda r: r["p"]).alias("chain"))
