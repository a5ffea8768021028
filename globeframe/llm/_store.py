"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a fresh folder of this
    machine in local mode and an error on a cluster, whose executors could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='globeframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def _remove_last(spark: SparkSession, path: str) -> None:
    """At the driver's end: results that read the tables are no longer asked for then."""
    with contextlib.suppress(Exception):  # the JVM may be gone already
        _remove(spark, path)


class Scratch:
    """Named tables below one shared folder; each write cuts the lineage of what follows.

    Parquet keeps the statistics that adaptive joins need and is smaller than a
    checkpointed RDD.  ``drop`` removes a table that no later plan reads; the rest goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_remove_last, spark, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        self.free_shuffles()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _remove(self.spark, df.scratch_path)

    def free_shuffles(self) -> None:
        """Spark deletes the shuffle files of finished plans when the driver's heap is collected."""
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that is none of the columns (compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
