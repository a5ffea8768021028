"""Cutting lineage by reliable checkpoints in the folder that all executors share, and spreading rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back.

    The folder is that of ``spark.checkpoint.dir``; where none is set a local session gets
    one of its own, and a cluster an error, since its executors could not see it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='globeframe-')}"
        sc.setCheckpointDir(found)
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over at least two tasks a core, by columns if asked.

    Tables of numbers are small files, read by a few tasks, and Spark joins small shuffles into
    few; work of far more seconds than bytes is then done by few cores."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)
