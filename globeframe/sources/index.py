"""Stored indexes of edges: Parquet tables of edges by the cells that they meet.

A row is (cell, shape_id, edge_id, a, b); files are split by ``part``, the cell's ancestor of a
coarse level, and sorted by the curve within, so a scan of a region reads few parts and row
groups.  What is read back is loaded when it is asked for, column by column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..kernels import grid
from ..operators.edge_queries import _entered


def by_cell(edges: DataFrame, level: int = 6) -> DataFrame:
    """Edges (shape_id, edge_id, a, b) once for each cell of a level that they may meet."""
    return _entered(edges.select("shape_id", "edge_id", "a", "b"), level, 0.0).select("cell", "shape_id", "edge_id", "a", "b")


def write(edges: DataFrame, path: str, level: int = 6, part_level: int = 1) -> None:
    rows = by_cell(edges, level).withColumn("part", C.parent("cell", part_level))
    rows = rows.repartition("part").sortWithinPartitions("part", C.order_key("cell"), "shape_id", "edge_id")
    rows.write.mode("overwrite").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan(index: DataFrame, cells: np.ndarray | None = None) -> DataFrame:
    """The index's rows in curve order; only those in the given cells if there are some.

    A cell below the parts' level prunes to one part, a larger one to the parts inside it."""
    if cells is not None:
        inside = F.lit(False)
        for c in grid.normalize(np.asarray(cells, np.int64)).tolist():
            mine = C.contains(F.lit(c), "cell")
            inside = inside | (mine & (C.contains(F.lit(c), "part") | C.contains("part", F.lit(c))) if "part" in index.columns else mine)
        index = index.filter(inside)
    return index.orderBy(C.order_key("cell"), "shape_id", "edge_id")
