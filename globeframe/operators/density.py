"""Density trees: weights of cells with all their ancestors, as a table (cell, level, weight)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..kernels import density as walk
from .lineage import cut

#: Cells of a tree that is walked as a whole.
MAX_CELLS = 2_000_000


def tree(points: DataFrame, max_level: int, weight: str | None = None) -> DataFrame:
    """Sum of weights (or count) of the points (``leaf``) in every cell down to a level.

    One row for each cell of the deepest level is summed first, so that the rollup over
    ancestors expands cells, not points.
    """
    w = F.sum(weight) if weight else F.count("*")
    deep = points.groupBy(C.parent("leaf", max_level).alias("deep")).agg(w.alias("w"))
    rows = deep.select(F.posexplode(C.ancestors("deep", 0, max_level)).alias("level", "cell"), "w")
    return rows.groupBy("cell", "level").agg(F.sum("w").alias("weight"))


def feature_tree(points: DataFrame, max_level: int) -> DataFrame:
    """Each feature counts once in a cell, however many of its points (``leaf``) lie there."""
    rows = points.select("feature", C.parent("leaf", max_level).alias("deep")).distinct()
    rows = rows.select("feature", F.posexplode(C.ancestors("deep", 0, max_level)).alias("level", "cell")).distinct()
    return rows.groupBy("cell", "level").agg(F.count("*").alias("weight"))


def sum_trees(*trees: DataFrame) -> DataFrame:
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.groupBy("cell", "level").agg(F.sum("weight").alias("weight"))


def leaves(t: DataFrame) -> DataFrame:
    """Cells without a child in the tree."""
    parents = t.filter("level > 0").select(C.parent("cell", None).alias("cell")).distinct()
    return t.join(parents, "cell", "left_anti")


def normalize(t: DataFrame, max_level: int) -> DataFrame:
    """Siblings scaled to their parent's new weight, level by level, rounded up in integers."""
    t = cut(t)
    done = t.filter("level = 0").select("cell", "level", F.col("weight").cast("decimal(38,0)").alias("weight"))
    out = done
    for k in range(1, max_level + 1):
        here = t.filter(F.col("level") == k).select("cell", "level", F.col("weight").cast("decimal(19,0)").alias("own"), C.parent("cell", None).alias("up"))
        total = here.groupBy("up").agg(F.sum("own").alias("total"))
        scaled = here.join(total, "up").join(done.select(F.col("cell").alias("up"), F.col("weight").cast("decimal(19,0)").alias("above")), "up")
        whole = F.expr("CAST(floor((CAST(own * above AS decimal(38,0)) + total - 1) / total) AS decimal(38,0))")
        done = cut(scaled.select("cell", "level", whole.alias("weight")))
        out = out.unionByName(done)
    return out


def normal_weights(t: DataFrame) -> DataFrame:
    """cell, level, weight: each cell's share of its face's weight in doubles, rounded once;
    unlike ``normalize`` nothing is rounded on the way down."""
    rows = t.select("cell", "level", F.col("weight").cast("double").alias("own"))
    total = rows.filter("level > 0").groupBy(C.parent("cell", None).alias("up")).agg(F.sum("own").alias("total"))
    part = rows.withColumn("up", F.when(F.col("level") > 0, C.parent("cell", None))).join(total, "up", "left")
    part = part.select("cell", "level", "own", (F.col("own") / F.col("total")).alias("share"))
    chain = rows.select(F.col("cell").alias("below"), F.col("level").alias("depth"), F.explode(F.transform(F.sequence(F.lit(0), "level"), lambda k: C.parent("cell", k))).alias("cell"))
    # Log shares are summed over a cell's ancestors; the face gives its weight.
    product = F.exp(F.sum(F.when(F.col("level") > 0, F.ln("share")).otherwise(F.ln("own"))))
    out = chain.join(part, "cell").groupBy("below", "depth").agg(product.alias("weight"))
    return out.select(F.col("below").alias("cell"), F.col("depth").alias("level"), F.round("weight").cast("long").alias("weight"))


def _walked(t: DataFrame, kernel: Callable[[walk.Tree], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``kernel`` over the whole tree.

    What comes next on the curve depends on all before it, so the tree is walked in one
    task.  It is a summary whose depth its builder picks; one of more than ``MAX_CELLS``
    cells is refused."""
    if (n := t.count()) > MAX_CELLS:
        raise ValueError(f"the tree has {n} cells; build it to a smaller depth (at most {MAX_CELLS} cells)")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}

    def run(rows: pa.Table) -> pa.Table:
        found = kernel(walk.Tree(rows.column("cell").to_pylist(), rows.column("weight").to_pylist()))
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.table([pa.array(list(v), kinds[c.split()[1]]) for v, c in zip(columns, schema.split(", "), strict=True)], names)

    rows = t.select("cell", F.col("weight").cast("long").alias("weight"))
    return rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, schema)


def dilate(t: DataFrame, radius: float, max_level_diff: int) -> DataFrame:
    """cell, level, weight: the tree with the ring of a radius (radians) around its leaves, cells
    there having the greatest weight among the tree's cells beside them."""
    deep = C.metric_max_level("min_width", radius)

    def kernel(tree: walk.Tree) -> list[tuple]:
        return [(walk.signed(c), walk.level(c), w) for c, w in walk.dilate(tree, deep, max_level_diff).items()]

    return _walked(t, kernel, "cell long, level int, weight long")


def partition(t: DataFrame, max_weight: int) -> DataFrame:
    """cell, weight, part: cells of the tree in curve order, grouped below a weight."""

    def kernel(tree: walk.Tree) -> list[tuple]:
        return [(walk.signed(c), w, k) for c, w, k in walk.partition(tree, max_weight)]

    return _walked(t, kernel, "cell long, weight long, part int")


def clusters(t: DataFrame, target: int) -> DataFrame:
    """cluster, begin, end, weight: stretches of the curve (leaf cells, end excluded) of a weight
    within a fifth of the target, a leaf cell of the tree being cut in proportion."""
    low, high = max(1, target * 8 // 10), max(1, target * 12 // 10)

    def kernel(tree: walk.Tree) -> list[tuple]:
        return [(k, walk.signed(b), walk.signed(e), w) for k, (b, e, w) in enumerate(walk.clusters(tree, low, high))]

    return _walked(t, kernel, "cluster int, begin long, end long, weight long")
