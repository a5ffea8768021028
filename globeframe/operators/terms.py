"""Inverted-index terms and shards of regions.

Index and query terms meet exactly if the coverings overlap: a cell and its
ancestors give tokens, and a covering cell gives its token with a mark.  Two quirks are kept as public behaviour:
ancestors step one level at a time whatever ``level_mod`` is, and saving space moves the
ancestors' tokens from the index to the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C


@dataclass(frozen=True)
class TermOptions:
    max_cells: int = 8
    min_level: int = 4
    max_level: int = 16
    level_mod: int = 1
    marker: str = "$"
    points_only: bool = False
    save_space: bool = False

    def __post_init__(self):
        if not 0 <= self.min_level <= self.max_level <= 30 or self.level_mod not in (1, 2, 3):
            raise ValueError("levels must be 0 <= min <= max <= 30 and level_mod 1, 2 or 3")

    @property
    def top(self) -> int:
        return self.max_level - (self.max_level - self.min_level) % self.level_mod


def _marked(cell: Column, o: TermOptions) -> Column:
    return F.concat(F.lit(o.marker), C.token(cell))


def _up(cell: Column, o: TermOptions, proper: bool = False) -> Column:
    """The cell's ancestors from min_level to its own level, the cell itself last."""
    last = C.level(cell) - (1 if proper else 0)
    some = F.transform(F.sequence(F.lit(o.min_level), F.greatest(last, F.lit(o.min_level))), lambda k: C.parent(cell, k))
    return F.when(last >= o.min_level, some).otherwise(F.array().cast("array<long>"))


def point_index_terms(leaf, o: TermOptions = TermOptions()) -> Column:
    """Tokens of the cell and its ancestors, deepest first, then the mark of the cell."""
    tokens = [C.token(C.parent(leaf, k)) for k in range(o.top, o.min_level - 1, -1)]
    marks = [] if o.points_only else [_marked(C.parent(leaf, o.top), o)]
    return F.array(*tokens, *marks)


def point_query_terms(leaf, o: TermOptions = TermOptions()) -> Column:
    """The token of the point's cell, then the marks of it and its ancestors, deepest first."""
    marks = [_marked(C.parent(leaf, k), o) for k in range(o.top, o.min_level - 1, -1)]
    return F.array(C.token(C.parent(leaf, o.top)), *marks)


def index_terms(cells, o: TermOptions = TermOptions()) -> Column:
    """Terms of a canonical covering (array of cells), sorted and distinct."""

    def of(c: Column) -> Column:
        own = F.array(C.token(c)) if o.save_space else F.transform(_up(c, o), C.token)
        mark = F.array(_marked(c, o))
        return own if o.points_only else F.when(C.level(c) < o.top, F.concat(own, mark)).otherwise(own)

    return F.sort_array(F.array_distinct(F.flatten(F.transform(cells, of))))


def query_terms(cells, o: TermOptions = TermOptions()) -> Column:
    def of(c: Column) -> Column:
        out = [F.array(C.token(c))]
        if not o.points_only:
            out.append(F.transform(_up(c, o), lambda a: _marked(a, o)))
        if o.save_space:
            out.append(F.transform(_up(c, o, proper=True), C.token))
        return F.concat(*out)

    return F.sort_array(F.array_distinct(F.flatten(F.transform(cells, of))))


def term_join(index: DataFrame, queries: DataFrame) -> DataFrame:
    """doc_id, query_id of rows (doc_id, terms) and (query_id, terms) with a term in common."""
    a = index.select("doc_id", F.explode("terms").alias("term"))
    b = queries.select("query_id", F.explode("terms").alias("term"))
    return a.join(b, "term").select("doc_id", "query_id").distinct()


def shard_overlaps(shards: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, shard, weight: how many leaf cells of a shard's cells meet each region.

    ``shards`` has (shard, cell), ``regions`` (region_id, cells); whole shard cells count.
    """
    from .spatial_join import cell_overlap

    cells = regions.select(F.col("region_id").alias("left_id"), F.explode("cells").alias("left_cell"))
    kept = shards.select(F.col("shard").alias("right_id"), F.col("cell").alias("right_cell"))
    pairs = cell_overlap(cells, kept).select("left_id", "right_id", "right_cell").distinct()
    weight = F.sum(C.lsb("right_cell").cast("decimal(20,0)"))
    return pairs.groupBy(F.col("left_id").alias("region_id"), F.col("right_id").alias("shard")).agg(weight.alias("weight"))


def most_overlapping_shard(shards: DataFrame, regions: DataFrame, default: int = -1) -> DataFrame:
    """region_id, shard: the shard of most weight, ties to the smaller; ``default`` if none."""
    order = Window.partitionBy("region_id").orderBy(F.desc("weight"), "shard")
    best = shard_overlaps(shards, regions).withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return regions.select("region_id").join(best.select("region_id", "shard"), "region_id", "left").select("region_id", F.coalesce("shard", F.lit(default)).alias("shard"))
