"""Exact top-k search: a Voronoi kNN join by inner product.

Vectors are grouped by their nearest pivot (pivots: a sample of the rows, about the square
root of their number, at most ``PIVOTS``).  A summary of each group holds its row count and
radius.  For a query q and a group with pivot p and radius r every member x has
q.p - |q| r <= q.x <= q.p + |q| r,  so the summaries alone give each query a score that k
rows reach; the pivots are rows too, so the k-th best of them is such a score as well.  The
upper bounds then show which groups may hold a better row.  Queries are grouped by pivot
too and dealt into blocks; a data row is sent only to the blocks with a query that needs
its group, spread over salts so that a group with a third of all rows is shared by many
tasks.  Each task solves its part exactly in integers; the parts' best are merged.  On
vectors without any cluster, such as random directions, no bound excludes a group and
every block meets every row.

Defined results: a vector that is null, empty, of another length than most (of the lengths
that are most frequent, the smallest), or that holds a null or non-finite component takes
no part; ties go to the smaller id; rows with one id twice both count, and none of them
is a candidate of a query with that id; fewer candidates than k give fewer rows; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, table

PIVOTS = 1024
#: Queries in a block: a bound on what a task holds beside its data rows.
BLOCK = 2048
#: Data rows that one salt of a block is meant for.
SALT_ROWS = 50_000
EVERY = 50
K = 5


def _matrix(column) -> np.ndarray:
    """Rows of equal length as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, x as double; unusable vectors leave."""
    e = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.transform(e.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, fine)).select("vec_id", whole.alias("v"))


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest pivot of each row, and the distance to it, rounded up."""
    x, p = rows.astype(np.float64), pivots.astype(np.float64)
    d = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None, :]
    at = d.argmin(1)
    exact = ((rows - pivots[at]) ** 2).sum(1).astype(np.float64)
    return at, np.sqrt(exact) * (1 + 1e-9)


def top_scores(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """The k best (score, then smaller id) data rows of every query but itself: three flat arrays."""
    # Products of quantised components stay far below 2**53, so float matrix products are exact.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53
    s = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else q @ x.T
    own = q_ids[:, None] == ids[None, :]
    low = np.iinfo(np.int64).min
    s[own] = low
    if s.shape[1] > k:
        worst = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        rows, cols = np.nonzero((s >= worst[:, None]) & (s > low))
    else:
        rows, cols = np.nonzero(s > low)
    order = np.lexsort((ids[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(q_ids)))
    keep = np.arange(len(rows)) - first[rows] < k
    return q_ids[rows[keep]], ids[cols[keep]], s[rows[keep], cols[keep]]


@dataclass
class Routes:
    """Where rows go: queries with their block, data rows with their group, and the groups that
    each block needs."""

    blocked: DataFrame  # vec_id, v, block
    placed: DataFrame  # vec_id, v, cell
    needed: DataFrame  # target (a block), cell
    blocks: int
    salts: int


def _routes(data: DataFrame, queries: DataFrame, k: int, n_pivots: int, block: int) -> Routes | None:
    """The routes of a join; none if there are no data rows."""
    spark = data.sparkSession
    scratch = Scratch(spark, "knn")
    lengths = data.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0].dim
    data, queries = (df.filter(F.size("v") == dim) for df in (data, queries))
    rows = data.groupBy("vec_id").count().agg(F.sum("count").alias("rows"), F.max("count").alias("twice")).first()
    n_pivots = min(n_pivots, max(16, math.isqrt(rows.rows)))
    sampled = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()
    known_ids, known = np.array([r.vec_id for r in sampled]), np.array([r.v for r in sampled], np.int64)
    pivots = np.unique(known, axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, far = nearest(_matrix(b.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "v", "cell", "far"])

    typed = "vec_id long, v array<long>, cell int, far double"
    placed = scratch.save(data.mapInArrow(assign, typed))
    asked = queries.mapInArrow(assign, typed)
    # At most one summary row for each pivot, so a bounded collect.
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("cell").collect()
    cells, count, radius = (np.array([r[i] for r in summary]) for i in range(3))
    centres = pivots[cells.astype(int)]
    salts = max(1, int(count.sum()) // SALT_ROWS, spark.sparkContext.defaultParallelism)
    most = int(rows.twice)  # rows of one id, at most: a query's own are no candidates

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with a bit for every group that may hold one of its k best."""
        for b in batches:
            q = _matrix(b.column("v"))
            if not len(q):
                continue
            mid = (q @ centres.T).astype(np.float64)
            slack = np.sqrt((q * q).sum(1).astype(np.float64))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6
            order = np.argsort(-(mid - slack), axis=1)
            reached = np.cumsum(count[order], axis=1) >= k + most
            at = np.where(reached.any(1), reached.argmax(1), len(cells) - 1)
            floor = np.take_along_axis(mid - slack, order, 1)[np.arange(len(q)), at]
            floor[~reached.any(1)] = -np.inf
            if len(known) >= k:
                sure = (q @ known.T).astype(np.float64)
                sure[b.column("vec_id").to_numpy()[:, None] == known_ids[None, :]] = -np.inf
                floor = np.maximum(floor, np.partition(sure, len(known) - k, axis=1)[:, len(known) - k])
            wanted = mid + slack >= floor[:, None]
            lists = pa.array([cells[w].tolist() for w in wanted], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("cell"), lists], ["vec_id", "v", "cell", "wanted"])

    wanted = scratch.save(asked.mapInArrow(needs, "vec_id long, v array<long>, cell int, wanted array<int>"))
    n_queries = wanted.count()
    blocks = max(1, -(-n_queries // block))
    # Queries of one pivot share a block where they fit: blocks follow the order of pivots.
    per_cell = {r.cell: r.n for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    start, before = {}, 0
    for c in sorted(per_cell):
        start[c] = before
        before += per_cell[c]
    begin = F.element_at(F.create_map(*[F.lit(x) for c in start for x in (c, start[c])]), F.col("cell")) if start else F.lit(0)
    size = F.element_at(F.create_map(*[F.lit(x) for c in per_cell for x in (c, per_cell[c])]), F.col("cell")) if per_cell else F.lit(1)
    spot = begin + F.pmod(F.xxhash64("vec_id"), size)
    blocked = wanted.withColumn("block", F.floor(spot * F.lit(blocks) / F.lit(max(1, n_queries))).cast("int"))
    needed = blocked.select(F.col("block").alias("target"), F.explode("wanted").alias("cell")).distinct()
    return Routes(blocked, placed, needed, blocks, salts)


def routes(data: DataFrame, queries: DataFrame, k: int = K, n_pivots: int = PIVOTS, block: int = BLOCK) -> dict[str, int]:
    """How many blocks a join has, and how many data rows are sent to them in all."""
    way = _routes(data, queries, k, n_pivots, block)
    return {"blocks": way.blocks, "rows_sent": way.placed.join(way.needed, "cell").count()} if way else {"blocks": 0, "rows_sent": 0}


def knn_join(data: DataFrame, queries: DataFrame, k: int = K, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``data`` for every row of ``queries``.

    Both have vec_id and v (array of long).
    """
    way = _routes(data, queries, k, n_pivots, block)
    if way is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocked, salts = way.blocked, way.salts
    sent = way.placed.join(way.needed, "cell")
    sent = sent.select(F.col("target").alias("data_block"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("data_salt"), F.col("vec_id").alias("data_id"), F.col("v").alias("data_v"))
    dealt = blocked.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "vec_id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        q_ids, q = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks())
        ids, x = right.column("data_id").to_numpy(), _matrix(right.column("data_v").combine_chunks())
        got: list[tuple] = []
        for s in range(0, len(ids), 4096):
            got.append(top_scores(q_ids, q, ids[s : s + 4096], x[s : s + 4096], k))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], names)

    parts = dealt.groupBy("block", "salt").cogroup(sent.groupBy("data_block", "data_salt")).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = quantised(table(spark, sf_dir, "embeddings"))
    return knn_join(data, data.filter(F.col("vec_id") % EVERY == 0))


def oracle() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), w AS (
  SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1)
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i]))::BIGINT AS score
  FROM w q JOIN w x ON q.vec_id % {EVERY} = 0 AND q.vec_id <> x.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
