"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures.

A document's shingle set has a signature of ``CHUNKS * CHUNK`` MinHash values, 16 bits
each.  The signature is split into chunks; by pigeonhole two signatures that differ in at
most ``2 * CHUNKS - 1`` values agree, in some chunk, in all values or all but one.  Each
chunk is therefore entered under every choice of one value left out, so that all pairs
within that distance meet under a common key.  Pairs further apart often meet too and are
confirmed as well.  At similarity 0.8 a value differs with probability 0.2, so the chance
to meet under no key is 0.263 ** 12 = 1.1e-7, and the chance of more than ``FAR``
differences, beyond which pairs are not confirmed, is 2e-8.

Documents with equal sets are one class from the start (sets are compared by their size
and a 128-bit sum over their shingles) and only the class's smallest id goes on.

1. Under each key every member is compared with the smallest id.  That links nearly all of
   a group of copies in rows proportional to its size.
2. What is left are keys whose members lie in several components.  The shingles that only
   one document of these keys has bound its similarity to all others from above; documents
   whose bound is below the threshold have no link to lose and leave.  Keys with the same
   members are taken once.  The members of a key are dealt into blocks, and each pair of
   blocks is one task's work: pairs of different components whose bounds allow it are
   confirmed there on full sets, each pair under the first key that it shares, and a
   task returns at most one link for each component it joins.  So neither a pair nor a
   key's member list is ever a row, and no task holds more than two blocks.

No link that a key can show is lost.  In a large group whose members are only loosely
alike, the comparisons that no bound settles still grow with the square of the group (two
blocks at a time, in vector code); copies and near copies do not.

Defined results: words are runs without ASCII white space, A-Z lowered; a document with
fewer words than a shingle has its whole sequence as one shingle; null, empty and wordless
texts have the empty set and link with nothing; of rows with one doc_id each counts as a
text of its own when links are sought, and the output has one row for each of them; rows
with a null doc_id get no component and are kept; an empty table gives no rows; very long
texts are hashed whole, one at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text
from ._store import Scratch, fresh, table

CHUNKS = 12
CHUNK = 5
POSITIONS = CHUNKS * CHUNK
#: Signatures further apart than this are no pair at similarity 0.8, by six deviations.
FAR = 31
#: Documents, and bytes of their sets, in a block of a key's members.
BLOCK = 1024
BLOCK_BYTES = 16 << 20
SIMILARITY = 80  # per cent

_factors = _text.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_shifts = _text.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, one row for each non-empty set (values and offsets given)."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), POSITIONS), np.uint16)
    for k in range(POSITIONS if len(starts) else 0):
        low = np.minimum.reduceat(values * _factors[k] + _shifts[k], starts)
        out[:, k] = (_text.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature the keys of all chunks with each one value left out; a key's six
    low bits are its number (chunk, value left out)."""
    n = len(sig)
    out = np.zeros((n, CHUNKS, CHUNK), np.uint64)
    parts = sig.reshape(n, CHUNKS, CHUNK).astype(np.uint64)
    for gap in range(CHUNK):
        h = np.full((n, CHUNKS), gap + 1, np.uint64) + np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(64)
        for j in range(CHUNK):
            if j != gap:
                h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
        out[:, :, gap] = h
    return (out.reshape(n, -1) & ~np.uint64(63)) | np.arange(POSITIONS, dtype=np.uint64)[None, :]


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first key that signature ``a[i]`` shares with ``b[j]``, for all i and j;
    ``POSITIONS`` if there is none."""
    out = np.full((len(a), len(b)), POSITIONS, np.int8)
    for chunk in range(CHUNKS - 1, -1, -1):
        missed, last = np.zeros(out.shape, np.int8), np.zeros(out.shape, np.int8)
        for j in range(CHUNK):
            differ = a[:, None, chunk * CHUNK + j] != b[None, :, chunk * CHUNK + j]
            missed += differ
            last[differ] = j
        shared = missed <= 1
        out[shared] = chunk * CHUNK + last[shared]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2) and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                values, bounds = _text.shingle_sets(b.column("text"), width)
                size = np.diff(bounds)
                full = size > 0
                f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if full.any():
                    f1[full] = np.add.reduceat(_text.mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
                    f2[full] = np.add.reduceat(_text.mix(values + np.uint64(0x14057B7EF767814F)), bounds[:-1][full])
                sig = iter(signatures(values, bounds))
                blobs = [next(sig).tobytes() if x else None for x in full]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(size, pa.int64()), _signed(f1), _signed(f2), pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sig"]
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                sig = np.frombuffer(b"".join(x.as_py() for x in part.column("sig")), np.uint16).reshape(-1, POSITIONS)
                keys = chunk_keys(sig)
                ids = np.repeat(part.column("doc").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([_signed(keys.ravel()), pa.array(ids)], ["key", "doc"])

    return reps.select("doc", "sig").mapInArrow(run, "key long, doc long")


def _close(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures differ in at most FAR values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 8192):
                b = batch.slice(s, 8192)
                a, c = (np.frombuffer(b"".join(x.as_py() for x in b.column(i)), np.uint16).reshape(-1, POSITIONS) for i in ("sig_a", "sig_b"))
                yield b.select(["a", "b"]).filter(pa.array((a != c).sum(1) <= FAR))

    return pairs.mapInArrow(run, "a long, b long")


def _cards(texts: DataFrame, width: int) -> DataFrame:
    """doc, size, sig and hashes (the full set) of texts with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                values, bounds = _text.shingle_sets(b.column("text"), width)
                full = np.flatnonzero(np.diff(bounds))
                sig = [x.tobytes() for x in signatures(values, bounds)]
                blobs = [values[bounds[i] : bounds[i + 1]].tobytes() for i in full.tolist()]
                columns = [b.column("doc").take(pa.array(full)), pa.array(np.diff(bounds)[full]), pa.array(sig, pa.binary()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "size", "sig", "hashes"])

    return texts.mapInArrow(run, "doc long, size long, sig binary, hashes binary")


def _hashes(cards: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                blobs = [x.as_py() for x in part.column("hashes")]
                docs = np.repeat(part.column("doc").to_numpy(), [len(x) // 8 for x in blobs])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(docs)], ["hash", "doc"])

    return cards.select("doc", "hashes").mapInArrow(run, "hash long, doc long")


def _confirmed(pairs: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) with 100 |A & B| >= similarity |A | B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < similarity * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of the edges (a, b) but the roots themselves: a root is the
    smallest id that is reachable.

    Alternating large-star and small-star steps, each one aggregation and one join whose
    rows stay within a constant of the edges; it ends once no root has a root.
    """
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        high, low = now.select(F.col("b").alias("root")), now.select(F.col("a").alias("root"))
        if not high.join(low, "root", "left_semi").limit(1).count() and not now.groupBy("a").count().filter("count > 1").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # Large star: a node's larger neighbours are tied to the least of its neighbours and itself.
        sides = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.save(sides.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: a node and its smaller neighbours are tied to the least of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        others = large.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(others.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, large)
        now = new


def _compared(block: pa.Table, similarity: int) -> pa.Table:
    """Links (a, b) that join the components of one task's documents: the rows have side
    (0: first block, 1: second, 2: the block against itself), doc, root, own, size, sig,
    hashes, and mask, the numbers of the keys that this task stands for."""
    side = block.column("side").to_numpy()
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    doc, root, own, size = (block.column(c).to_numpy() for c in ("doc", "root", "own", "size"))
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
        mask = np.zeros(POSITIONS + 1, bool)
        mask[[k for k in range(POSITIONS) if block.column("mask")[0].as_py() >> k & 1]] = True
        shared = np.minimum((size - own)[left, None], (size - own)[None, right])
        wanted = (root[left, None] != root[None, right]) & (100 * shared >= similarity * (size[left, None] + size[None, right] - shared))
        if side[0] == 2:
            wanted &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        if wanted.any():
            wanted &= mask[first_key(sig[left], sig[right])]
        if wanted.any():
            blobs = block.column("hashes").to_pylist()
            place = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)[1]
            ends = np.concatenate([[0], np.cumsum(size)])
            here = np.zeros(int(place.max()) + 1, bool)
            top = {r: r for r in np.unique(root).tolist()}

            def head(r: int) -> int:
                while top[r] != r:
                    top[r] = r = top[top[r]]
                return r

            for i in np.flatnonzero(wanted.any(1)).tolist():
                x, others = left[i], right[wanted[i]]
                here[place[ends[x] : ends[x + 1]]] = True
                starts = np.cumsum(size[others]) - size[others]
                at = np.concatenate([place[ends[y] : ends[y + 1]] for y in others.tolist()])
                both = np.add.reduceat(here[at].astype(np.int64), starts)
                here[place[ends[x] : ends[x + 1]]] = False
                for y in others[100 * both >= similarity * (size[x] + size[others] - both)].tolist():
                    p, q = head(int(root[x])), head(int(root[y]))
                    if p != q:
                        top[max(p, q)] = min(p, q)
                        found.append((int(doc[x]), int(doc[y])))
    columns = list(zip(*found, strict=True)) if found else [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


class Join:
    """One near-duplicate join; its steps share the tables of classes and cards.

    Its joins are hinted to shuffle both sides, so that the plan is the same at every size.
    """

    def __init__(self, docs: DataFrame, width: int, similarity: int):
        self.scratch = Scratch(docs.sparkSession, "near")
        self.width, self.similarity = width, similarity
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sketch = self.scratch.save(sketched(self.rows, width))
        full = self.sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = self.scratch.save(full.groupBy(*SAME_SET).agg(F.min("doc_id").alias("doc"), F.min("sig").alias("sig")))

    def links(self, pairs: DataFrame, cards: DataFrame) -> DataFrame:
        """Which of the pairs (a, b) hold on full sets."""
        side = lambda s: cards.select(F.col("doc").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("size").alias(f"size_{s}")).hint("merge")
        sized = pairs.join(side("b"), "b").join(side("a"), "a")
        sized = sized.filter(100 * F.least("size_a", "size_b") >= self.similarity * F.greatest("size_a", "size_b"))
        near = self.scratch.save(_close(sized.select("a", "b", "sig_a", "sig_b")))
        full = lambda s: cards.select(F.col("doc").alias(s), F.col("hashes").alias(f"set_{s}")).hint("merge")
        found = self.scratch.save(_confirmed(near.join(full("b"), "b").join(full("a"), "a").select("a", "b", "set_a", "set_b"), self.similarity))
        self.scratch.drop(near)
        return found

    def unsettled(self, open_: DataFrame, cards: DataFrame) -> DataFrame:
        """The distinct open documents (doc) whose bound allows a link to another of them, with
        ``own``: how many shingles no other of them has.

        Hashes are counted with partial aggregation, so a shingle that all of them have is no
        hot key; an id with several texts has no bound (0)."""
        mine = cards.join(open_.hint("merge"), "doc", "left_semi")
        single = _hashes(mine).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).filter("n = 1")
        own = single.groupBy("doc").agg(F.count("*").alias("own"))
        size = mine.groupBy("doc").agg(F.count("*").alias("texts"), F.max("size").alias("size"))
        sized = size.join(own.hint("merge"), "doc", "left").select("doc", "size", F.when(F.col("texts") == 1, F.coalesce("own", F.lit(0))).otherwise(0).alias("own"))
        return sized.filter(100 * (F.col("size") - F.col("own")) >= self.similarity * F.col("size"))

    def blocks(self, rows: DataFrame) -> DataFrame:
        """The rows (key, doc, root, own, size) of every task: job, side, doc, root, own, mask.

        Keys with the same members are one, told by the count and two xor sums of hashed ids.
        """
        number = F.expr("shiftleft(1L, cast(key & 63 AS int))")
        member = [F.bit_xor(F.xxhash64("doc", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)]
        per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.min("root").alias("low"), F.max("root").alias("high"), *member)
        same = per_key.filter("low < high").withColumn("mask", number).groupBy("n", "hashes", "m1", "m2").agg(F.min("key").alias("key"), F.bit_or("mask").alias("mask"))
        parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("hashes") * 8 / BLOCK_BYTES)).cast("int")
        dealt = rows.join(same.select("key", "mask", parts.alias("parts")).hint("merge"), "key")
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
        job = [F.col("key"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")]
        return dealt.select(*job, side.cast("int").alias("side"), "doc", "root", "own", "mask")

    def run(self) -> DataFrame:
        """node, root of all representatives with a link."""
        keyed = _keys(self.classes)
        shared = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
        members = self.scratch.save(keyed.join(shared.select("key", "first").hint("merge"), "key").filter("doc <> first"))
        firsts = members.select("key", F.col("first").alias("doc")).distinct()
        wanted = members.select("doc").union(firsts.select("doc")).distinct()
        texts = self.rows.withColumnRenamed("doc_id", "doc").join(wanted.hint("merge"), "doc", "left_semi")
        cards = self.scratch.save(_cards(texts, self.width))
        found = self.links(members.select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct(), cards)
        forest = components(found, self.scratch)
        both = members.select("key", "doc").union(firsts)
        rooted = both.join(forest.withColumnRenamed("node", "doc").hint("merge"), "doc", "left")
        rooted = self.scratch.save(rooted.select("key", "doc", F.coalesce("root", "doc").alias("root")))
        self.scratch.drop(members)
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        open_ = self.scratch.save(rooted.join(apart.select("key").hint("merge"), "key", "left_semi").distinct())
        own = self.unsettled(open_.select("doc").distinct(), cards)
        left = self.scratch.save(open_.join(own.hint("merge"), "doc"))
        tasks = self.blocks(left).join(cards.hint("merge"), "doc")
        similarity = self.similarity

        def compared(block: pa.Table) -> pa.Table:
            return _compared(block, similarity)

        more = tasks.groupBy("key", "low", "high").applyInArrow(compared, "a long, b long")
        more = self.scratch.save(more.distinct())
        if more.limit(1).count():
            forest = components(more.unionAll(forest.select(F.col("node").alias("a"), F.col("root").alias("b"))), self.scratch)
        self.scratch.drop(rooted, open_, left, cards)
        return forest


SAME_SET = ["n_shingles", "f1", "f2"]


def near_duplicates(docs: DataFrame, width: int, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    join = Join(docs, width, similarity)
    found = join.run()
    # Several texts under one id are one node: the representatives of their sets are tied.
    named = join.sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
    several = named.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in SAME_SET for f in (F.min, F.max)])
    several = join.scratch.save(several.filter(" OR ".join(f"min_{c} < max_{c}" for c in SAME_SET)).select("doc_id"))
    if several.limit(1).count():
        members = named.join(several, "doc_id").join(join.classes.select(*SAME_SET, F.col("doc").alias("rep")), SAME_SET)
        least = members.groupBy("doc_id").agg(F.min("rep").alias("b"))
        ties = members.join(least, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
        found = components(ties.unionAll(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), join.scratch)
    rooted = join.classes.join(found.hint("merge"), F.col("doc") == F.col("node"), "left").select(*SAME_SET, F.coalesce("root", "doc").alias("root"))
    out = join.sketch.select("doc_id", *SAME_SET).join(rooted.hint("merge"), SAME_SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of each component's smallest doc_id, one row of them (the least by its columns,
    maps compared as JSON); rows with a null doc_id stay."""
    kept = near_duplicates(docs, width, similarity).filter("kept").select("doc_id").distinct()
    stay = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    comparable = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in sorted(docs.schema, key=lambda f: f.name)]
    nth = Window.partitionBy("doc_id").orderBy(*[c.asc_nulls_last() for c in comparable])
    rank = fresh("nth", docs.columns)
    stay = stay.withColumn(rank, F.row_number().over(nth)).filter(F.col(rank) == 1).select(docs.columns)
    return stay.unionByName(docs.filter("doc_id IS NULL"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def oracle(width: int = 4, similarity: int = SIMILARITY) -> str:
    """The same by all pairs that share a shingle, and what each document reaches."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, chr(10))]
  ELSE list_transform(range(1, len(w) + 2 - {width}), lambda i: array_to_string(w[i:i + {width} - 1], chr(10))) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * n_both >= {similarity} * (p.n + q.n - n_both)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY 1) USING (doc_id)"""
