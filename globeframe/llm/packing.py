"""Best-fit packing by patterns of few documents and non-negative least squares.

A text becomes token ids, closed by an end id; one longer than a sequence is cut so
that only its first piece may be shorter.  What is left to pack is the histogram of
piece lengths, at most ``capacity`` numbers.  Patterns (one to three lengths that fill a
sequence) are enumerated from the lengths that occur; non-negative least squares fits
how often each pattern repeats so that the lengths used match the histogram; the counts
are rounded down, kept within the histogram, and what remains is packed best-fit
decreasing, whole counts at a time.  The plan is a list of (lengths, repeats) whose size
depends on ``capacity`` only, so it is broadcast; pieces take their places in it by their
rank among pieces of equal length, and the ranks are counted in salts so that a length
shared by a third of all pieces is no single task's work.

Defined results: a null text is empty and has one piece, the end id; rows with a null or
repeated doc_id are packed each (their order within a rank is by doc_id, piece, start);
a very long text is encoded whole and cut; an empty table gives no rows; other columns are
ignored, whatever their names.  ``COMMON`` and ``SWEEPS`` bound the effort of the fit, not
what is packed: every piece gets a place.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, table

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: Patterns of three lengths are built from this many of the commonest lengths.
COMMON = 160
SWEEPS = 40
#: Pieces of one length are ranked in at least this many salts.
SALTS = 512
SALT_ROWS = 2_000_000


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Text to the ids that the tokenizers file of a public vocabulary gives, without special
    tokens added.

    Where there is a rank file of the same vocabulary it is used for texts without any of
    the file's added tokens, such as ``<|endoftext|>``: it gives the same ids (tested) in a
    fifth of the time.  Texts that hold one go through tokenizers."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    file = name if name.endswith(".json") else f"{name}.json"
    whole = Tokenizer.from_file(public.path(file))

    def exact(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if name.endswith(".json"):
        return exact
    import tiktoken

    with open(public.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    quick = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    return lambda text: exact(text) if any(t in text for t in added) else quick(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % capacity
    edges = [0, *range(first or capacity, n + 1, capacity)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            ids_of, out = b.column("doc_id").to_pylist(), []
            for doc, text in zip(ids_of, b.column("text"), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                raw = np.frombuffer(ids, np.uint32).astype("<u4").tobytes()
                for i, (s, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def patterns(histogram: np.ndarray, capacity: int, common: int = COMMON) -> np.ndarray:
    """Rows of up to three lengths (0: none) that occur and fill a sequence exactly."""
    have = np.flatnonzero(histogram[: capacity + 1])
    have = have[have > 0]
    full = have[have == capacity]
    pair = have[(2 * have <= capacity) & (histogram[capacity - have] > 0) & (have < capacity)]
    rows = [np.stack([full, 0 * full, 0 * full], 1), np.stack([capacity - pair, pair, 0 * pair], 1)]
    top = np.sort(have[np.argsort(-histogram[have], kind="stable")][:common])
    a, b = np.meshgrid(top, top, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    c = capacity - a - b
    ok = (c >= b) & (histogram[np.clip(c, 0, capacity)] > 0)
    rows.append(np.stack([c[ok], b[ok], a[ok]], 1))
    return np.concatenate(rows)


def fit(histogram: np.ndarray, rows: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise |A x - histogram|: cyclic coordinate descent."""
    left = histogram.astype(float).tolist()
    columns = [sorted((int(v), int((r == v).sum())) for v in set(r.tolist()) if v) for r in rows]
    norms = [sum(m * m for _, m in c) for c in columns]
    x = [0.0] * len(rows)
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = sum(m * left[v] for v, m in c) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for v, m in c:
                    left[v] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, repeats) that use every piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    done: list[tuple[tuple[int, ...], int]] = []
    rows = patterns(left, capacity)
    if len(rows):
        x = np.floor(fit(left, rows) + 1e-9).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in rows[j] if v]
            need = {v: lengths.count(v) for v in lengths}
            n = min(int(x[j]), *(int(left[v]) // m for v, m in need.items()))
            if n > 0:
                for v, m in need.items():
                    left[v] -= n * m
                done.append((tuple(lengths), n))
    # Best fit, longest first: open sequences by the room they have left.
    rooms: dict[int, list[list]] = defaultdict(list)
    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        for room in sorted(r for r in rooms if r >= v):
            kept = []
            for shape, times in rooms.pop(room):
                fits = room // v
                whole = min(times, n // fits)
                if whole:
                    rooms[room - fits * v].append([shape + (v,) * fits, whole])
                    n -= fits * whole
                times -= whole
                if times and 0 < n < fits:
                    rooms[room - n * v].append([shape + (v,) * n, 1])
                    n, times = 0, times - 1
                if times:
                    kept.append([shape, times])
            if kept:
                rooms[room] += kept
            if not n:
                break
        per = capacity // v
        if n // per:
            rooms[capacity - per * v].append([(v,) * per, n // per])
        if n % per:
            rooms[capacity - (n % per) * v].append([(v,) * (n % per), 1])
    return done + [(tuple(s), t) for group in rooms.values() for s, t in group]


class Places:
    """Where the r-th piece of a length goes: sequence number and offset."""

    def __init__(self, shapes: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        base = 0
        for lengths, times in shapes:
            offset = 0
            for v in lengths:
                slots[v].append((times, base, offset))
                offset += v
            base += times
        self.slots = {v: (np.cumsum([0, *(t for t, _, _ in s)]), np.array([b for _, b, _ in s]), np.array([o for _, _, o in s])) for v, s in slots.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for v, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            ends, base, at = self.slots[v]
            k = np.searchsorted(ends, rank[rows], "right") - 1
            sequence[rows], offset[rows] = base[k] + rank[rows] - ends[k], at[k]
        return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    spark = docs.sparkSession
    cut_up = Scratch(spark, "pack").save(pieces(docs, capacity, vocabulary))
    found = cut_up.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in found:
        histogram[r.length] = r["count"]
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    salts = max(SALTS, int(histogram.max(initial=0)) // SALT_ROWS)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inner)).join(bases, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("base") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
