"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents long, so Jaccard similarity of the two says nothing;
what counts is the share of an item's shingles that a document holds.  Items are
partitioned by the size of their shingle set.  Each partition's sketch is a bottom-k
MinHash: an item's k smallest shingle hashes, with k fixed by the partition's upper
size bound so that by pigeonhole a document with the asked share of the item's
shingles must hold one of the k.  The search therefore misses nothing; hits are
confirmed by exact containment of shingles.

The items go to the executors in broadcast blocks of ``BLOCK_BYTES`` at most; each block is
one pass over the documents, and blocks stay broadcast until the result has been read.
Shingles are told by 64-bit hashes: two different ones agree with a chance of 5e-20.

Defined results: a null or empty text has no shingle and matches nothing; an item with
fewer words than a shingle has its whole word sequence as one, and is sought among the
runs of so many words of every document; equal items each match; documents without a
match give no row; rows with one doc_id are searched each, rows without an id match
nothing and are kept; very long texts are searched whole; empty tables give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._store import table

WIDTH = 5
SHARE = 80  # per cent of an item's shingles
BLOCK_BYTES = 16 << 20
MATCHES = "doc_id long, item_id long, n_item long, n_shared long"


def sketch_size(upper: int, share: int) -> int:
    """One more than the shingles that a match may lack, for items of ``upper`` shingles."""
    return upper - -(-upper * share // 100) + 1


def size_class(n: int) -> int:
    """Upper bound of the partition of sets with n shingles: the next power of two."""
    return 1 << max(0, int(n - 1).bit_length())


class Block:
    """The sketches and full sets of some items, as flat sorted arrays."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], words: list[int], width: int, share: int):
        self.ids, self.share = np.array(ids, np.int64), share
        self.short = sorted({n for n in words if n < width})
        self.size = np.array([len(s) for s in sets], np.int64)
        low = [s[: min(len(s), sketch_size(size_class(len(s)), share))] for s in sets]
        flat = lambda parts: (np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        self.sketch, self.sketch_item = self._sorted(*flat(low))
        self.full, self.full_item = self._sorted(*flat(sets))

    @staticmethod
    def _sorted(h: np.ndarray, item: np.ndarray):
        order = np.argsort(h, kind="stable")
        return h[order], item[order]

    def _pairs(self, values: np.ndarray, keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the value, item) wherever a value is among the keys."""
        lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        at = np.flatnonzero(hi > lo)
        n = hi[at] - lo[at]
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), items[np.repeat(lo[at], n) + shift]

    def match(self, values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item id, its size, shared) for sets given as values and offsets."""
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at, item = self._pairs(values, self.sketch, self.sketch_item)
        if not len(at):
            return []
        n = np.int64(len(self.ids))
        candidates = np.unique(row_of[at] * n + item)
        rows = np.unique(candidates // n)
        inside = np.isin(row_of, rows)
        at, item = self._pairs(values[inside], self.full, self.full_item)
        pair, shared = np.unique(row_of[inside][at] * n + item, return_counts=True)
        confirmed = np.isin(pair, candidates) & (100 * shared >= self.share * self.size[pair % n])
        return [(int(p // n), int(self.ids[p % n]), int(self.size[p % n]), int(s)) for p, s in zip(pair[confirmed], shared[confirmed], strict=True)]


def item_blocks(items: DataFrame, width: int, share: int) -> Iterator[Block]:
    """The items in blocks, read from the table one partition at a time."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, bounds = _text.shingle_sets(b.column("text"), width, _text.NOT_ALNUM)
            rows = [values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            data, offsets = _text.utf8(b.column("text"))
            n = np.bincount(_text.words(data, offsets, _text.NOT_ALNUM)[2], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("item_id").cast(pa.int64()), pa.array(rows, pa.binary()), pa.array(n, pa.int64())], ["item_id", "hashes", "words"])

    hashed = items.select("item_id", "text").mapInArrow(sets, "item_id long, hashes binary, words long").filter("item_id IS NOT NULL AND octet_length(hashes) > 0")
    ids, found, words, size = [], [], [], 0
    for r in hashed.toLocalIterator():
        s = np.frombuffer(bytes(r.hashes), np.uint64)
        if found and size + 2 * s.nbytes > BLOCK_BYTES:
            yield Block(ids, found, words, width, share)
            ids, found, words, size = [], [], [], 0
        ids.append(r.item_id)
        words.append(r.words)
        found.append(s)
        size += 2 * s.nbytes
    if found:
        yield Block(ids, found, words, width, share)


def document_sets(column, width: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, and its runs of so many words as short items have:
    (values, offsets)."""
    data, offsets = _text.utf8(column)
    data = _text.LOWER[data]
    start, end, row = _text.words(data, offsets, _text.NOT_ALNUM)
    hashes = _text.word_hashes(data, start, end)
    parts = [_text.shingles(hashes, row, len(offsets) - 1, width), *(_text.short_runs(hashes, row, n) for n in short)]
    h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    if short:
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return _text.distinct_sets(h, at, len(offsets) - 1)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every document with ``share`` per cent of an item's shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    out = None
    for block in item_blocks(items, width, share):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in _text.pieces(batch, "text"):
                    values, bounds = document_sets(b.column("text"), width, sent.value.short)
                    if hits := sent.value.match(values, bounds):
                        row, item, size, shared = (pa.array(x, pa.int64()) for x in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), item, size, shared], ["doc_id", "item_id", "n_item", "n_shared"])

        part = texts.mapInArrow(search, MATCHES)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The documents that hold no item; rows with a null doc_id stay."""
    hits = contaminated(docs, items, width, share).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(width: int = WIDTH, share: int = SHARE) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def words(name: str, key: str) -> str:
        found = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
        return f"(SELECT {key}, {found} AS w FROM {name} WHERE {key} IS NOT NULL)"

    runs = lambda n: f"list_transform(range(1, len(w) + 2 - {n}), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
    return f"""
WITH qw AS {words("benchmark", "item_id")}, dw AS {words("documents", "doc_id")},
q AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE {runs(width)} END)) AS s FROM qw),
lengths AS (SELECT DISTINCT least({width}, len(w)) AS n FROM qw WHERE len(w) > 0),
d AS (SELECT doc_id, unnest(list_distinct({runs('n')})) AS s FROM dw, lengths WHERE len(w) >= n),
sizes AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= {share} * n_item"""
