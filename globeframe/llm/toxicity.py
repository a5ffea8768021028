"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector for all thresholds t_0 < t_1 < ...
Features are log(1 + count) of whole words and word prefixes, from a vocabulary picked by
how their share of rows differs between toxic and clean rows of the labelled sample.
Labels are binary, so grades of severity come from them and the load of a toxic text:
0 for rows labelled clean; rows labelled toxic are 1, 2 or 3 by how many of their words
are marked, a marked word being far commoner in toxic than in clean sample rows.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows (smallest hash
of doc_id), of which only the vocabulary's counts travel; it is then applied to all rows.

Defined results: a null, empty or wordless text has the features of an empty text; labels
of unknown documents or null are skipped; without labelled rows of both kinds everything
scores 0; repeated rows and rows with a null doc_id are scored each; very long texts are
scored whole; an empty table gives no rows; other columns are ignored by the scores and
kept, whatever their names, by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._store import table

SAMPLE = 8000
VOCABULARY = 512
#: Bytes of the prefixes that are features beside the whole word: inflected forms share them.
PREFIXES = (4, 5, 6, 7, 8)
#: A vocabulary word is in at least this share of the sample's rows.
SUPPORT = 0.004
#: Marked words by which toxic rows have grade 2, and grade 3.
LOADS = (3, 6)
#: Rows with this chance of a grade over 0 are rejected.
REJECT = 0.5
SCORES = "doc_id long, severity double, grade int, p_toxic double, rejected boolean"


def _features(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the whole word and of its prefixes, a row for each kind, 0 where a word is
    shorter than the prefix; the row of every word; the number of rows."""
    data, offsets = _text.utf8(column)
    data = _text.LOWER[data]
    start, end, row = _text.words(data, offsets, _text.NOT_ALNUM)
    prefix = _text.PrefixHash(data)
    out = np.zeros((1 + len(PREFIXES), len(start)), np.uint64)
    out[0] = _text.mix(prefix.of(start, end))
    for kind, n in enumerate(PREFIXES, 1):
        long = end - start >= n
        out[kind, long] = _text.mix(prefix.of(start[long], start[long] + n) + np.uint64(kind))
    return out, row, len(offsets) - 1


class Vocabulary:
    """Sorted feature hashes, behind a small filter that most lookups do not pass."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hashes & np.uint64(0xFFFF)).astype(int)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature number) of every hit."""
        if not len(self) or not features.size:
            return np.zeros(0, int), np.zeros(0, int)
        word = np.flatnonzero(self.filter[(features & np.uint64(0xFFFF)).astype(np.uint16)].ravel())
        h = features.ravel()[word]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        hit = self.hashes[at] == h
        return word[hit] % features.shape[1], at[hit]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    vocabulary: Vocabulary
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, column):
        """(expected severity, likeliest grade, P(grade > 0)) of every text."""
        features, row, n = _features(column)
        word, at = self.vocabulary.find(features)
        cell, count = np.unique(row[word] * len(self.vocabulary) + at, return_counts=True)
        total = np.zeros(n)
        if len(cell):
            total = np.bincount(cell // len(self.vocabulary), np.log1p(count) * self.weights[cell % len(self.vocabulary)], minlength=n)
        over = 1 - sigmoid(self.thresholds[None, :] - total[:, None])  # P(grade > k)
        each = -np.diff(np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], 1), axis=1)
        return over.sum(1), each.argmax(1), over[:, 0]


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 600, rate: float = 0.1, ridge: float = 2e-5):
    """Weights and ordered thresholds by Adam on the mean log-likelihood; thresholds are a
    first value and positive gaps, so their order always holds."""
    n, m = x.shape
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, steps + 1):
        t = p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])
        z = x @ p[:m]
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        up, down = sigmoid(bounds[y + 1] - z), sigmoid(bounds[y] - z)
        likely = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / likely, down * (1 - down) / likely
        g_t = np.array([(d_down[y == k + 1].sum() - d_up[y == k].sum()) / n for k in range(grades - 1)])
        gaps = np.exp(p[m + 1 :])
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([x.T @ (d_up - d_down) / n + ridge * p[:m], tail[:1], tail[1:] * gaps])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p - rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return p[:m], p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits the model on at most ``sample`` labelled rows."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many toxic and clean rows of the slice each feature occurs."""
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                features, row, n = _features(b.column("text"))
                label = b.column("toxic").to_numpy(zero_copy_only=False) > 0
                rows = np.tile(row, len(features))[features.ravel() > 0]
                h = features.ravel()[features.ravel() > 0]
                order = np.lexsort((rows, h))
                h, rows = h[order], rows[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                values, inverse = np.unique(h[new], return_inverse=True)
                bad = np.bincount(inverse, label[rows[new]], minlength=len(values)).astype(np.int64)
                both = np.bincount(inverse, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad), pa.array(both - bad)], ["feature", "bad", "good"])

    totals = texts.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    n_bad, n_good = totals
    none = Ordinal(Vocabulary(np.zeros(0)), np.zeros(0), np.full(len(LOADS) + 1, 40.0))
    if not n_bad or not n_good:
        return none
    sums = texts.mapInArrow(occurring, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    gain = (rate("bad", n_bad) - rate("good", n_good)) ** 2 / (rate("bad", n_bad) + rate("good", n_good))
    often = sums.filter(F.col("bad") + F.col("good") >= max(3, SUPPORT * (n_bad + n_good)))
    best = often.orderBy(gain.desc(), "feature").limit(VOCABULARY).collect()
    order = np.argsort(np.array([r.feature for r in best], np.int64).view(np.uint64))
    best = [best[i] for i in order]
    vocabulary = Vocabulary(np.array([r.feature for r in best], np.int64).view(np.uint64))
    marked = np.array([(r.bad + 0.5) / (n_bad + 1) > 8 * (r.good + 0.5) / (n_good + 1) for r in best], bool)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vocabulary's counts of every row, and its number of words with a marked feature."""
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                features, row, n = _features(b.column("text"))
                word, at = vocabulary.find(features)
                x = np.zeros((n, len(vocabulary)), "<f4")
                np.add.at(x, (row[word], at), 1)
                load = np.bincount(row[np.unique(word[marked[at]])], minlength=n)
                yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(load, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "load", "x"])

    # At most ``sample`` rows of VOCABULARY numbers, whatever the size of the tables: where ids
    # with several rows make more, those of the least hashes.
    rows = texts.mapInArrow(vectors, "toxic int, load long, x binary").orderBy(F.xxhash64("x", "toxic")).limit(sample).collect()
    x = np.stack([np.frombuffer(bytes(r.x), "<f4") for r in rows]).astype(float)
    load = np.array([r.load for r in rows])
    y = np.where([r.toxic > 0 for r in rows], 1 + sum((load >= t).astype(int) for t in LOADS), 0)
    weights, thresholds = fit_ordinal(np.log1p(x), y, len(LOADS) + 2)
    return Ordinal(vocabulary, weights, thresholds)


def scored(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """doc_id, severity, grade, p_toxic and the decision for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                severity, grade, p = sent.value.score(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(severity), pa.array(grade, pa.int32()), pa.array(p), pa.array(p >= reject)], SCORES_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


SCORES_NAMES = [c.split()[0] for c in SCORES.split(", ")]


def keep_clean(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """The rows that are not rejected, decided row by row: no join, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                yield b.filter(pa.array(sent.value.score(b.column("text"))[2] < reject))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
