"""Language identification: each document as a mixture of languages.

Every language has a smoothed distribution over hashed byte trigrams inside words.  A
word's likelihood in a language is the product over its trigrams; a document's language
proportions are the mixture weights that expectation-maximisation fits to its words.  The
set of languages is chosen by penalised likelihood: languages leave, smallest weight
first, while the Bayesian information criterion falls.  The prediction is the language of
the largest proportion.

The distributions are fitted on a bounded sample, about ``PER_LANG`` rows of each language
by hash of doc_id, for the ``LANGS`` most frequent ones; what reaches the driver is at most
``BUCKETS`` counts a language.  Whole texts are predicted.

Defined results: a text that is null or has no letter gets ``und`` with score 0; without
any training row every text gets ``und``; ties go to the smaller language code; repeated
rows are predicted each; a row with a null doc_id is predicted, is not held out and is not
learned from; very long texts are predicted whole; an empty table gives no rows; lang and
source are never read when predicting, other columns never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._store import table

PER_LANG = 1500
BUCKETS = 1 << 15
#: Expectation-maximisation ends once no proportion moves by more than this.
SETTLED = 1e-4
ROUNDS = 200
#: Languages learned: the most frequent ones.
LANGS = 256
FOLDS = 3
UNKNOWN = "und"
#: Words are runs of ASCII letters and bytes over 127.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
OUT = "doc_id long, lang_pred string, score double, proportions map<string,double>"


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """(bucket, start of each word among the buckets, row of each word): a word of n bytes has
    n trigrams, padded with blanks at its ends."""
    data = _text.LOWER[data]
    start, end, row = _text.words(data, offsets, NO_LETTER)
    size = end - start
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())
    blank = np.uint32(32)
    before = np.where(np.arange(len(at)) == np.repeat(first, size), blank, data[at - 1])
    after = np.where(np.arange(len(at)) == np.repeat(first + size - 1, size), blank, data[np.minimum(at + 1, len(data) - 1)])
    code = before.astype(np.uint32) << 16 | data[at].astype(np.uint32) << 8 | after.astype(np.uint32)
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) % BUCKETS, first, row


@dataclass
class Mixture:
    langs: list[str]
    log_p: np.ndarray  # BUCKETS x languages

    def weights(self, word_log: np.ndarray) -> np.ndarray:
        """Proportions of the languages that the penalised likelihood keeps."""
        n = len(word_log)
        peak = word_log.max(1, keepdims=True)
        p = np.exp(word_log - peak)
        base = float(peak.sum())
        chosen = np.arange(p.shape[1])

        def em(cols: np.ndarray) -> tuple[np.ndarray, float]:
            sub, w = p[:, cols], np.full(len(cols), 1 / len(cols))
            for _ in range(ROUNDS if len(cols) > 1 else 0):
                new = w * (sub.T @ (1 / np.maximum(sub @ w, 1e-300))) / n
                moved, w = np.abs(new - w).max(), new
                if moved < SETTLED:
                    break
            return w, base + float(np.log(np.maximum(sub @ w, 1e-300)).sum())

        w, like = em(chosen)
        while len(chosen) > 1:
            fewer = np.delete(chosen, w.argmin())
            w2, like2 = em(fewer)
            if -2 * like2 + (len(fewer) - 1) * np.log(n) > -2 * like + (len(chosen) - 1) * np.log(n):
                break
            chosen, w, like = fewer, w2, like2
        out = np.zeros(p.shape[1])
        out[chosen] = w
        return out

    def predict(self, column) -> list[tuple[str, float, dict[str, float]]]:
        data, offsets = _text.utf8(column)
        out = [(UNKNOWN, 0.0, {})] * (len(offsets) - 1)
        if not len(data) or not self.langs:
            return out
        code, first, row = trigrams(data, offsets)
        if not len(code):
            return out
        word_log = np.add.reduceat(self.log_p[code], first, axis=0)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        ascii_letter = np.concatenate([[0], np.cumsum((data < 128) & ~NO_LETTER[data])])[offsets]
        for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if s == e or ascii_letter[i] == ascii_letter[i + 1] and not any(map(str.isalpha, column[i].as_py())):
                continue
            w = self.weights(word_log[s:e])
            best = int(w.argmax())
            out[i] = (self.langs[best], float(min(1.0, w[best])), {a: float(x) for a, x in zip(self.langs, w, strict=True) if x > 0})
        return out


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Mixture:
    """Fits the trigram distributions; ``docs`` has doc_id, text and lang, rows for training only."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share = [(r.lang, min(1.0, per_lang / r.n)) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()]
    if not share:
        return Mixture([], np.zeros((BUCKETS, 0)))
    chance = F.broadcast(spark.createDataFrame(share, "lang string, chance double"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.col("chance") * 1_000_000
    sample = rows.join(chance, "lang").filter(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                data, offsets = _text.utf8(b.column("text"))
                if not len(data):
                    continue
                code, first, row = trigrams(data, offsets)
                names, which = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                size = np.diff(np.append(first, len(code)))
                cell, n = np.unique(np.repeat(which[row], size) * BUCKETS + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[cell // BUCKETS].tolist(), pa.string()), pa.array(cell % BUCKETS, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    langs = sorted(lang for lang, _ in share)
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[found["bucket"].to_numpy(int), [langs.index(x) for x in found["lang"]]] += found["n"].to_numpy(float)
    return Mixture(langs, np.log(counts / counts.sum(0)).astype(np.float32))


def predicted(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred, score and all proportions of every row; reads doc_id and text only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                lang, score, shares = zip(*sent.value.predict(b.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(lang), pa.array(score), pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "lang_pred", "score", "proportions"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold() != 1))
    out = predicted(docs, model).withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score", "proportions")
