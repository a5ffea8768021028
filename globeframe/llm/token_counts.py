"""Token counts as delta-maintained rollups.

A batch holds new states of documents: (doc_id, source, lang, tokenizer, n_tokens,
deleted).  ``Rollup.commit`` compares them with the states before the batch and turns
each into signed rows (minus the old count, plus the new one), summed by source,
language and tokenizer version.  Totals are the sum of all batches' signed rows, so they
are never recomputed from documents.  A batch is written under its own number and only
looks at smaller numbers: committing it again, after a failure or by mistake, replaces
its files with the same rows and the totals stay.  Which batches are committed is read
from the folder (a batch counts once its signed rows are written whole), so a new driver
goes on where the last one stopped.  ``compact`` writes the newest states in one table, so
that later batches read it and what came after it, not the whole history.

Defined results: a null text has 0 tokens; null source or lang is a group of its own; of
rows with one doc_id in a batch the greatest (deleted, source, lang, n_tokens) counts,
nulls least; a deletion of an unknown document changes nothing; rows with a null doc_id
are documents of their own, inserted each and never revised, and a deletion without an id
changes nothing; very long texts are counted whole; empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._store import Scratch, table
from .packing import encoder

GROUP = ["source", "lang", "tokenizer"]
STATE = ["deleted", "source", "lang", "n_tokens"]
VERSIONS = ("byte_bpe_50k", "words_1")


def _words(column) -> np.ndarray:
    data, offsets = _text.utf8(column)
    return np.bincount(_text.words(data, offsets)[2], minlength=len(offsets) - 1)


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Each document's count by each tokenizer version: a vocabulary's name, or words_1 for
    runs without ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _text.pieces(batch, "text"):
                for version in versions:
                    if version == "words_1":
                        n = _words(b.column("text"))
                    else:
                        encode = encoder(version)
                        n = [len(encode(x.as_py() or "")) for x in b.column("text")]
                    kept = [b.column(c) for c in ("doc_id", "source", "lang")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([version] * b.num_rows), pa.array(n, pa.int64())], ["doc_id", *GROUP, "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


class Rollup:
    """Signed batches below one shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or Scratch(spark, "rollup").root

    def _whole(self, kind: str) -> list[int]:
        """The numbers of a kind's tables that were written whole."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def batches(self) -> list[int]:
        """The numbers of the committed batches."""
        return self._whole("deltas")

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.root}/{kind}/{n}").withColumn("batch", F.lit(n)) for n in numbers]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def states(self, before: int | None = None) -> DataFrame | None:
        """The newest state of every document with an id, by tokenizer version."""
        older = lambda numbers: [n for n in numbers if before is None or n < before]
        compacted = older(self._whole("compacted"))[-1:]
        logs = [n for n in older(self.batches()) if not compacted or n > compacted[0]]
        parts = [p for p in (self._read("compacted", compacted), self._read("states", logs)) if p is not None]
        if not parts:
            return None
        newest = F.max_by(F.struct(*STATE), "batch").alias("s")
        known = reduce(DataFrame.unionByName, parts).filter("doc_id IS NOT NULL")
        return known.groupBy("doc_id", "tokenizer").agg(newest).select("doc_id", "tokenizer", "s.*")

    def compact(self, number: int) -> None:
        """Writes the newest states up to batch ``number`` as one table; totals stay as they are."""
        if (states := self.states(number + 1)) is not None:
            states.write.mode("overwrite").parquet(f"{self.root}/compacted/{number}")

    def commit(self, number: int, changes: DataFrame) -> None:
        """Adds batch ``number``; batches are committed in order of number."""
        key = ["doc_id", "tokenizer"]
        # Rows without an id are groups of one each, so the changes are computed once.
        nth = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        one = changes.groupBy(*key, nth.alias("nth")).agg(F.max(F.struct(*STATE)).alias("s")).select(*key, "s.*")
        where = f"{self.root}/states/{number}"
        one.write.mode("overwrite").parquet(where)
        new = self.spark.read.schema(one.schema).parquet(where)
        row = lambda df, sign: df.filter(~F.col("deleted")).select(*GROUP, "n_tokens", F.lit(sign).alias("sign"))
        signed = row(new, 1)
        if (old := self.states(number)) is not None:
            signed = signed.unionByName(row(old.join(new.select(*key).hint("merge"), key, "left_semi"), -1))
        delta = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/deltas/{number}")

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer; groups without documents are left out."""
        deltas = self._read("deltas", self.batches())
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is inserted; those labelled of low quality are revised to the text
    with its white space collapsed; those labelled toxic are deleted; then the last two
    batches are committed once more, which changes nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = Rollup(spark)
    live, gone = F.lit(False).alias("deleted"), F.lit(True).alias("deleted")
    rollup.commit(0, counted(docs).select("*", live))
    # Counted before the join: counts are a hundredth of the texts that would move otherwise.
    # Labels grow with the corpus, so no join broadcasts them.
    tidy = docs.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    poor = labels.filter("quality = 0").select("doc_id").distinct()
    revised = Scratch(spark, "revised").save(counted(tidy).join(poor.hint("merge"), "doc_id", "left_semi").select("*", live))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    for _ in range(2):
        rollup.commit(1, revised)
        dropped = rollup.states(2).drop("deleted").join(toxic.hint("merge"), "doc_id", "left_semi").select("*", gone)
        rollup.commit(2, dropped)
    return rollup.totals()
