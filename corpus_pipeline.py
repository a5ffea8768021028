"""A corpus pipeline: five stages, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns of
documents.

Defined results, for every stage: an empty table gives no rows; null, empty and very long
texts are documents like others, processed whole; rows with a null doc_id are never
dropped for what another row holds; columns besides doc_id and text pass through, whatever
their names.  What else a stage defines stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from globeframe.llm import decontaminate, near_duplicates, packing, suffix_dedup, toxicity
from globeframe.llm._store import Scratch, table

#: Words in a shingle of the near-duplicate stage.
WORDS = 5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal model rejects; it is trained on the labelled
    documents of the corpus.  Without labels of both kinds it drops none; texts without a
    word are scored as empty; equal texts fare alike."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and one row of
    it.  Texts without a word are nobody's duplicates."""
    return near_duplicates.deduplicated(docs, WORDS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the bytes of 50-byte strings that a document with a smaller id has, and characters
    that a cut leaves in part; a text cut to nothing stays, n_chars is counted anew."""
    return suffix_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 80 per cent of a benchmark item's five-word shingles, or all
    of a shorter item.  Items without a word or an id drop none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences: one row for each piece; an empty text is one
    piece, its end."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models, suffix sorts and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
