"""The corpus pipeline: documents that a training set can use, packed into sequences.

Each stage takes (spark, docs, sf_dir) and all of what the stage before kept, and returns a
table that is written and read again before the next. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendspark.llm import decontaminate, exact_dedup, forest_join, packing, toxicity
from trendspark.llm.tables import table
from trendspark.scratch import cut


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half for toxicity."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_first(docs)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents, the one with the smallest id."""
    return forest_join.one_of_each_class(docs)


def benchmark_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return packing.piece_digests(docs)


STAGES = [("toxicity", toxic_removed), ("exact_dedup", exact_copies_removed), ("jaccard_join", near_copies_removed),
          ("decontamination", benchmark_removed), ("packing", packed)]

# A trained classifier and a tokenizer decide; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
