"""The given tables seen as papers, categories and topic assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions.text import input_text
from trendspark.scratch import scratch_path
from trendspark.sources import buckets

# fixed values
FIRST_DAY = "2017-09-12"
LAST_DAY = "2025-09-17"
ENTRY_PREFIX = "http://example.org/abs/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper per document: the first line is the title, the rest the abstract."""
    text = F.col("text")
    cut_at = F.instr(text, "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("paper_id"),
        F.concat(F.lit("2309."), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("v1")).alias("arxiv_id"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.when(cut_at > 0, F.substr(text, cut_at + F.lit(1))).alias("abstract"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") * 7 % 2928).cast("int")).alias("published"),
        F.array(F.concat(F.lit("doc."), F.upper("lang")), F.col("source")).alias("categories"),
    )


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same papers in the shape of landed API records."""
    stamp = F.col("published").cast("timestamp")
    return papers(spark, sf_dir).select(
        F.concat(F.lit(ENTRY_PREFIX), "arxiv_id").alias("entry_id"),
        "title",
        F.col("abstract").alias("summary"),
        F.array(F.struct(F.element_at("categories", 2).alias("name"))).alias("authors"),
        "categories",
        stamp.alias("published"),
        stamp.alias("updated"),
        F.lit(None).cast("string").alias("pdf_url"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (papers(spark, sf_dir)
            .select("paper_id", F.explode("categories").alias("category"))
            .select("paper_id", F.lower("category").alias("category")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, paper_id, topic): the vector's label, -1 where a paper has no vector."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "label")
    return (bridge(spark, sf_dir).join(labels, "paper_id", "left")
            .select("category", "paper_id", F.coalesce("label", F.lit(-1)).cast("int").alias("topic")))


_stored: dict[tuple[str, str], DataFrame] = {}


def stored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers as a store holds them, bucketed by paper_id; stored once for a session and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        _stored[key] = buckets.append(papers(spark, sf_dir), scratch_path(spark, "papers"), "paper_id",
                                      buckets.default_buckets(spark))
    return _stored[key]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_papers(spark, sf_dir).select(
        "paper_id", input_text(F.col("title"), F.col("abstract")).alias("text"))
