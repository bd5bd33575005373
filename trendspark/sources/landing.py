"""Scans over landed API records.

The landing table replaces the remote API: every scan is one declarative plan over it, so
predicates on ``published`` reach the file scan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions.dates import window_end
from trendspark.schema import RAW_PAPERS


def read_landing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW_PAPERS).format(fmt).load(path)


def as_category_list(df: DataFrame, column: str = "categories") -> DataFrame:
    """A scalar category becomes a one-element list; a list stays."""
    if df.schema[column].dataType.typeName() == "array":
        return df
    return df.withColumn(column, F.array(column))


def to_records(raw: DataFrame) -> DataFrame:
    """Landed rows to records: the id is what follows the last ``abs/``, authors become names."""
    raw = as_category_list(raw)
    return raw.select(
        F.element_at(F.split("entry_id", "abs/"), -1).alias("arxiv_id"),
        "title", "summary",
        F.transform("authors", lambda author: author["name"]).alias("authors"),
        "categories",
        F.col("published").alias("published_date"),
        F.col("updated").alias("updated_date"),
        "pdf_url", "entry_id",
    )


def to_papers(records: DataFrame) -> DataFrame:
    """Records to papers: the day of publication, the summary as abstract."""
    return records.select(
        "arxiv_id", F.to_date("published_date").alias("published"),
        "title", F.col("summary").alias("abstract"), "categories",
    )


def in_window(day: Column, stamp: Column) -> Column:
    """Published from midnight of ``day`` to midnight of the next day, both included."""
    return (stamp >= day.cast("timestamp")) & (stamp <= window_end(day).cast("timestamp"))


def newest_first(raw: DataFrame, condition: Column | None = None, max_results: int | None = 50) -> DataFrame:
    """Matching records, newest first, ties by id, capped if asked."""
    rows = raw if condition is None else raw.where(condition)
    rows = to_records(rows).sort(F.desc("published_date"), "arxiv_id")
    return rows if max_results is None else rows.limit(max_results)


def scan_day(raw: DataFrame, day: date, max_results: int | None = 50) -> DataFrame:
    target = F.lit(day).cast("date")
    return newest_first(raw, in_window(target, F.col("published")), max_results)


def papers_of_day(raw: DataFrame, day: date, limit: int | None = 10) -> DataFrame:
    return to_papers(scan_day(raw, day, limit))


def scan_ids(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is in ``ids.arxiv_id``. The join side is Spark's choice by measured size."""
    return to_records(raw).join(ids.select("arxiv_id"), "arxiv_id", "left_semi")


def scan_date_range(raw: DataFrame, start: date, end: date) -> DataFrame:
    """What the day-by-day loop from ``start`` to ``end`` returns, as one scan.

    The windows are one day apart and two midnights long, so their union is the single
    interval from ``start`` to the day after ``end``; no per-day work is left.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    stamp = F.col("published")
    covered = (stamp >= first.cast("timestamp")) & (stamp <= window_end(last).cast("timestamp"))
    return to_records(raw.where(covered))


def day_hits(raw: DataFrame, start: date, end: date) -> DataFrame:
    """Records per queried day. A midnight record answers two neighbouring days."""
    stamp = F.col("published")
    day = F.to_date(stamp)
    midnight = stamp == day.cast("timestamp")
    days = F.when(midnight, F.array(F.date_sub(day, 1), day)).otherwise(F.array(day))
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return (raw.select(F.explode(days).alias("day"))
            .where(F.col("day").between(first, last))
            .groupBy("day").agg(F.count("*").alias("n")))
