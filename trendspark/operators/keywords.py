"""Daily keyword counts by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions.text import kept_tokens
from trendspark.schema import KEYWORDS

KEY = ["token", "category", "published"]
COUNTS = ["title_count", "abstract_count", "count"]


def daily_counts(papers: DataFrame, bridge: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each token by category and day, in titles and in abstracts.

    Texts are split once per paper, not once per category, and counted by paper where they
    are. A token of a paper is shuffled once, with the list of its categories, by token and
    day; categories are spread where the counts of a day meet.
    """
    names = bridge.groupBy("paper_id").agg(F.collect_set("category").alias("_names"))

    def words(column: str, in_title: int):
        kept = kept_tokens(F.coalesce(F.col(column), F.lit("")), stop_words)
        return F.transform(kept, lambda token: F.struct(
            token["word"].alias("token"), F.lit(in_title).alias("in_title")))

    split = papers.join(names.hint("shuffle_hash"), "paper_id").select(
        "paper_id", "published", "_names", F.concat(words("title", 1), words("abstract", 0)).alias("_words"))
    # an outer explode: a plain one lets Spark test the words for emptiness, that is split the
    # texts, once more before they are spread
    by_paper = (split.select("paper_id", "published", "_names", F.explode_outer("_words").alias("_word"))
                .where(F.col("_word").isNotNull())
                .groupBy("paper_id", "published", "_names", F.col("_word.token").alias("token"))
                .agg(F.sum(F.col("_word.in_title").cast("long")).alias("title_count"), F.count("*").alias("count")))
    rows = (by_paper.drop("paper_id").repartition("token", "published")
            .select("published", "token", F.explode("_names").alias("category"), "title_count", "count"))
    return (rows.groupBy(*KEY)
            .agg(F.sum("title_count").alias("title_count"),
                 (F.sum("count") - F.sum("title_count")).alias("abstract_count"),
                 F.sum("count").alias("count"))
            .select(*KEYWORDS.fieldNames()))


def upsert(current: DataFrame, increments: DataFrame) -> DataFrame:
    """Known keys grow by the increments, new keys are added."""
    return (current.unionByName(increments).groupBy(*KEY)
            .agg(*[F.sum(name).alias(name) for name in COUNTS]))


def lookup(keywords: DataFrame, category: str, year: int, month: int, day: int | None = None) -> DataFrame:
    """Rows of one category and month, or one day of it.

    The month is a range of dates, so that the predicate reaches the scan.
    """
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    published = F.col("published")
    if day is not None:
        period = published == F.make_date(F.lit(year), F.lit(month), F.lit(day))
    else:
        period = (published >= first) & (published < F.add_months(first, 1))
    return keywords.where((F.col("category") == category.lower()) & period)
