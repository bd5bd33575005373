"""Trend reports of all categories that have a model and no report yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions.text import NGRAM_MAX
from trendspark.operators import correlate, distribution, report
from trendspark.schema import OUTLIER
from trendspark.scratch import cut
from trendspark.sources import store as tables
from trendspark.sources.catalog import pending
from trendspark.sources.store import Collection


def build_reports(papers: Collection, model: dict[str, DataFrame], moment: Column, stop_words: Sequence[str] = (),
                  longest: int = NGRAM_MAX) -> DataFrame:
    """(category, report). The distribution is computed once; series and correlations read the written table."""
    unique = papers.papers
    assignments = model["assignments"]
    members = assignments.select("category", "paper_id")
    shares = cut(distribution.topic_distribution(papers.texts(), members, model["vocabulary"], stop_words, longest),
                 "distribution")
    info = cut(report.topic_info(report.topic_sizes(assignments), model["keywords"]), "topic-info")
    topics = info.select("category", "topic")
    main = distribution.main_topic(shares, members)
    shown = report.representative_papers(
        model["representative_docs"].where(F.col("topic") != OUTLIER), unique)
    return report.assemble(info, correlate.correlations(shares, topics),
                           report.monthly_series(main, unique, topics), shown,
                           report.metadata(unique, members, moment))


def write_reports(spark: SparkSession, papers: Collection, model: dict[str, DataFrame], path: str, moment: Column,
                  stop_words: Sequence[str] = (), longest: int = NGRAM_MAX) -> DataFrame:
    """Adds the missing categories below ``path`` and returns (category, value) of all reports."""
    todo = cut(pending(papers.members.select("category").distinct(), tables.finished_categories(spark, path, "text")), "todo")
    open_model = {name: df.join(todo, "category", "left_semi") for name, df in model.items()}
    report.write_json(build_reports(papers.only(todo), open_model, moment, stop_words, longest), path)
    return spark.read.text(path, wholetext=True).select("category", "value")
