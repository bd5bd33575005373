"""Small per-category tables folded into one array per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.schema import OUTLIER


def by_topic(df: DataFrame, value: str, name: str) -> DataFrame:
    """(category, name): array whose place topic + 1 holds the topic's value, NULL for a gap."""
    top = df.groupBy("category").agg(F.max("topic").alias("_top"))
    grid = top.select("category", F.explode(F.sequence(F.lit(OUTLIER), "_top")).alias("topic"))
    return (grid.join(df.select("category", "topic", F.col(value).alias("_v")), ["category", "topic"], "left")
            .groupBy("category")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "_v"))), lambda e: e["_v"]).alias(name)))


def of_topic(array: str, topic: Column) -> Column:
    return F.get(F.col(array), topic - F.lit(OUTLIER))
