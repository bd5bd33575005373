"""The category dimension: code and description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"""^\s*["']?([^\s"':#]+)["']?\s*:\s*["']?(.*?)["']?\s*$"""


def parse_dimension(lines: DataFrame) -> DataFrame:
    """(code, description) from lines ``code: description``; comments and blank lines are dropped."""
    value = F.col("value")
    rows = lines.where(~F.ltrim(value).startswith("#") & (F.trim(value) != ""))
    return (rows.select(F.regexp_extract(value, LINE, 1).alias("code"),
                        F.regexp_extract(value, LINE, 2).alias("description"))
            .where(F.col("code") != ""))


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Reads the mapping file; a missing file is Spark's path error."""
    return parse_dimension(spark.read.text(path))


def codes(dimension: DataFrame) -> DataFrame:
    return dimension.select("code")


def descriptions(dimension: DataFrame) -> DataFrame:
    return dimension.select("description")


def with_prefix(dimension: DataFrame, prefix: str) -> DataFrame:
    """Codes that start with the prefix, case-sensitive."""
    return dimension.where(F.col("code").startswith(prefix))


def pending(categories: DataFrame, done: DataFrame) -> DataFrame:
    """Categories without output yet."""
    return categories.join(done.select("category").distinct(), "category", "left_anti")
