"""Parameters that follow from the number of papers in a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def min_df(n: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(2), F.floor(n * F.lit(0.0001)).cast("int")))


def max_df(n: Column) -> Column:
    return F.floor(n * F.lit(0.65)).cast("long")


def n_neighbors(n: Column) -> Column:
    """Ten, and eleven once the logistic term reaches one in double precision."""
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.00005) * (n - F.lit(20000))))
    return F.floor(F.lit(10.0) + logistic).cast("int")


def min_cluster_size(n: Column) -> Column:
    return F.floor(F.sqrt(n)).cast("int")


def min_samples(n: Column) -> Column:
    return F.floor(min_cluster_size(n) / F.lit(1.5)).cast("int")


def corpus_parameters(members: DataFrame) -> DataFrame:
    """(category, n, min_df, max_df, n_neighbors, min_cluster_size, min_samples) from one row per paper."""
    n = F.col("n")
    return members.groupBy("category").agg(F.count("*").alias("n")).select(
        "category", "n",
        min_df(n).alias("min_df"),
        max_df(n).alias("max_df"),
        n_neighbors(n).alias("n_neighbors"),
        min_cluster_size(n).alias("min_cluster_size"),
        min_samples(n).alias("min_samples"),
    )
