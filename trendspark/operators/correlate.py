"""Topic-to-topic similarity from the sparse distribution.

Only papers that both topics share enter the sums: the cosine because a product with 0 is
0, the Jensen-Shannon divergence because its value without overlap is ln 2 and each shared
paper adds a term to that. A paper's row holds its own topics only; pairs are made and
summed inside the task, so what is shuffled are K x K partial sums, never pairs of papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions.arrays import by_topic, of_topic
from trendspark.scratch import cut

# fixed values
COSINE_WEIGHT = 0.3
JS_WEIGHT = 0.7


def topic_mass(distribution: DataFrame) -> DataFrame:
    return distribution.groupBy("category", "topic").agg(
        F.sum("p").alias("mass"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))


def pair_sums(distribution: DataFrame, mass: DataFrame) -> DataFrame:
    """(category, i, j, dot, overlap) for i < j with a shared paper."""
    masses = cut(by_topic(mass.where("mass > 0"), "mass", "_mass"), "topic-mass")
    rows = (distribution.where("p > 0")
            .groupBy("category", "paper_id").agg(F.collect_list(F.struct("topic", "p")).alias("_items"))
            .join(masses, "category")
            .select("category", F.transform("_items", lambda x: F.struct(
                x["topic"].alias("topic"), x["p"].alias("p"),
                (x["p"] / of_topic("_mass", x["topic"])).alias("q"))).alias("_items")))
    pairs = (rows.select("category", "_items", F.explode("_items").alias("a"))
             .select("category", "a", F.explode("_items").alias("b"))
             .where(F.col("a.topic") < F.col("b.topic")))
    qa, qb = F.col("a.q"), F.col("b.q")
    shared = qa * F.log(qa / (qa + qb)) + qb * F.log(qb / (qa + qb))
    return pairs.groupBy("category", F.col("a.topic").alias("i"), F.col("b.topic").alias("j")).agg(
        F.sum(F.col("a.p") * F.col("b.p")).alias("dot"), F.sum(shared).alias("overlap"))


def upper_pairs(topics: DataFrame) -> DataFrame:
    """(category, i, j) for i < j over the topics of each category: the cells of the result itself."""
    peers = topics.groupBy("category").agg(F.collect_set("topic").alias("_peers"))
    return (topics.select("category", F.col("topic").alias("i")).join(peers, "category")
            .select("category", "i", F.explode("_peers").alias("j")).where("i < j"))


def similarities(distribution: DataFrame, topics: DataFrame) -> DataFrame:
    """(category, i, j, cosine, js) for all i < j.

    ``js`` is one minus the Jensen-Shannon distance, NULL if a topic has no mass; the
    cosine is then 0.
    """
    mass = topic_mass(distribution)
    sums = pair_sums(distribution, mass)
    left = mass.select("category", F.col("topic").alias("i"), F.col("norm").alias("norm_i"))
    right = mass.select("category", F.col("topic").alias("j"), F.col("norm").alias("norm_j"))
    cells = (upper_pairs(topics).join(sums, ["category", "i", "j"], "left")
             .join(left, ["category", "i"], "left").join(right, ["category", "j"], "left"))
    alive = (F.col("norm_i") > 0) & (F.col("norm_j") > 0)
    squared = F.log(F.lit(2.0)) + F.coalesce("overlap", F.lit(0.0)) / 2
    return cells.select(
        "category", "i", "j",
        F.when(alive, F.coalesce("dot", F.lit(0.0)) / (F.col("norm_i") * F.col("norm_j")))
        .otherwise(F.lit(0.0)).alias("cosine"),
        F.when(alive, F.lit(1.0) - F.sqrt(F.greatest(F.lit(0.0), squared))).alias("js"))


def correlations(distribution: DataFrame, topics: DataFrame) -> DataFrame:
    """(category, i, j, corr) for all ordered pairs; the diagonal is 1, a topic without mass gives NULL."""
    blend = (F.lit(COSINE_WEIGHT) * (F.col("cosine") * 2 - 1) + F.lit(JS_WEIGHT) * (F.col("js") * 2 - 1))
    upper = similarities(distribution, topics).withColumn("corr", F.when(
        blend.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), blend))))
    both = upper.select("category", "corr", F.explode(F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("_cell"))
    diagonal = topics.select("category", F.col("topic").alias("i"), F.col("topic").alias("j"),
                             F.lit(1.0).alias("corr"))
    return both.select("category", "_cell.i", "_cell.j", "corr").unionByName(diagonal)


def correlation_range(corr: DataFrame) -> DataFrame:
    return corr.groupBy("category").agg(F.min("corr").alias("lowest"), F.max("corr").alias("highest"))
