"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.scratch import cut, drop

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is a node of the component.

    Each round every node points at its neighbour of the smallest random priority, or at
    itself; two jumps shorten the chains, and the edges are drawn anew between the nodes
    pointed at. Priorities differ by round, so chains are short whatever the ids and a round
    removes a fixed share of the nodes. Each round reads tables that the one before wrote.
    """
    edges = cut(edges.where("a <> b").distinct(), "edges")
    roots = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                .withColumn("root", F.col("node")), "roots")
    for turn in range(ROUNDS):
        if edges.isEmpty():
            drop(edges)
            return roots
        both = edges.union(edges.select("b", "a"))
        rank = F.xxhash64(F.lit(turn), "b")
        own = F.xxhash64(F.lit(turn), "a")
        best = both.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("at"))).alias("best"))
        points = best.select("a", F.least("best", F.struct(own.alias("rank"), F.col("a").alias("at")))["at"].alias("to"))
        before = edges, roots
        points = cut(points, "points")
        for _ in range(2):
            further = points.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
            before += (points,)
            points = cut(points.join(further, "to").select("a", F.col("beyond").alias("to")), "points")
        ahead = points.select(F.col("a").alias("root"), "to")
        roots = cut(roots.join(ahead, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        edges = cut(edges.join(points, "a").select(F.col("to").alias("a"), "b")
                    .join(points.select(F.col("a").alias("b"), F.col("to").alias("b_to")), "b")
                    .select("a", F.col("b_to").alias("b")).where("a <> b").distinct(), "edges")
        drop(points, *before)
    raise RuntimeError(f"edges left after {ROUNDS} rounds")
