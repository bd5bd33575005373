"""Incremental keyword counts.

Adding to stored counts cannot be repeated safely. So each batch writes its increments and
the ids it counted under its own batch id, overwriting what an earlier attempt of the same
batch left, and readers sum the increments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendspark.operators import keywords
from trendspark.schema import KEYWORDS
from trendspark.scratch import cut
from trendspark.sources import landing
from trendspark.sources.store import lower_categories, one_per_id, read_or_empty, unseen
from trendspark.streaming.ingest import landing_stream


def counted_ids(spark: SparkSession, root: str, except_batch: int | None = None) -> DataFrame:
    ids = read_or_empty(spark, f"{root}/ids", "arxiv_id string, batch_id int")
    if except_batch is not None:
        ids = ids.where(F.col("batch_id") != except_batch)
    return ids.select("arxiv_id")


def add_batch(spark: SparkSession, records: DataFrame, root: str, batch_id: int,
              stop_words: Sequence[str] = ()) -> None:
    papers = one_per_id(landing.to_papers(records))
    fresh = cut(unseen(papers, counted_ids(spark, root, batch_id))
                .withColumn("paper_id", F.col("arxiv_id")), "counted")
    bridge = fresh.select("paper_id", F.explode(lower_categories(F.col("categories"))).alias("category"))
    counts = keywords.daily_counts(fresh, bridge, stop_words)
    counts.write.mode("overwrite").parquet(f"{root}/counts/batch_id={batch_id}")
    fresh.select("arxiv_id").write.mode("overwrite").parquet(f"{root}/ids/batch_id={batch_id}")


def keyword_stream(spark: SparkSession, landing_path: str, root: str, checkpoint: str,
                   stop_words: Sequence[str] = (), fmt: str = "parquet",
                   files_per_batch: int = 1000) -> StreamingQuery:
    def count(batch: DataFrame, batch_id: int) -> None:
        add_batch(spark, landing.to_records(batch), root, batch_id, stop_words)

    return (landing_stream(spark, landing_path, fmt, files_per_batch).writeStream
            .foreachBatch(count).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/counts")
    return rows.groupBy(*keywords.KEY).agg(*[F.sum(name).alias(name) for name in keywords.COUNTS]).select(
        *KEYWORDS.fieldNames())
