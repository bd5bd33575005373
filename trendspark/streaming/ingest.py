"""Incremental ingest: landing files as a stream into the paper store."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trendspark.schema import RAW_PAPERS
from trendspark.sources import landing
from trendspark.sources.store import PaperStore, Seen


def landing_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(RAW_PAPERS).format(fmt)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def ingest_stream(spark: SparkSession, landing_path: str, store_root: str, checkpoint: str,
                  fmt: str = "parquet", files_per_batch: int = 1000) -> StreamingQuery:
    """Each batch commits on its own. A repeated batch finds its ids present and adds nothing.
    A stream is the only writer of its store while it runs."""
    store = PaperStore(spark, store_root)
    seen = functools.cache(lambda: Seen(store))  # read with the first batch

    def register(batch: DataFrame, _: int) -> None:
        store.register(landing.to_papers(landing.to_records(batch)), seen())

    return (landing_stream(spark, landing_path, fmt, files_per_batch).writeStream
            .foreachBatch(register).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
