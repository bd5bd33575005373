"""Ingest: landed records of a period into the paper store, in one job."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from trendspark.sources import landing
from trendspark.sources.store import PaperStore


def backfill(spark: SparkSession, landing_path: str, store_root: str, start: date, end: date,
             fmt: str = "parquet") -> PaperStore:
    """Every day from ``start`` to ``end`` once. Running it again, or over an overlap, adds nothing."""
    raw = landing.read_landing(spark, landing_path, fmt)
    store = PaperStore(spark, store_root)
    store.register(landing.to_papers(landing.scan_date_range(raw, start, end)))
    return store


def register_ids(spark: SparkSession, landing_path: str, store_root: str, ids, fmt: str = "parquet") -> PaperStore:
    """The records of the listed ids."""
    raw = landing.read_landing(spark, landing_path, fmt)
    store = PaperStore(spark, store_root)
    store.register(landing.to_papers(landing.scan_ids(raw, ids)))
    return store
