"""Trend analytics over dated, categorised texts, as PySpark jobs."""

from trendspark.session import build_session

__all__ = ["build_session"]
