"""Session builder for tests, the benchmark and stand-alone runs.

On a cluster the session comes from spark-submit; nothing in the library needs
more than Spark's defaults (adaptive execution on, skew join on).
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "trendspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
