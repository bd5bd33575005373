"""Cutting lineage by tables in the shared folder.

Iterative jobs (graph rounds, numbered rows) write their state as parquet and read it
back. A lost executor then costs one task, never the rounds before it, and each step is
computed once: ``DataFrame.checkpoint`` computes an unpersisted plan twice, once to
materialise and once to write.

A job that knows when its tables are read for the last time opens a ``scope``. What is cut
inside belongs to the scope and is deleted at its end, also when the job fails; only tables
that are ``kept`` go on to the scope around it, or stay where there is none. Rounds ``drop``
the tables of the round before. Nothing else is ever deleted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
GROUP_BYTES = 8 << 20
_PATH = "_scratch_path"
_open: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """The scratch tables that one job owns."""

    def __init__(self, around: Scope | None):
        self.around, self.tables = around, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Hands a table that was cut in this scope on to the scope around it."""
        path = getattr(df, _PATH)
        if self.around is not None:
            self.around.tables[path] = self.tables[path]
        del self.tables[path]
        return df


@contextmanager
def scope() -> Iterator[Scope]:
    """Owns the tables cut inside; the block must not return anything that still reads them, but for kept ones."""
    own = Scope(_open.get())
    before = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(before)
        for path, spark in own.tables.items():
            _delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more; other data frames are left alone."""
    for df in tables:
        path, own = getattr(df, _PATH, None), _open.get()
        while own is not None and path is not None:
            own.tables.pop(path, None)
            own = own.around
        if path is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names, or a temporary one in local mode only."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named
    named = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="trendspark-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Writers and readers hold a whole row group, and a group is not closed before its 100th row. With
    ``large_rows``, rows of megabytes, a group is closed once it has ``GROUP_BYTES``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _open.get() is not None:  # also what a failed write leaves
        _open.get().tables[path] = spark
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1,
              "parquet.page.size.row.check.max": 1} if large_rows else {}
    df.write.options(**groups).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    setattr(written, _PATH, path)
    return written
