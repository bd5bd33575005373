"""Reading tables and Arrow columns for the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.operators.sieve import free_name, sieve

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(parts)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the id and the text's digest together as the id.

    Operators carry any type of id, so their decisions can be brought back to the rows even
    where different texts share an id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("doc_id", F.sha2(text, 256).alias("text_sha256")).alias("doc_id"), text.alias("text"))


def same_row(docs: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, Column, str]:
    """Both sides of a join on (doc_id, text_sha256), the condition, and the column added to ``docs``."""
    sha, other_id, other_sha = (free_name(docs.columns, x) for x in ("row_sha", "other_id", "other_sha"))
    docs = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    other = other.select(F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other_sha))
    return docs, other, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(sha) == F.col(other_sha)), sha


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not among ``gone`` (doc_id, text_sha256), with all their columns.

    Only the rows that the sieve lets through are compared exactly, and so shuffled.
    """
    left, right, same, sha = same_row(docs, gone)
    clear, maybe = sieve(left, [F.col("doc_id"), F.col(sha)], right)
    return clear.union(maybe.join(right, same, "left_anti")).drop(sha)


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are among ``wanted`` (doc_id, text_sha256), with all their columns."""
    left, right, same, sha = same_row(docs, wanted)
    return sieve(left, [F.col("doc_id"), F.col(sha)], right)[1].join(right, same, "left_semi").drop(sha)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column end to end, and where each begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes of text, one row at least, with their bytes and bounds.

    A slice bounds the memory of the numpy work on it; a single longer text is a slice of its own.
    """
    try:
        for batch in batches:
            data, at = utf8(batch.column(text))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
                yield batch.slice(low, high - low), data[at[low]:at[high]], at[low:high + 1] - at[low]
                low = high
    finally:
        batch = data = at = None
        release()


def release() -> None:
    """Hands free memory back to the system.

    Python workers live on after a task; what the allocators of all idle workers hold for the
    next one adds up within an executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
