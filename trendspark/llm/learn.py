"""Bounded training samples and calibration shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.tables import fold

HASH_BITS = 40
BLOCK = 512


def learning(doc_id: Column, parts: int, held: int) -> Column:
    """True for rows to learn from; the others are held out."""
    return fold(doc_id, parts) != held


def known_labels(labels: DataFrame, name: str, parts: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows to learn from: the mean of all non-null labels of an id."""
    return (labels.where(F.col(name).isNotNull() & learning(F.col("doc_id"), parts, held))
            .groupBy("doc_id").agg(F.avg(F.col(name).cast("double")).alias("label")))


def hashed_share(doc_id: Column, share: Column) -> Column:
    """Keeps about ``share`` of the rows by a hash of the id, the same rows every time."""
    place = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << HASH_BITS)) / F.lit(float(1 << HASH_BITS))
    return place < share


def per_class_sample(rows: DataFrame, label: str, bound: int) -> tuple[DataFrame, dict]:
    """About ``bound`` rows of each class, and how many rows each class has in all."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row per class
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(min(1.0, bound / count))).otherwise(share)
    return rows.where(hashed_share(F.col("doc_id"), share)), counts


def sample_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of a bounded sample: ``wanted`` (doc_id, ...) is at most a few thousand rows."""
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def temperature(logits: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits that gives held-back rows the highest likelihood.

    ``logits`` is rows x classes and ``target`` the class of each row.
    """
    if not len(target):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 120))
    loss = [-(weight * np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def summed(docs: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of a vector of fixed size that each task counts in its rows.

    The vectors are dealt out in blocks and summed row by row, so a task holds its blocks
    only, however many tasks there are. The driver gets one vector.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches).astype(float)
        blocks = range(-(-len(total) // BLOCK))
        yield pa.RecordBatch.from_arrays([
            pa.array(blocks, pa.int32()),
            pa.array([total[b * BLOCK:(b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
                value = np.frombuffer(part)
                held[block] = held[block] + value if block in held else value
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                          pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "part"])

    rows = docs.mapInArrow(partial, "block int, part binary").repartition("block").mapInArrow(add, "block int, part binary")
    return np.concatenate([np.zeros(0), *(np.frombuffer(r.part) for r in sorted(rows.collect(), key=lambda r: r.block))])
