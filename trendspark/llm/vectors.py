"""Arrow vectors as matrices, dealing blocks into cells, and running best lists.

A search of a stated query set against all rows is laid out as a grid: the rows are dealt
into R parts, the queries into S, and a task (a cell) gets one part of each. A row is thus
sent S times and a query R times, and no cell holds more than the two bounded parts,
whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, shorter ones filled up with zeros, and which rows are whole.

    A row is whole if it is not null and has no null, infinite or undefined component.
    """
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    bounds = np.asarray(column.offsets, np.int64)
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0]).cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False)
    there = np.asarray(column.is_valid())
    length = np.diff(bounds)
    width = int(length.max(initial=0)) if width is None else width
    row = np.repeat(np.arange(len(length)), length)
    whole = there & (np.bincount(row[~np.isfinite(values)], minlength=len(length)) == 0)
    if (length == width).all():
        return values.reshape(len(length), width), whole
    out = np.zeros((len(length), width))
    place = np.arange(len(values)) - np.repeat(bounds[:-1] - bounds[0], length)
    out[row, place] = values
    return out, whole


def is_whole(embedding: Column | str) -> Column:
    """True for vectors without a null, infinite or undefined component; null for a null vector."""
    return F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def numbers(column: pa.Array) -> np.ndarray:
    """A column of integers as int64, null as 0."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def task_number() -> int:
    """The number of the running task, for dealing its blocks to different parts than other tasks' blocks."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def parts_for(n_rows: int, rows_each: int, n_blocks: int, parallelism: int) -> int:
    """How many parts: each within ``rows_each`` rows, and one per core where there are blocks enough."""
    return max(1, -(-n_rows // rows_each), min(parallelism, n_blocks))


def cells(queries: DataFrame, rows: DataFrame, r: int, s: int) -> DataFrame:
    """Blocks of both tables (with a column ``deal`` each) sent to their cells, queries first.

    Result: (cell, is_row, query, row), one of the two structs null. Each partition holds
    whole cells.
    """
    kinds = {name: table.drop("deal") for name, table in (("query", queries), ("row", rows))}
    sent = []
    for name, table, other in (("query", queries, "row"), ("row", rows, "query")):
        own = F.pmod("deal", F.lit(s if name == "query" else r))
        across = F.explode(F.sequence(F.lit(0), F.lit((r if name == "query" else s) - 1)))
        body = F.struct(*kinds[name].columns)
        table = table.select(own.cast("int").alias("own"), across.alias("across"), body.alias(name))
        cell = F.col("across") * s + F.col("own") if name == "query" else F.col("own") * s + F.col("across")
        empty = F.lit(None).cast(kinds[other].select(F.struct("*")).schema[0].dataType)
        both = {name: F.col(name), other: empty}
        sent.append(table.select(cell.alias("cell"), F.lit(name == "row").alias("is_row"),
                                 both["query"].alias("query"), both["row"].alias("row")))
    return (sent[0].unionByName(sent[1]).repartitionById(r * s, F.col("cell"))
            .sortWithinPartitions("cell", "is_row"))


def each_cell(batches: Iterator[pa.RecordBatch], begin: Callable, add_query: Callable, add_row: Callable,
              end: Callable) -> Iterator[pa.RecordBatch]:
    """Calls ``begin``, then ``add_query`` and ``add_row`` with each block, then yields from ``end``; for every cell."""
    at = None
    for batch in batches:
        cell, is_row = batch.column("cell").to_pylist(), batch.column("is_row").to_pylist()
        for i in range(batch.num_rows):
            if cell[i] != at:
                if at is not None:
                    yield from end()
                begin()
                at = cell[i]
            if is_row[i]:
                add_row(batch.column("row")[i].as_py())
            else:
                add_query(batch.column("query")[i].as_py())
    if at is not None:
        yield from end()


class Best:
    """The k best (score, id) of each list: higher scores first, ties to the smaller id."""

    def __init__(self, k: int, kind: type):
        self.k, self.group = k, np.zeros(0, np.int64)
        self.score, self.ident = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ident = (np.concatenate(x) for x in
                               ((self.group, group), (self.score, score), (self.ident, ident)))
        order = np.lexsort((ident, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        kept = order[np.arange(len(group)) - first < self.k]
        self.group, self.score, self.ident = group[np.arange(len(group)) - first < self.k], score[kept], ident[kept]

    def least(self, n_groups: int, low) -> np.ndarray:
        """The k-th best score of each list, ``low`` where it is shorter."""
        out = np.full(n_groups, low, self.score.dtype)
        first = np.searchsorted(self.group, np.arange(n_groups + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        out[full] = self.score[first[full] + self.k - 1]
        return out
