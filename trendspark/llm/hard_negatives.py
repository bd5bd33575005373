"""Hard negatives by Four-Russians scoring.

Components become integers floor(scale * x). Of a block of candidates the bits of one plane
(two's complement, the top plane counts negative) of eight dimensions make a byte, so a
candidate is planes x groups packed bytes. For an anchor and each group of eight dimensions
a table holds the sums of all 256 subsets of the anchor's eight components. A score is then
read off the tables: planes from the top, shift what there is by one bit, add the entries of
the plane's bytes. These are full exact integer inner products, not estimates.

Anchors are a stated part of all rows. Candidate blocks and anchor blocks meet in the cells
of a grid (``vectors.cells``); a cell keeps running best lists per anchor and returns those.
A first pass finds each anchor's positives; the second knows their scores and returns the
best rows of other labels within the allowed range below each positive.

Edge cases: a row with a null id, a null label, a null vector or a null or non-finite
component takes no part. Vectors of different lengths are compared with zeros in place of the
missing components; an empty vector scores 0 everywhere. Rows that share an id are rows of
their own as candidates, but none is "another row" of an anchor with that id; of anchor rows
with one id, the smallest (label, vector) is the anchor. An empty table, or one without
anchors, gives no rows. Extra columns are not read. Scores that could pass 2**55 raise an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.llm.tables import table
from trendspark.llm.vectors import Best, cells, each_cell, is_whole, matrix, numbers, parts_for, task_number
from trendspark.scratch import cut

GROUP = 8
BLOCK = 2048  # candidates of a block
TILE = 64  # anchors whose tables are made at once
ROWS_EACH, ANCHORS_EACH = 1 << 17, 1 << 15  # of a cell
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
LARGEST = 1 << 55

_BLOCK = "deal long, n int, planes int, groups int, ids binary, labels binary, bits binary"
_ANCHOR = "deal long, n int, width int, ids binary, labels binary, parts binary, limits binary"


def whole_numbers(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, floor(scale * x)) of the rows that take part."""
    rows, whole = matrix(batch.column("embedding"))
    whole &= np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("label").is_valid())
    rows = np.floor(rows[whole] * scale)
    if np.abs(rows).max(initial=0) >= LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return numbers(batch.column("vec_id"))[whole], numbers(batch.column("label"))[whole], rows.astype(np.int64)


def packed(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(planes, groups, bytes of shape planes x groups x rows): eight dimensions' bits of a plane in a byte."""
    n, width = values.shape
    groups = -(-width // GROUP)
    planes = 1 + max(int(values.max(initial=0)).bit_length(), int(~values.min(initial=0)).bit_length())
    full = np.zeros((n, groups * GROUP), np.int64)
    full[:, :width] = values
    bits = np.empty((planes, groups, n), np.uint8)
    for plane in range(planes):
        bits[plane] = np.packbits(((full >> plane) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return planes, groups, bits


def subset_sums(anchors: np.ndarray, groups: int, kind: type) -> np.ndarray:
    """Tables of shape groups x 256 x anchors: the sum of every subset of each group's eight components."""
    n, width = anchors.shape
    full = np.zeros((n, groups * GROUP), kind)
    full[:, :min(width, groups * GROUP)] = anchors[:, :groups * GROUP]
    full = np.ascontiguousarray(full.T).reshape(groups, GROUP, n)
    out = np.zeros((groups, 1 << GROUP, n), kind)
    for j in range(GROUP):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + full[:, j, None]
    return out


def scores(bits: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (candidates x anchors) by shifting and adding table entries."""
    planes, groups, n = bits.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    entry = np.empty_like(total)
    for plane in range(planes - 1, -1, -1):
        if plane < planes - 2:
            total <<= 1
        elif plane == planes - 2:
            total *= -2  # the top plane counts negative
        for group in range(groups):
            np.take(tables[group], bits[plane, group], axis=0, out=entry, mode="clip")
            total += entry
    return -total if planes == 1 else total


class Cell:
    """Anchors of a cell and their best lists, while candidate blocks pass by."""

    def __init__(self, places: int, k: int):
        self.places, self.best = places, Best(k, np.int64)
        self.ids, self.labels, self.values, self.limits = [], [], [], []

    def add_anchors(self, block: dict) -> None:
        n = block["n"]
        self.ids.append(np.frombuffer(block["ids"], np.int64))
        self.labels.append(np.frombuffer(block["labels"], np.int64))
        self.values.append(np.frombuffer(block["parts"], np.int64).reshape(n, block["width"]))
        if self.places > 1:  # (score, id) of each positive, scores below the smallest where there is none
            self.limits.append(np.frombuffer(block["limits"], np.int64).reshape(n, self.places, 2))

    def tiles(self, groups: int, planes: int):
        """(first anchor, ids, labels, limits, tables) of up to TILE anchors."""
        begin = 0
        for nth, values in enumerate(self.values):
            for low in range(0, len(values), TILE):
                part = values[low:low + TILE]
                largest = int(np.abs(part).sum(axis=1).max(initial=0)) << planes
                if largest >= LARGEST:
                    raise ValueError(f"scores could reach {largest}")
                limits = self.limits[nth][low:low + TILE] if self.limits else None
                yield (begin + low, self.ids[nth][low:low + TILE], self.labels[nth][low:low + TILE], limits,
                       subset_sums(part, groups, np.int32 if largest < 1 << 31 else np.int64))
            begin += len(values)

    def add_rows(self, block: dict) -> None:
        n, groups = block["n"], block["groups"]
        ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
        bits = np.frombuffer(block["bits"], np.uint8).reshape(block["planes"], groups, n).astype(np.intp)
        for begin, own, label, limits, tables in self.tiles(groups, block["planes"]):
            found = scores(bits, tables).astype(np.int64)
            if limits is None:
                self.nearest(begin, own, label, ids, labels, found)
            else:
                self.within(begin, label, limits, ids, labels, found)

    def nearest(self, begin, own, label, ids, labels, found) -> None:
        """Rows of the anchor's label, best first."""
        least = self.best.least(begin + len(own), -LARGEST)[begin:]
        hit = (labels[:, None] == label) & (found >= least)
        hit &= ids[:, None] != own
        row, anchor = np.nonzero(hit)
        self.best.add(anchor + begin, found[row, anchor], ids[row])

    def within(self, begin, label, limits, ids, labels, found) -> None:
        """Rows of another label whose score lies between the allowed shares of a positive's."""
        group = (np.arange(len(label)) + begin)[:, None] * self.places + np.arange(self.places)
        least = self.best.least(int(group[-1, -1]) + 1, -LARGEST)[group]
        score = limits[:, :, 0]
        low = np.maximum(-(-LOW * score // 100), least)
        high = np.where(score > -LARGEST, HIGH * score // 100, -LARGEST)
        some = low <= high
        lowest = np.where(some, low, LARGEST).min(axis=1)
        highest = np.where(some, high, -LARGEST).max(axis=1)
        row, anchor = np.nonzero((found >= lowest) & (found <= highest) & (labels[:, None] != label))
        value = found[row, anchor]
        for place in range(self.places):
            fits = (value >= low[anchor, place]) & (value <= high[anchor, place])
            self.best.add(group[anchor[fits], place], value[fits], ids[row[fits]])


def candidate_blocks(vectors: DataFrame, scale: int) -> DataFrame:
    """Blocks of packed bit planes of all rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = task_number()
        for batch in batches:
            ids, labels, values = whole_numbers(batch, scale)
            for low in range(0, len(ids), BLOCK):
                part = slice(low, low + BLOCK)
                planes, groups, bits = packed(values[part])
                deal += 1
                yield pa.RecordBatch.from_pydict({
                    "deal": pa.array([deal], pa.int64()), "n": pa.array([bits.shape[2]], pa.int32()),
                    "planes": pa.array([planes], pa.int32()), "groups": pa.array([groups], pa.int32()),
                    "ids": [ids[part].tobytes()], "labels": [labels[part].tobytes()], "bits": [bits.tobytes()]})

    return vectors.mapInArrow(run, _BLOCK)


def anchor_blocks(anchors: DataFrame, scale: int, places: int) -> DataFrame:
    """Blocks of anchors; ``known`` holds the positives as (score, id), if there are any yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = task_number()
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                ids, labels, values = whole_numbers(part, scale)
                limits = np.full((len(ids), places, 2), -LARGEST, np.int64)
                if places > 1:
                    for i, known in enumerate(part.column("known").to_pylist()):
                        limits[i, :len(known)] = [(x["score"], x["vec_id"]) for x in known]
                if len(ids):
                    deal += 1
                    yield pa.RecordBatch.from_pydict({
                        "deal": pa.array([deal], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
                        "width": pa.array([values.shape[1]], pa.int32()), "ids": [ids.tobytes()],
                        "labels": [labels.tobytes()], "parts": [values.tobytes()], "limits": [limits.tobytes()]})

    return anchors.mapInArrow(run, _ANCHOR)


def searched(anchors: DataFrame, rows: DataFrame, places: int, k: int, grid: tuple[int, int]) -> DataFrame:
    """(anchor_id, place, vec_id, score): the ``k`` best rows per anchor and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Cell] = []

        def begin():
            held[:] = [Cell(places, k)]

        def end():
            cell = held[0]
            best, ids = cell.best, np.concatenate(cell.ids) if cell.ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[best.group // places]), pa.array((best.group % places).astype(np.int32)),
                 pa.array(best.ident), pa.array(best.score)], ["anchor_id", "place", "vec_id", "score"])

        yield from each_cell(batches, begin, lambda b: held[0].add_anchors(b), lambda b: held[0].add_rows(b), end)

    found = (cells(anchors, rows, *grid)
             .mapInArrow(run, "anchor_id long, place int, vec_id long, score long"))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding. Positives are the anchor's best rows of its
    own label; negatives are rows of other labels that score from LOW to HIGH percent of the
    positive's score, best first.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             "embedding")
    anchors = (vectors.where(is_anchor & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                             & is_whole("embedding"))
               .groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
               .select("vec_id", "row.*"))
    anchors = cut(anchors, "anchors")
    rows = cut(candidate_blocks(vectors, scale), "candidate-blocks")
    size = rows.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    s = parts_for(anchors.count(), ANCHORS_EACH, 1, 1)
    grid = parts_for(size.n or 0, ROWS_EACH, size.blocks, spark.sparkContext.defaultParallelism), s
    known = searched(anchor_blocks(anchors, scale, 1), rows, 1, positives, grid)
    known = known.groupBy("anchor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))),
                    lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("known"))
    known = cut(anchors.join(known, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "positives")
    found = searched(anchor_blocks(known, scale, max(2, positives)), rows, max(2, positives), negatives, grid)
    of = known.select(F.col("vec_id").alias("of_anchor"), F.posexplode("known").alias("of_place", "positive"))
    return (found.join(of, (F.col("anchor_id") == F.col("of_anchor")) & (F.col("place") == F.col("of_place")))
            .select("anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank",
                    F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
                    F.col("score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, a.label as own, c.vec_id, c.label,
           cast(list_sum(list_transform(list_zip(a.q, c.q), lambda p: p[1] * p[2])) as bigint) as score
    from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
positive as (
    select anchor_id, own, vec_id as positive_id, score as positive_score
    from scored where label = own
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over best as integer) as rank, s.vec_id as negative_id,
       positive_score, s.score as negative_score
from positive join scored s using (anchor_id)
where s.label <> s.own and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
window best as (partition by anchor_id, positive_id order by s.score desc, s.vec_id)
qualify row_number() over best <= 5
"""
