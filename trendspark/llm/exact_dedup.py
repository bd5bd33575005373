"""Exact duplicates by recipes of content-defined chunks.

A text is cut where its own bytes say so, so equal texts are cut alike. Each chunk gets a
128-bit identifier; a text's recipe is the ordered list of its chunks' identifiers, about
one hundredth of the text. The identifiers are verified: every distinct (identifier, chunk)
is brought together once, after duplicates within a task are gone, and where one identifier
stands for two chunks, all is done again with another salt. Texts are then compared by
their recipes alone, so a long document moves once, in chunks, and never as a whole.

Edge cases: a null text is the empty text, whose recipe is empty. Rows that repeat both id
and text are rows of the same group; one of them is kept. Rows that share an id but not the
text are different documents. A null id is the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.tables import among, arrow_schema, free_name, slices, table, without
from trendspark.scratch import cut, scope

SHORTEST, LONGEST = 512, 16_384
CUT_BITS = 10  # one byte in 1,024 may end a chunk
WINDOW = 4  # bytes that decide about a cut
TRIES = 8


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the hash of the last WINDOW bytes has CUT_BITS zero bits."""
    found = []
    for low in range(0, len(data), 1 << 20):
        part = data[max(0, low - WINDOW + 1):low + (1 << 20)].astype(np.uint32)
        if len(part) < WINDOW:
            continue
        value = part[WINDOW - 1:] * np.uint32(1)
        for back in range(1, WINDOW):
            value += part[WINDOW - 1 - back:len(part) - back] << np.uint32(8 * back)
        value *= np.uint32(0x9E3779B1)
        found.append(np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + max(0, low - WINDOW + 1) + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_bounds(places: np.ndarray, low: int, high: int) -> list[int]:
    """Bounds of the chunks of one text, which is bytes low to high of the data."""
    bounds, last = [low], low
    usable = places[np.searchsorted(places, low + WINDOW):np.searchsorted(places, high)]
    for place in usable.tolist():
        while place - last > LONGEST:
            last += LONGEST
            bounds.append(last)
        if place - last >= SHORTEST:
            last = place
            bounds.append(place)
    while high - last > LONGEST:
        last += LONGEST
        bounds.append(last)
    if high > last:
        bounds.append(high)
    return bounds


def _chunked(batches, salt: bytes):
    """For each slice of rows, the list of (identifier, chunk) of every text."""
    for rows, data, at in slices(batches):
        places, whole, out = cut_places(data), data.tobytes(), []
        for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            bounds = chunk_bounds(places, low, high)
            chunks = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            out.append(([hashlib.blake2b(c, digest_size=16, salt=salt).digest() for c in chunks], chunks,
                        whole[low:high]))
        yield rows, out


def recipes(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(doc_id, text_sha256, recipe): one row per document, identifiers end to end."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_sha256", T.StringType()),
                           T.StructField("recipe", T.BinaryType())])
    key, out_schema = salt.to_bytes(8, "little"), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunked(batches, key):
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array([hashlib.sha256(t).hexdigest() for _, _, t in texts], pa.string()),
                pa.array([b"".join(ids) for ids, _, _ in texts], pa.binary())], schema=out_schema)

    return docs.mapInArrow(run, schema)


def chunks(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(chunk_id, chunk): one row per chunk of every document."""
    key = salt.to_bytes(8, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunked(batches, key):
            yield pa.RecordBatch.from_arrays([
                pa.array([i for ids, _, _ in texts for i in ids], pa.binary()),
                pa.array([c for _, parts, _ in texts for c in parts], pa.binary())], ["chunk_id", "chunk"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk_id binary, chunk binary")


def verified(parts: DataFrame) -> bool:
    """No identifier stands for two different chunks."""
    stored = parts.groupBy("chunk_id", "chunk").agg(F.lit(1).alias("one"))
    return stored.groupBy("chunk_id").count().where("count > 1").isEmpty()


def verified_recipes(docs: DataFrame) -> DataFrame:
    for salt in range(TRIES):
        if verified(chunks(docs, salt)):
            return cut(recipes(docs, salt), "recipes")
    raise ValueError(f"identifiers collided under {TRIES} salts")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    The largest id of each group of equal texts is kept. All rows of one id and text are
    equal, so they are counted first and written out again at the end.
    """
    rows = verified_recipes(docs).groupBy("recipe", "text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    rows = cut(rows, "recipe-rows")
    groups = (rows.groupBy(F.col("recipe").alias("group_recipe"))
              .agg(F.sum("copies").alias("rows_in_group"), F.max("doc_id").alias("largest"))
              .where("rows_in_group > 1"))
    joined = rows.join(cut(groups, "recipe-groups"), F.col("recipe") == F.col("group_recipe"), "left")
    known = F.col("rows_in_group").isNotNull()
    return (joined
            .withColumn("keep_id", F.when(known, F.col("largest")).otherwise(F.col("doc_id")))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "keep_id", F.coalesce("rows_in_group", F.lit(1).cast("long")).alias("group_size"),
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    "text_sha256"))


def keep_first(docs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, with all their columns."""
    with scope() as held:
        decisions = exact_duplicates(docs) if decisions is None else decisions
        dropped = held.keep(cut(decisions.where(~F.col("kept")), "dropped"))
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    left = without(docs, dropped.where(~own))
    repeated = dropped.where(own).select("doc_id", "text_sha256").distinct()
    if repeated.isEmpty():
        return left
    sha = free_name(docs.columns, "row_sha")
    some = among(left, repeated).withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    once = some.dropDuplicates(["doc_id", sha]).drop(sha)
    return without(left, repeated).unionByName(once)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
