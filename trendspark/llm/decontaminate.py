"""Benchmark decontamination over a distributed positional inverted index.

The index is a written table of blocks. A block covers some documents of one task, about
BLOCK_WORDS words; for each word that occurs there it stores the sorted list of its
positions. Positions run on through the block, with a gap after each document, so that no
phrase crosses from one document into the next. The index knows nothing of the benchmark
and can be searched again.

An item is searched by its windows of consecutive words. The words of a window are ordered
by how often they occur in all documents. The list of the rarest one, moved by its place in
the window, gives the candidate starts; the others, rarest first, keep those starts whose
moved lists hold them too. With ``within`` above 0 the search is for proximity: every other
word of the window must occur at most that many words from the rarest one, in any order.

Words are compared by 64-bit hashes, so a false match needs every word of a window to
collide. Items are sent to the executors in portions of about ITEM_BYTES of text; a larger
benchmark takes more rounds over the index. Nothing of the documents reaches the driver
but how often the words of a portion occur.

Edge cases: a null or empty text has no words and is clean; an item without words has no
windows; a shorter item is one window; items with the same id count once, a null id is the
empty id; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm import words
from trendspark.llm.tables import arrow_schema, keyed, slices, table, utf8, without
from trendspark.scratch import cut, scope

WINDOW = 10
BLOCK_WORDS = 1 << 19
ITEM_BYTES = 4 << 20
CANDIDATES = 1 << 20  # at once, in a task
_HIT = "array<struct<first:int,last:int>>"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per block: documents with their first position and number of words, and the postings.

    Word ``terms[k]`` is at ``positions[bounds[k]:bounds[k + 1]]``.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ints, longs = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False)
    schema = T.StructType([
        T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("begins", ints),
        T.StructField("n_words", ints), T.StructField("terms", longs), T.StructField("bounds", ints),
        T.StructField("positions", ints)])
    out_schema = arrow_schema(schema)

    def block(keys: list, counts: list, found: list) -> pa.RecordBatch:
        count, term, key = np.concatenate(counts), np.concatenate(found), pa.concat_arrays(keys)
        ordinal = np.repeat(np.arange(len(count)), count)
        begins = np.concatenate(([0], np.cumsum(count + 1)))[:-1]
        order = np.argsort(term, kind="stable")
        term = term[order]
        bounds = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, int)
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
                  _lists(begins, pa.int32()), _lists(count, pa.int32()),
                  _lists(term[bounds].view(np.int64), pa.int64()),
                  _lists(np.append(bounds, len(term)), pa.int32()),
                  _lists(order + ordinal[order], pa.int32())]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema, strict=True)],
                                          schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, found, held = [], [], [], 0
        for rows, data, at in slices(batches, limit=2 << 20):
            data = words.LOWER[data]
            starts, ends, first = words.spans(data, at, words.ALNUM)
            keys.append(rows.column("doc_id"))
            counts.append(np.diff(first))
            found.append(words.hashes(data, starts, ends))
            held += len(starts)
            if held >= block_words:
                yield block(keys, counts, found)
                keys, counts, found, held = [], [], [], 0
        if keys:
            yield block(keys, counts, found)

    return docs.mapInArrow(run, schema)


@dataclass
class Windows:
    """Windows of a portion of items: words by rarity, their places, and the item each belongs to."""

    items: list[str]
    item: np.ndarray
    size: np.ndarray
    term: np.ndarray  # windows x window, unused places 0
    place: np.ndarray

    def vocabulary(self) -> np.ndarray:
        used = np.arange(self.term.shape[1]) < self.size[:, None]
        return np.unique(self.term[used])

    def by_rarity(self, count: np.ndarray, vocabulary: np.ndarray) -> Windows:
        """Windows all of whose words occur, words rarest first."""
        used = np.arange(self.term.shape[1]) < self.size[:, None]
        often = np.full(self.term.shape, np.iinfo(np.int64).max)
        often[used] = count[np.searchsorted(vocabulary, self.term[used])]
        order = np.argsort(often, axis=1, kind="stable")
        kept = often.min(axis=1, initial=np.iinfo(np.int64).max) > 0
        return Windows(self.items, self.item[kept], self.size[kept],
                       np.take_along_axis(self.term, order, 1)[kept],
                       np.take_along_axis(self.place, order, 1)[kept])


def item_windows(items: list[tuple[str, str]], window: int = WINDOW) -> Windows:
    data, at = utf8(pa.array([text for _, text in items], pa.string()))
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, at, words.ALNUM)
    term = words.hashes(data, starts, ends)
    n = np.diff(first)
    per = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(items)), per)
    begin = np.repeat(first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(n, window)[item]
    place = np.broadcast_to(np.arange(window), (len(item), window)).copy()
    used = place < size[:, None]
    out = np.zeros(place.shape, np.uint64)
    out[used] = term[(begin[:, None] + place)[used]]
    return Windows([key for key, _ in items], item, size, out, place)


class Block:
    """The postings of one block as one sorted array of (rank of the word, position)."""

    def __init__(self, terms, bounds, positions, begins, n_words):
        self.terms, self.bounds = terms.view(np.uint64), bounds.astype(np.int64)
        self.begins, self.ends = begins.astype(np.int64), begins.astype(np.int64) + n_words
        self.keys = positions.astype(np.int64)
        self.keys += np.repeat(np.arange(len(terms)), np.diff(self.bounds)) << 32

    def rank(self, term: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 where the block has none."""
        if not len(self.terms):
            return np.full(term.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, at, -1)

    def holds(self, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the word occurs at a position from low to high."""
        low = np.maximum(low, 0)
        at = np.searchsorted(self.keys, (rank << 32) + low)
        at_or_last = np.minimum(at, len(self.keys) - 1)
        return (at < len(self.keys)) & (self.keys[at_or_last] <= (rank << 32) + high) & (high >= low)

    def matches(self, found: Windows, within: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, document, first, last) of all matches; positions of the block, last exclusive."""
        rank = self.rank(found.term)
        used = np.arange(rank.shape[1]) < found.size[:, None]
        alive = np.flatnonzero(((rank >= 0) | ~used).all(axis=1))
        rank, size, place = rank[alive], found.size[alive], found.place[alive]
        lead = rank[:, 0] if len(alive) else np.zeros(0, np.int64)
        per = self.bounds[lead + 1] - self.bounds[lead]
        total = np.concatenate(([0], np.cumsum(per)))
        out = []
        low = 0
        while low < len(alive):
            high = max(low + 1, int(np.searchsorted(total, total[low] + CANDIDATES, "right")) - 1)
            w = np.repeat(np.arange(low, high), per[low:high])
            nth = np.arange(total[high] - total[low]) - (total[w] - total[low])
            anchor = self.keys[self.bounds[lead[w]] + nth] & 0xFFFFFFFF
            doc = np.searchsorted(self.begins, anchor, "right") - 1
            for k in range(1, rank.shape[1]):
                need = size[w] > k
                if not need.any():
                    break
                if within:
                    near = np.maximum(anchor - within, self.begins[doc]), np.minimum(anchor + within, self.ends[doc] - 1)
                else:
                    near = (anchor - place[w, 0] + place[w, k],) * 2
                    need &= near[0] >= self.begins[doc]
                held = self.holds(rank[w, k], *near) & (need if not within else True) | (size[w] <= k)
                w, anchor, doc = w[held], anchor[held], doc[held]
            if within:
                out.append((alive[w], doc, anchor, anchor + 1))
            else:
                start = anchor - place[w, 0]
                good = start >= self.begins[doc]
                out.append((alive[w][good], doc[good], start[good], (start + size[w])[good]))
            low = high
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].values for name in batch.schema.names
                   if pa.types.is_list(batch.schema.field(name).type)}, batch.slice(i, 1)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def occurrences(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a portion of items occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for block, _ in _blocks(batches):
            term, bounds = _numbers(block["terms"]).view(np.uint64), _numbers(block["bounds"])
            if len(term):
                at = np.minimum(np.searchsorted(term, vocabulary), len(term) - 1)
                total += np.where(term[at] == vocabulary, bounds[at + 1] - bounds[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())],
                                         ["place", "times"])

    counted = index.select("terms", "bounds").mapInArrow(run, "place long, times long")
    out = np.zeros(len(vocabulary), np.int64)
    for row in counted.groupBy("place").agg(F.sum("times").alias("times")).collect():  # a row per word at most
        out[row.place] = row.times
    return out


def search(index: DataFrame, found: Windows, within: int = 0) -> DataFrame:
    """(block, nth, doc_id, n_words, hits, items): one row per document of the index.

    ``hits`` are the merged stretches of matched words, ``items`` the sorted ids of the items
    that they match.
    """
    kind = next(f.dataType.elementType for f in index.schema if f.name == "doc_ids")
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("doc_id", kind),
        T.StructField("n_words", T.LongType()), *T._parse_datatype_string(f"hits {_HIT}, items array<string>")])
    out_schema = arrow_schema(schema)
    hit_type, names = out_schema.field("hits").type, np.array(found.items, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in _blocks(batches):
            begins, count = _numbers(block["begins"]), _numbers(block["n_words"])
            own = Block(_numbers(block["terms"]), _numbers(block["bounds"]), _numbers(block["positions"]), begins, count)
            window, doc, first, last = own.matches(found, within)
            n = len(begins)
            # stretches: places where the number of covering matches rises from 0 or falls to it
            ends = np.unique(np.concatenate((first, last)))
            cover = np.zeros(len(ends), np.int64)
            np.add.at(cover, np.searchsorted(ends, first), 1)
            np.add.at(cover, np.searchsorted(ends, last), -1)
            cover = np.cumsum(cover)
            before = np.concatenate(([0], cover[:-1])) if len(cover) else cover
            opened, closed = ends[(before == 0) & (cover > 0)], ends[(before > 0) & (cover == 0)]
            at = np.searchsorted(begins, opened, "right") - 1
            hits = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(opened - begins[at], pa.int32()),
                                            pa.array(closed - begins[at], pa.int32())], fields=list(hit_type.value_type)))
            pairs = sorted({(d, names[i]) for d, i in
                            np.unique(np.stack((doc, found.item[window]), 1), axis=0).tolist()})
            owner = np.array([d for d, _ in pairs], np.int64)
            items = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()),
                                             pa.array([i for _, i in pairs], pa.string()))
            arrays = [pa.array(np.full(n, row.column("block")[0].as_py()), pa.int64()),
                      pa.array(np.arange(n), pa.int32()), block["doc_ids"], pa.array(count, pa.int64()), hits, items]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema, strict=True)],
                                             schema=out_schema)

    return index.withColumn("block", F.monotonically_increasing_id()).mapInArrow(run, schema)


def _merged(hits):
    """Stretches of several searches of one document, merged."""
    def add(done, hit):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["last"] < hit["first"])
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], hit["last"]).alias("last"))
        return F.when(apart, F.concat(done, F.array(hit))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)))

    return F.aggregate(F.array_sort(hits), F.array().cast(_HIT), add)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int = 0,
                  item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items): the stretches of every document that match the benchmark."""
    index = cut(build_index(docs), "index", large_rows=True)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = int(size // item_bytes) + 1
    found = None
    for i in range(portions):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == i).distinct()
        part = item_windows([tuple(row) for row in own.collect()], window)  # about item_bytes of text
        vocabulary = part.vocabulary()
        rows = search(index, part.by_rarity(occurrences(index, vocabulary), vocabulary), within)
        found = rows if found is None else found.unionByName(rows)
    if portions > 1:
        found = found.groupBy("block", "nth").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            _merged(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select("doc_id", "n_words", "hits", "items")


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, hit: total + hit["last"] - hit["first"])
    return (contamination(docs, benchmark)
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns."""
    with scope() as own:
        dirty = contamination(keyed(docs), benchmark).where(F.size("hits") > 0).select("doc_id.*")
        dirty = own.keep(cut(dirty, "contaminated"))
    return without(docs, dirty)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
with pattern as (select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' as p,
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as big, 'abcdefghijklmnopqrstuvwxyz' as small),
doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), p) as w from documents, pattern),
item as (select cast(item_id as varchar) as item_id,
                regexp_extract_all(translate(coalesce(text, ''), big, small), p) as w from benchmark, pattern),
windows as (
    select distinct item_id, list_slice(w, i, i + least(len(w), 10) - 1) as words
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)),
word as (select doc_id, w, unnest(w) as first, unnest(range(1, len(w) + 1)) as i from doc where len(w) > 0),
found as (
    select doc_id, item_id, i, len(words) as n
    from word join windows on first = words[1] and list_slice(w, i, i + len(words) - 1) = words),
hit as (select doc_id, count(distinct spot) as n_hit
        from (select doc_id, unnest(range(i, i + n)) as spot from (select distinct doc_id, i, n from found))
        group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id from found) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""
