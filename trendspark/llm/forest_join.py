"""Similarity self-join of word shingles by a MinHash LSH forest.

1. Each document gets the key of its word sequence and a signature of TREES x DEPTH minimum
   hashes of its shingles. Documents of one word sequence are one text from here on.
2. The forest is TREES prefix tries over the signatures. Matched prefixes are shortened from
   DEPTH until pairs at the threshold meet in some trie with the target recall; the trie
   nodes at that depth are the buckets.
3. Within a bucket, texts whose whole signatures agree nearly as often as those of a pair at
   the threshold are joined to groups. Pairs are compared there but never emitted: a bucket
   gives one edge per text. Connected groups over all buckets say which texts must be
   compared.
4. The texts of a group are compared exactly, by their whole shingle sets. Large buckets and
   groups are dealt out as pairs of blocks, so a task holds two blocks at most and every pair
   meets once.

The shortened depth and the agreement bound follow from the threshold and the two allowed
rates of misses below; they do not depend on the data.

Edge cases: a text of fewer words than a shingle is one shingle; a null text or one without
words resembles nothing and is a class of its own row; rows that repeat are copies; a null id
is no class's smallest id unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm import words
from trendspark.llm.components import components
from trendspark.llm.tables import arrow_schema, keyed, sieve, slices, table, without
from trendspark.scratch import cut, scope

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 26, 6
MISSED_BY_FOREST = 2e-6
MISSED_BY_AGREEMENT = 1e-6
BUCKET_BLOCK = 1024
GROUP_BLOCK = 192
COLUMNS = 4096

_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = np.uint64(0xD6E8FEB86659FD93)


def forest_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, missed: float = MISSED_BY_FOREST) -> int:
    """Shorten the prefix until a pair at the threshold is missed by all tries at most that often."""
    for length in range(depth, 0, -1):
        if (1 - threshold ** length) ** trees <= missed:
            return length
    raise ValueError("more tries are needed for this threshold")


def least_agreement(threshold: float, n: int, missed: float = MISSED_BY_AGREEMENT) -> int:
    """Places of n in which a pair at the threshold agrees, but for a share of ``missed`` of such pairs."""
    below, at = 0.0, 0
    while True:
        below += math.comb(n, at) * threshold ** at * (1 - threshold) ** (n - at)
        if below > missed:
            return at
        at += 1


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds of each text's hashes, word hashes, bounds of each text's words)."""
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, at, words.ALNUM)
    word = words.hashes(data, starts, ends)
    n = np.diff(first)
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(per)))
    begin = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], per)
    end = np.repeat(first[1:], per)
    out, factors = np.zeros(len(begin), np.uint64), np.cumprod(np.full(size, _SHIFT))
    for j in range(size):
        place = begin + j
        inside = place < end
        out += np.where(inside, word[np.minimum(place, max(len(word) - 1, 0))], np.uint64(j)) * factors[j]
    return words.mix(out), bounds, word, first


def _sequence_key(word: np.ndarray, low: int, high: int) -> bytes | None:
    return hashlib.blake2b(word[low:high].tobytes(), digest_size=16).digest() if high > low else None


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, signature): the key is null for a text without words."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.BinaryType()),
                           T.StructField("signature", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=1 << 20):
            found, bounds, word, first = shingle_hashes(data, at)
            some = np.flatnonzero(np.diff(bounds))
            low = (found >> np.uint64(32)).astype(np.uint32)
            signature = np.empty((len(some), len(FACTORS)), np.uint32)
            if len(some):
                for k, factor in enumerate(FACTORS):
                    signature[:, k] = np.minimum.reduceat(low * factor, bounds[some])
            keys, rest = [None] * rows.num_rows, [None] * rows.num_rows
            for i, d in enumerate(some.tolist()):
                keys[d], rest[d] = _sequence_key(word, first[d], first[d + 1]), signature[i].tobytes()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(keys, pa.binary()),
                                              pa.array(rest, pa.binary())], schema=out_schema)

    return docs.mapInArrow(run, schema)


def signatures(column: pa.Array) -> np.ndarray:
    data = pa.concat_arrays([column]) if column.offset else column
    return np.frombuffer(b"".join(data.to_pylist()), np.uint32).reshape(len(data), -1)


def buckets(texts: DataFrame, depth: int) -> DataFrame:
    """(bucket, text_key): the node of each text in each trie, cut at ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = signatures(batch.column("signature")).reshape(batch.num_rows, TREES, DEPTH)
            node = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), signature.shape[:2]).copy()
            for level in range(depth):
                node = words.mix(node * _SHIFT + signature[:, :, level])
            key = batch.column("text_key").take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))
            yield pa.RecordBatch.from_arrays([pa.array(node.reshape(-1).view(np.int64), pa.int64()), key],
                                             ["bucket", "text_key"])

    return texts.select("text_key", "signature").mapInArrow(run, "bucket long, text_key binary")


def in_blocks(rows: DataFrame, group: str, member: str, block: int, sizes: DataFrame) -> DataFrame:
    """Rows dealt out by (group, low, high): pairs of blocks of at most about ``block`` members.

    ``sizes`` has (group, n). Each member goes to every pair that its block is in; a group of
    one block gives one pair (0, 0). ``mine`` is the member's own block.
    """
    rows = rows.join(sizes.where(F.col("n") > block), group, "left")
    count = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / F.lit(block)).cast("int")
    rows = (rows.withColumn("blocks", count)
            .withColumn("mine", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return (rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
            .drop("blocks", "other", "n"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key after the other; the rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch.column(key)
            changed |= ~np.asarray(pa.compute.equal(column[1:], column[:-1]).to_pylist(), bool)
        ends = [*(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        if held and all(held[-1].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys):
            held.append(batch.slice(0, ends[0]))
            start, ends = ends[0], ends[1:]
        else:
            start = 0
        for end in ends:
            if held:
                yield joined()
            held = [batch.slice(start, end - start)]
            start = end
    if held:
        yield joined()


def spread(neighbours, n: int) -> np.ndarray:
    """Root of each of n members; ``neighbours(i, left)`` tells which of ``left`` are joined to i."""
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        start, left = left[0], left[1:]
        root[start], queue = start, [start]
        while queue and len(left):
            near = neighbours(queue.pop(), left)
            found, left = left[near], left[~near]
            root[found] = start
            queue += found.tolist()
    return root


def agreeing(shared: DataFrame, least: int) -> DataFrame:
    """(a, b): within each bucket, texts joined to the first text of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for bucket in runs(batches, ["bucket", "low", "high"]):
            if bucket.num_rows < 2:
                continue
            bits = np.frombuffer(b"".join(bucket.column("short").to_pylist()), np.uint8).reshape(bucket.num_rows, -1)
            root = spread(lambda i, left, bits=bits: (bits[left] == bits[i]).sum(1) >= least, bucket.num_rows)
            key = bucket.column("text_key")
            for i in np.flatnonzero(root != np.arange(len(root))).tolist():
                a.append(key[i].as_py())
                b.append(key[int(root[i])].as_py())
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    keys = ["bucket", "low", "high"]
    return (shared.repartition(*keys).sortWithinPartitions(*keys)
            .select(*keys, "text_key", "short").mapInArrow(run, "a binary, b binary"))


def candidate_edges(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges whose connected groups hold every pair at the threshold, up to the allowed misses."""
    depth = forest_depth(threshold)
    nodes = buckets(texts, depth)
    sizes = cut(nodes.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = nodes.join(sizes.select("bucket"), "bucket", "left_semi")
    # a byte of each minimum hash is enough to compare whole signatures
    short = texts.mapInArrow(_short, "text_key binary, short binary")
    shared = cut(in_blocks(shared, "bucket", "text_key", BUCKET_BLOCK, sizes), "shared")
    return agreeing(shared.join(cut(short.join(shared.select("text_key").distinct(), "text_key", "left_semi"), "short"),
                                "text_key"), least_agreement(threshold, TREES * DEPTH))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = (signatures(batch.column("signature")) >> np.uint32(3)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array([x.tobytes() for x in low], pa.binary())],
                                         ["text_key", "short"])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(text_key, shingles): the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=1 << 20):
            found, bounds, word, first = shingle_hashes(data, at)
            keys = [_sequence_key(word, *first[d:d + 2]) for d in range(rows.num_rows)]
            sets = [np.unique(found[bounds[d]:bounds[d + 1]]).tobytes() for d in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                             ["text_key", "shingles"])

    return docs.select("text").mapInArrow(run, "text_key binary, shingles binary")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    several = often[column] > 1  # others are in no intersection
    column, owner = number[column[several]], owner[several]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[part], column[part] - low] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """(text_key, root, linked_texts, linked_docs) per text and pair of blocks, by whole shingle sets."""
    keys = ["group", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            both = common_counts(sets)
            size = both.diagonal()
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            mine = np.array(group.column("mine").to_pylist())
            if group.column("low")[0].as_py() != group.column("high")[0].as_py():
                linked &= mine[:, None] != mine[None, :]
            root = spread(lambda i, left, linked=linked: linked[i, left], len(sets))
            copies = np.array(group.column("copies").to_pylist())
            key = group.column("text_key")
            yield pa.RecordBatch.from_arrays([
                key, key.take(pa.array(root)), pa.array(linked.sum(1), pa.int64()),
                pa.array(linked @ copies, pa.int64())], ["text_key", "root", "linked_texts", "linked_docs"])

    return (members.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "text_key binary, root binary, linked_texts long, linked_docs long"))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, copies, linked_texts): one row per row of ``docs``.

    ``class_id`` is the smallest id of all documents that chains of similar pairs connect;
    ``n_links`` counts the other documents at the threshold or above it: ``copies`` of the
    same word sequence less the document itself, and all documents of ``linked_texts`` other
    texts.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = cut(sketches(docs), "sketches")
    texts = cut(rows.where("text_key is not null").groupBy("text_key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("signature").alias("signature")), "texts")
    groups = components(candidate_edges(texts, threshold)).select(
        F.col("node").alias("text_key"), F.col("root").alias("group"))
    sizes = cut(groups.groupBy("group").agg(F.count("*").alias("n")), "group-sizes")
    groups = cut(groups.join(texts.select("text_key", "first_id", "copies"), "text_key"), "groups")
    # the whole texts of one document of each text that has candidates
    wanted = groups.select("first_id").distinct()
    some = sieve(docs, [F.col("doc_id")], wanted)[1].join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = shingle_sets(some).join(groups.select("text_key"), "text_key", "left_semi")
    sets = cut(sets.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "sets")
    members = in_blocks(groups.select("text_key", "group", "copies"), "group", "text_key", GROUP_BLOCK, sizes)
    found = cut(compared(members.join(sets, "text_key"), threshold), "compared")
    roots = components(found.select(F.col("text_key").alias("a"), F.col("root").alias("b"))).select(
        F.col("node").alias("text_key"), "root")
    links = found.groupBy("text_key").agg(F.sum("linked_texts").alias("linked_texts"),
                                          F.sum("linked_docs").alias("linked_docs"))
    linked = roots.join(groups.select("text_key", "first_id"), "text_key").join(links, "text_key")
    first = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    linked = linked.join(first, "root").select("text_key", "class_id", "linked_texts", "linked_docs")
    alone = F.col("linked_texts").isNull()
    info = (texts.select("text_key", "first_id", "copies").join(linked, "text_key", "left")
            .where((F.col("copies") > 1) | ~alone)
            .select("text_key", F.coalesce("class_id", "first_id").alias("class_id"), "copies",
                    F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"),
                    F.coalesce("linked_docs", F.lit(0)).alias("linked_docs")))
    info = cut(info, "classes")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return (rows.select("doc_id", "text_key").join(info, "text_key", "left")
            .select("doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce(F.col("copies") - 1 + F.col("linked_docs"), zero).alias("n_links"),
                    F.coalesce("copies", one).alias("copies"), F.coalesce("linked_texts", zero).alias("linked_texts")))


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, with all their columns."""
    with scope() as own:
        found = similar_documents(keyed(docs), threshold)
        gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id.*")
        gone = own.keep(cut(gone, "near-copies"))
    return without(docs, gone)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive pattern as (
    select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' as p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as big, 'abcdefghijklmnopqrstuvwxyz' as small),
doc as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), p) as w from documents, pattern),
text as materialized (
    select row_number() over (order by min(doc_id)) as t, w, min(doc_id) as first_id, count(*) as copies
    from doc where len(w) > 0 group by w),
shingle as materialized (
    select distinct t, array_to_string(list_slice(w, i, i + 4), ' ') as s
    from (select t, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from text)),
size as (select t, count(*) as n from shingle group by t),
pair as (select a.t as a, b.t as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.t <> b.t group by 1, 2),
link as materialized (
    select a, b from pair join size x on x.t = a join size y on y.t = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) as (select t, t from text where t in (select a from link) union select r.a, l.b from reach r join link l on l.a = r.b),
class as (select a as t, min(b) as root from reach group by a),
linked as (select a as t, count(*) as linked_texts, cast(sum(copies) as bigint) as linked_docs from link join text on t = b group by a)
select d.doc_id, coalesce(r.first_id, t.first_id, d.doc_id) as class_id,
       coalesce(t.copies - 1 + coalesce(l.linked_docs, 0), 0) as n_links, coalesce(t.copies, 1) as copies,
       coalesce(l.linked_texts, 0) as linked_texts
from doc d left join text t on t.w = d.w left join class c on c.t = t.t left join text r on r.t = c.root
left join linked l on l.t = t.t
"""
