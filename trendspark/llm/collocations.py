"""Collocations: frequent phrases by Rabin-Karp fingerprints, scored by their weakest cut.

Texts are gathered into chunks of one language, a written table. Within a chunk words are
hashed, and prefix sums of the polynomial over the words' hashes give the fingerprint of
every n-gram by one subtraction and one multiplication. Equal n-grams of a chunk become one
entry: fingerprint, count, and the place of one occurrence. Entries of equal fingerprint
are compared by their words, words by their bytes, so an entry stands for one phrase only.

The entries are shuffled in packed blocks, dealt by the top bits of the fingerprint. A task
sorts the fingerprints of its range, adds the counts, and keeps the occurrence pointers of
those that are frequent enough; no text has moved yet. The pointers go back to their chunks,
where the phrases are read off the text; only these are written out as strings. Counts are
then added by the phrases themselves, so fingerprints of two phrases that collide come
apart there: a fingerprint's count is never below that of any of its phrases, and each
phrase's count comes out exact.

The score of a phrase cut in two is floor(10**6 * a * a / (l * r)) with the counts of the
phrase and its parts, in exact decimals; the lowest cut counts. A phrase is dropped if a
longer candidate that contains it has at least COVER percent of its count.

Edge cases: a null text is empty and has no words; a null language is ``und``; a text longer
than a chunk is a chunk of its own; repeated rows count each; ties end with the phrase in
the order of its bytes; an empty table gives no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.llm import words
from trendspark.llm.tables import slices, table
from trendspark.scratch import cut, scratch_path

LONGEST = 3  # words of a candidate
FEWEST = 10  # occurrences of a candidate
TOP = 2000  # of a language
COVER = 50  # percent
SCALE = 1_000_000
CHUNK_BYTES = 12 << 20
HELD_BYTES = 36 << 20  # of all languages in a task
RANGE_ENTRIES = 1 << 22  # occurrences for each range of fingerprints
FEWEST_RANGES = 8
PIECE = 1 << 20
CODEC = "zstd"
SALT_ROWS = 1 << 20

# fixed values: what separates pieces, and what separates words
BREAK = words.byte_class(rb"[.,;:!?\x0A-\x0D]")
WORD = ~(BREAK | words.byte_class(rb"[\x20\x09]"))

_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ENTRIES = "part int, chunk_id long, sizes array<int>, prints binary, places binary, counts binary, large binary"


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk_id, lang, n_words, n_bytes, body): lower-cased texts of one language, compressed, each ended by a line feed."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def chunk(lang: str, parts: list) -> pa.RecordBatch:
        body = np.concatenate(parts)
        n = len(words.spans(body, np.array([0, len(body)]), WORD)[0])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([n], pa.int64()), pa.array([len(body)], pa.int64()),
             pa.array([pa.compress(body.tobytes(), CODEC, asbytes=True)], pa.binary())],
            ["lang", "n_words", "n_bytes", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        end = np.array([10], np.uint8)
        for rows, data, at in slices(batches, limit=1 << 20):
            data = words.LOWER[data]
            for lang, low, high in zip(rows.column("lang").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if low == high:
                    continue
                if lang in size and size[lang] + high - low + 1 > CHUNK_BYTES:
                    yield chunk(lang, held.pop(lang))
                    size.pop(lang)
                held.setdefault(lang, []).extend((data[low:high], end))
                size[lang] = size.get(lang, 0) + high - low + 1
            while sum(size.values()) > HELD_BYTES:
                most = max(size, key=size.get)
                yield chunk(most, held.pop(most))
                size.pop(most)
        for lang, parts in held.items():
            yield chunk(lang, parts)

    found = (docs.mapInArrow(run, "lang string, n_words long, n_bytes long, body binary")
             .select(F.monotonically_increasing_id().alias("chunk_id"), "lang", "n_words", "n_bytes", "body"))
    path = scratch_path(docs.sparkSession, "chunks")  # a few large values a file: small row groups
    found.write.option("compression", "none").option("parquet.block.size", CHUNK_BYTES).parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray]]:
    """(row, language, bytes) of each chunk of a batch."""
    for i in range(batch.num_rows):
        body = pa.decompress(batch.column("body")[i].as_buffer(), batch.column("n_bytes")[i].as_py(), CODEC)
        yield i, batch.column("lang")[i].as_py(), np.frombuffer(body, np.uint8)


def planes(values: np.ndarray, kind: str) -> bytes:
    """The lowest bytes of all values, then the next ones: those that are mostly zero compress well."""
    wide = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return wide.T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    wide = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(wide.T).view(kind).ravel()


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of the word numbered by ``other``."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    differ = np.flatnonzero(other != np.arange(len(other)))
    total = np.concatenate(([0], np.cumsum(size[differ])))
    low = 0
    while low < len(differ):
        high = max(low + 1, int(np.searchsorted(total, total[low] + PIECE, "right")) - 1)
        own = differ[low:high]
        at = np.arange(total[high] - total[low]) - np.repeat(total[low:high] - total[low], size[own])
        if (data[at + np.repeat(starts[own], size[own])] != data[at + np.repeat(starts[other[own]], size[own])]).any():
            return False
        low = high
    return True


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only: an occurrence that stands for all."""
    order = np.argsort(hashed, kind="stable")
    new = np.concatenate(([True], hashed[order][1:] != hashed[order][:-1])) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    if same_bytes(data, starts, ends, number):
        return number
    known: dict[bytes, int] = {}  # two words of this chunk share a hash
    return np.array([known.setdefault(data[a:b].tobytes(), i)
                     for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))], np.int64)


def fingerprints(hashed: np.ndarray, n: int, lang: np.uint64) -> np.ndarray:
    """Fingerprint of the ``n`` words from each word on, from prefix sums of the polynomial."""
    count = max(0, len(hashed) - n + 1)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(hashed), _BASE))))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * power[:-1])))
    del power
    found = prefix[n:n + count] - prefix[:count]
    del prefix
    found *= np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, count - 1), _INVERSE))))[:count]
    found += lang + np.uint64(n)
    return words.mix(found)


def entries(data: np.ndarray, lang: str, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprint, place, count) of the distinct n-grams of a chunk for n = 1, 2, ..., by fingerprint."""
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), WORD)
    hashed = words.hashes(data, starts, ends)
    number = word_numbers(data, starts, ends, hashed)
    piece = np.cumsum(BREAK[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    name = np.frombuffer(lang.encode(), np.uint8)
    salt = words.hashes(name, np.array([0]), np.array([len(name)]))[0] if len(name) else np.uint64(0)
    for n in range(1, longest + 1):
        count = max(0, len(starts) - n + 1)
        inside = np.flatnonzero(piece[:count] == piece[n - 1:n - 1 + count])
        found = fingerprints(hashed, n, salt)[inside]
        order = np.argsort(found)
        found, first = found[order], inside[order]
        del order, inside
        new = np.concatenate(([True], found[1:] != found[:-1])) if len(found) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        like = first[begin][np.cumsum(new) - 1] if len(found) else first
        if any((number[first + k] != number[like + k]).any() for k in range(n)):
            # two phrases of this chunk share a fingerprint: part them by their words
            order = np.lexsort((*(number[first + k] for k in range(n)), found))
            found, first = found[order], first[order]
            new = np.concatenate(([True], found[1:] != found[:-1]))
            for k in range(n):
                new[1:] |= number[first[1:] + k] != number[first[:-1] + k]
            begin = np.flatnonzero(new)
        yield found[begin], starts[first[begin]].astype(np.uint32), np.diff(np.append(begin, len(found))).astype(np.int32)


def packed_entries(chunks: DataFrame, longest: int, bits: int) -> DataFrame:
    """One row per chunk and range of fingerprints, the entries of n = 1, 2, ... one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for i, lang, data in _bodies(batch):
                found = list(entries(data, lang, longest))
                cuts = [np.concatenate(([0], np.searchsorted(p, bounds), [len(p)])) for p, _, _ in found]
                out, held = [], 0
                for part in range(1 << bits):
                    own = [slice(c[part], c[part + 1]) for c in cuts]
                    sizes = [s.stop - s.start for s in own]
                    if not sum(sizes):
                        continue
                    prints, places, counts = (np.concatenate([f[k][s] for f, s in zip(found, own, strict=True)])
                                              for k in range(3))
                    out.append({"part": part, "chunk_id": batch.column("chunk_id")[i].as_py(),
                                "sizes": [int(s) for s in sizes],
                                "prints": planes(np.diff(prints, prepend=np.uint64(0)), "<u8"),  # rising, so small steps
                                "places": planes(places, "<u4"),
                                "counts": np.minimum(counts, 255).astype(np.uint8).tobytes(),
                                "large": counts[counts >= 255].astype(np.int64).tobytes()})
                    held += len(prints)
                    if held > PIECE:
                        yield pa.RecordBatch.from_pylist(out, schema=_schema())
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return chunks.drop("n_words").mapInArrow(run, _ENTRIES)


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("chunk_id", pa.int64()), ("sizes", pa.list_(pa.int32())),
                      ("prints", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("large", pa.binary())])


def packed_pointers(places: np.ndarray, counts: np.ndarray, n: np.ndarray) -> bytes:
    """Pointers of ten bytes; a chunk has fewer than 2**32 bytes, so counts fit as well as places."""
    return places.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + n.astype("<u2").tobytes()


def from_pointers(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, counts, n) of packed pointers."""
    k = len(data) // 10
    return tuple(np.frombuffer(data, kind, k, at * k) for kind, at in (("<u4", 0), ("<u4", 4), ("<u2", 8)))


def frequent_pointers(packed: DataFrame, bits: int, fewest: int) -> DataFrame:
    """(chunk_id, pointers): places, sizes and counts of the chunk's entries whose fingerprints are frequent."""

    def merged(blocks: list) -> Iterator[pa.RecordBatch]:
        prints = np.concatenate([b[1] for b in blocks])
        counts = np.concatenate([b[4] for b in blocks])
        order = np.argsort(prints)
        new = np.concatenate(([True], prints[order][1:] != prints[order][:-1]))
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        kept = np.zeros(len(prints), bool)
        kept[order] = (total >= fewest)[np.cumsum(new) - 1]
        low = 0
        ids, pointers = [], []
        for chunk, own, sizes, places, count in blocks:
            some = np.flatnonzero(kept[low:low + len(own)])
            low += len(own)
            if len(some):
                n = np.repeat(np.arange(1, len(sizes) + 1), sizes)
                ids.append(chunk)
                pointers.append(packed_pointers(places[some], count[some], n[some]))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pointers, pa.binary())],
                                             ["chunk_id", "pointers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            for row in batch.to_pylist():
                prints = np.cumsum(from_planes(row["prints"], "<u8"), dtype=np.uint64)
                counts = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
                counts[counts == 255] = np.frombuffer(row["large"], np.int64)
                blocks.append((row["chunk_id"], prints, row["sizes"], from_planes(row["places"], "<u4"), counts))
        if blocks:
            yield from merged(blocks)

    return (packed.repartitionById(1 << bits, F.col("part"))
            .mapInArrow(run, "chunk_id long, pointers binary"))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The phrases of ``n`` words from word ``first`` on, with single spaces."""
    word = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = ends[word] - starts[word]
    last = np.cumsum(n) - 1
    room = size + 1
    room[last] -= 1
    begin = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + within] = data[np.repeat(starts[word], size) + within]
    bounds = np.append(begin[last - n + 1], len(out)).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(bounds), pa.py_buffer(out))


def phrases(chunks: DataFrame, pointers: DataFrame, fewest: int) -> DataFrame:
    """(lang, words, phrase, times): the phrases behind the pointers, counted by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang, data in _bodies(batch):
                starts, ends, _ = words.spans(data, np.array([0, len(data)]), WORD)
                for part in batch.column("wanted")[i].values:
                    place, times, n = from_pointers(part.as_buffer())
                    for low in range(0, len(place), PIECE // 4):
                        own = slice(low, low + PIECE // 4)
                        first, size = np.searchsorted(starts, place[own].astype(np.int64)), n[own].astype(np.int64)
                        text = _joined(data, starts, ends, first, size)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(text)), pa.array(size, pa.int32()), text,
                             pa.array(times[own].astype(np.int64))], ["lang", "words", "phrase", "times"])

    wanted = pointers.groupBy("chunk_id").agg(F.collect_list("pointers").alias("wanted"))
    return (chunks.drop("n_words").join(wanted, "chunk_id")
            .mapInArrow(run, "lang string, words int, phrase string, times long")
            .groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times"))
            .where(F.col("times") >= fewest))


def phrase_counts(chunks: DataFrame, longest: int, fewest: int) -> DataFrame:
    """(lang, words, phrase, times): all phrases of up to ``longest`` words with ``fewest`` occurrences or more."""
    n = chunks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(FEWEST_RANGES, -(-longest * n // RANGE_ENTRIES))
    bits = (ranges - 1).bit_length()
    pointers = cut(frequent_pointers(packed_entries(chunks, longest, bits), bits, fewest), "pointers")
    return cut(phrases(chunks, pointers, fewest), "phrases")


def _part(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def scored(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, words, phrase, a, l, r, score): candidates with their lowest cut."""
    cuts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), _part(1, k).alias("head"),
                                       _part(k + 1, F.greatest(F.col("words") - k, F.lit(0))).alias("tail"))
                              for k in range(1, longest)]), lambda x: x["k"] < F.col("words"))
    candidates = (counts.where("words > 1").withColumn("cut", F.explode(cuts))
                  .select("lang", "words", "phrase", F.col("times").alias("a"), "cut.*"))
    for side, name in (("head", "l"), ("tail", "r")):
        part = counts.select(F.col("lang"), F.col("phrase").alias(side), F.col("times").alias(name))
        candidates = candidates.join(part, ["lang", side])
    exact = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    return (candidates.groupBy("lang", "words", "phrase", "a")
            .agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("low"))
            .select("lang", "words", "phrase", "a", "low.l", "low.r", "low.score"))


def covered(candidates: DataFrame, longest: int, cover: int) -> DataFrame:
    """(lang, phrase): candidates inside a longer one with at least ``cover`` percent of their count."""
    inner = F.array(*[F.struct(F.lit(size).alias("size"), _part(at, size).alias("phrase"))
                      for size in range(2, longest) for at in range(1, longest - size + 2)])
    # parts that begin too late for a shorter phrase have too few words
    fits = F.filter(inner, lambda x: (x["size"] < F.col("words")) & (F.size(F.split(x["phrase"], " ")) == x["size"]))
    longer = (candidates.select("lang", F.col("times").alias("longer"), F.explode(fits).alias("part"))
              .groupBy("lang", F.col("part.phrase").alias("phrase")).agg(F.max("longer").alias("longer")))
    return (candidates.join(longer, ["lang", "phrase"])
            .where(F.col("longer") * 100 >= F.col("times") * cover).select("lang", "phrase"))


def best_of_each(rows: DataFrame, top: int, n_rows: int) -> DataFrame:
    """The first ``top`` rows of each language: first within salted parts of it, then among those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(1, -(-n_rows // SALT_ROWS)) * 8
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    inner = Window.partitionBy("lang", "salt").orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(inner)).where(F.col("place") <= top)
    outer = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(outer).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, fewest: int = FEWEST, top: int = TOP,
                 cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): the best phrases of each language of ``docs`` (text, lang)."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    chunks = chunked(docs)
    counts = phrase_counts(chunks, longest, fewest)
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    candidates = counts.where("words > 1")
    kept = scored(counts, longest)
    if longest > 2:
        kept = kept.join(covered(candidates, longest, cover), ["lang", "phrase"], "left_anti")
    return (best_of_each(kept, top, candidates.count()).join(totals, "lang")
            .select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("words")


OP13_SQL = r"""
with piece as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as part
    from documents),
word as (select lang, regexp_extract_all(part, '[^\x20\x09]+') as w from piece),
spot as (select lang, w, unnest(range(1, len(w) + 1)) as i from word where len(w) > 0),
gram as (select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase
         from spot, (values (1), (2), (3)) as sizes(size) where i + size - 1 <= len(w)),
seen as (select lang, size, phrase, count(*) as f from gram group by all having count(*) >= 10),
total as (select lang, sum(len(w))::bigint as n from word group by lang),
cuts as (
    select s.lang, s.size, s.phrase, s.f, k, string_split(s.phrase, ' ') as w
    from seen s, (values (1), (2)) as places(k) where s.size > k),
cut as (
    select c.lang, c.size, c.phrase, c.f as a, c.k, l.f as l, r.f as r,
           (1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f))::bigint as score
    from cuts c
    join seen l on l.lang = c.lang and l.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
    join seen r on r.lang = c.lang and r.phrase = array_to_string(list_slice(c.w, c.k + 1, c.size), ' ')),
lowest as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_of as (
    select lang, part as phrase, max(f) as longer
    from (select lang, f, array_to_string(list_slice(string_split(phrase, ' '), b, b + 1), ' ') as part
          from seen, (values (1), (2)) as places(b) where size = 3)
    group by lang, part)
select lang, row_number() over best as rank, phrase, a, l, r, n, score
from lowest left join inner_of using (lang, phrase) join total using (lang)
where size > 2 or longer is null or 100 * longer < 50 * a
window best as (partition by lang order by score desc, a desc, phrase)
qualify row_number() over best <= 2000
"""
