"""Class-based TF-IDF: every topic of a category is one class of texts.

The vocabulary is kept as postings, one row per (category, term) with the array of its
topics. The array is bounded by the number of topics, the table is spread by term, and
nothing of it is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions.arrays import by_topic, of_topic
from trendspark.functions.blocks import TERM_END, block, listed, small
from trendspark.functions.ngrams import Words, runs, token_slices
from trendspark.functions.text import NGRAM_MAX, tokens
from trendspark.scratch import cut

# fixed values
COUNTED_TOKENS = 1 << 18  # in a slice; larger ones hold fewer terms twice and take more memory
PART_BYTES = 1 << 22  # of text for one part of the terms
ROWS = 1 << 16  # in an Arrow batch handed to Spark


def classed_texts(texts: DataFrame, assignments: DataFrame) -> DataFrame:
    """(paper_id, text, classes): each text once, with its topic in every category it is in.

    Texts that are bucketed by paper stay in their buckets; only the classes are sent there.
    """
    classes = assignments.groupBy("paper_id").agg(
        F.collect_set(F.struct("category", "topic")).alias("classes"))
    return texts.join(classes.hint("shuffle_hash"), "paper_id").select("paper_id", "text", "classes")


def class_postings(classed: DataFrame, stop_words: Sequence[str] = (), longest: int = NGRAM_MAX,
                   papers: bool = False) -> DataFrame:
    """(category, term, df, f, papers, postings): a row per category and term, in one shuffle.

    ``df`` counts the classes that hold the term, ``f`` its occurrences over all of them, and
    ``postings`` lists (topic, tf). ``papers`` counts the papers of the category that hold the
    term where asked for, and is 0 else.

    Texts are split in the JVM; n-grams are numbered and counted in Arrow batches. A slice of
    papers sends one compressed block of terms and counts for each part of the terms, whatever
    the number of categories of a paper; a term's part is a hash of it, so all counts of a
    term meet in one part. The number of parts grows with the texts, so a part does not.
    """
    stop = pa.array(list(stop_words), pa.string())
    chars = classed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + chars // PART_BYTES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in token_slices(batches, limit=COUNTED_TOKENS):
            yield from _counted(rows, stop, longest, papers, parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["block"], strict=True):
                if held and part != last:
                    yield from _merged(held)
                    held = []
                held.append(data.as_buffer())
                last = part
        if held:
            yield from _merged(held)

    blocks = classed.select("classes", tokens(F.col("text")).alias("tokens")).mapInArrow(counted, "part int, block binary")
    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        merged, "category string, term string, df long, f long, papers long, postings array<struct<topic: int, tf: long>>")


def _counted(rows: pa.RecordBatch, stop: pa.Array, longest: int, papers: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """One block per part for the n-grams of a slice of papers: terms, and their counts per class."""
    words, classes = Words(rows["tokens"], stop), rows["classes"].flatten()
    name = classes.field("category").dictionary_encode(null_encoding="encode")
    topic = classes.field("topic").to_numpy(zero_copy_only=False)
    per = rows["classes"].value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(per) - per
    code = name.indices.to_numpy()
    both, class_of = np.unique(np.stack((code, topic)), axis=1, return_inverse=True)
    class_of, n_classes = class_of.ravel(), both.shape[1]
    # a paper with several topics in a category counts once there, in the first of them
    new = np.zeros(len(code), np.int64)
    new[np.unique(np.repeat(np.arange(len(per)), per) * max(1, len(name.dictionary)) + code, return_index=True)[1]] = 1

    hashes = words.hashes()
    terms, part, sizes, owners, counts, holders = [], [], [], [], [], []
    for _, starts, gram, distinct, spell in words.grams(longest):
        paper = words.paper[starts]
        times = per[paper]
        at = np.repeat(first[paper], times) + runs(times)
        key, tf = np.unique(np.repeat(gram, times) * n_classes + class_of[at], return_counts=True)
        found, size = np.unique(key // max(1, n_classes), return_counts=True)
        terms.append(spell(found))
        part.append((spell.hashes(hashes, found) % np.uint64(parts)).astype(np.int32))
        sizes.append(size)
        owners.append(key % max(1, n_classes))
        counts.append(tf)
        if papers:
            pair = np.unique(paper * distinct + gram)
            paper, gram = pair // distinct, pair % distinct
            times = per[paper]
            at = np.repeat(first[paper], times) + runs(times)
            place = np.searchsorted(key, np.repeat(gram, times) * n_classes + class_of[at])
            holders.append(np.bincount(place, new[at], len(key)).astype(np.int64))
    terms, part, sizes = pa.concat_arrays(terms), np.concatenate(part), np.concatenate(sizes)
    order = np.argsort(part, kind="stable")
    entry = np.repeat((np.cumsum(sizes) - sizes)[order], sizes[order]) + runs(sizes[order])
    terms, part, sizes = terms.take(pa.array(order)), part[order], sizes[order]
    owner, tf = np.concatenate(owners)[entry], np.concatenate(counts)[entry]
    holders = np.concatenate(holders)[entry] if papers else None
    ends = np.cumsum(sizes)
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[bounds, len(part)].astype(np.int32)), terms), TERM_END)
    out = []
    for k, (low, high) in enumerate(zip(bounds, np.r_[bounds[1:], len(part)], strict=True)):
        inside = slice(ends[low] - sizes[low], ends[high - 1])
        own = both[:, owner[inside]]
        out.append(block({
            "terms": texts.slice(k, 1), "names": listed(name.dictionary),
            "sizes": listed(small(sizes[low:high])), "name": listed(small(own[0].astype(np.int64))),
            "topic": listed(small(own[1].astype(np.int64))), "tf": listed(small(tf[inside])),
            "papers": listed(small(holders[inside] if papers else np.zeros(0, np.int64)))}))
    yield pa.RecordBatch.from_arrays([pa.array(part[bounds], pa.int32()), pa.array(out, pa.binary())], ["part", "block"])


def _merged(blocks: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
    """Postings of the terms of one part from its blocks."""
    names: dict[str | None, int] = {}
    terms, sizes, name, topic, tf, papers = [], [], [], [], [], []
    for data in blocks:
        with pa.ipc.open_stream(data) as reader:
            read = reader.read_next_batch()
        own = np.array([names.setdefault(x, len(names)) for x in read["names"].flatten().to_pylist()], np.int64)
        terms.append(pc.split_pattern(read["terms"], TERM_END).flatten())
        sizes.append(read["sizes"].flatten().to_numpy().astype(np.int64))
        name.append(own[read["name"].flatten().to_numpy()])
        topic.append(read["topic"].flatten().to_numpy().astype(np.int32))
        tf.append(read["tf"].flatten().to_numpy().astype(np.int64))
        papers.append(read["papers"].flatten().to_numpy().astype(np.int64))
    coded = pa.concat_arrays(terms).dictionary_encode()
    del terms
    term = np.repeat(coded.indices.to_numpy(), np.concatenate(sizes))
    name, topic, tf, papers = (np.concatenate(x) for x in (name, topic, tf, papers))
    if not len(term):
        return
    least = int(topic.min())
    span = int(topic.max()) - least + 1
    order = np.argsort((term * np.int64(len(names)) + name) * span + (topic - least), kind="stable")
    term, name, topic, tf = term[order], name[order], topic[order], tf[order]
    group = np.r_[True, (term[1:] != term[:-1]) | (name[1:] != name[:-1])]
    each = np.flatnonzero(group | np.r_[True, topic[1:] != topic[:-1]])
    group = np.flatnonzero(group)
    f = np.add.reduceat(tf, group)
    held = np.add.reduceat(papers[order], group) if len(papers) else np.zeros(len(group), np.int64)
    tf, topic = np.add.reduceat(tf, each), topic[each]
    bounds = np.r_[np.searchsorted(each, group), len(each)].astype(np.int32)
    spelled = pa.array(list(names), pa.string())
    for low in range(0, len(group), ROWS):
        high = min(low + ROWS, len(group))
        inside = slice(bounds[low], bounds[high])
        pairs = pa.StructArray.from_arrays([pa.array(topic[inside]), pa.array(tf[inside])], ["topic", "tf"])
        yield pa.RecordBatch.from_arrays(
            [spelled.take(pa.array(name[group[low:high]])), coded.dictionary.take(pa.array(term[group[low:high]])),
             pa.array(np.diff(bounds[low:high + 1]).astype(np.int64)), pa.array(f[low:high]), pa.array(held[low:high]),
             pa.ListArray.from_arrays(pa.array(bounds[low:high + 1] - bounds[low]), pairs)],
            ["category", "term", "df", "f", "papers", "postings"])


def class_term_counts(classed: DataFrame, stop_words: Sequence[str] = (), longest: int = NGRAM_MAX) -> DataFrame:
    """(category, topic, term, tf)."""
    return (class_postings(classed, stop_words, longest).select("category", "term", F.explode("postings").alias("_p"))
            .select("category", "_p.topic", "term", "_p.tf"))


def document_frequency(found: DataFrame) -> DataFrame:
    """(category, term, df, f): classes that hold the term, and its count over all of them."""
    return found.select("category", "term", "df", "f")


def postings(found: DataFrame, parameters: DataFrame, df_scope: str = "topic") -> DataFrame:
    """(category, term, df, f, postings) of the terms within min_df .. max_df.

    df counts classes, or papers with the scope ``paper``. A term has at most one row per topic.
    """
    df = F.col("papers" if df_scope == "paper" else "df")
    return (found.withColumn("df", df).join(parameters.select("category", "min_df", "max_df"), "category")
            .where((F.col("df") >= F.col("min_df")) & (F.col("df") <= F.col("max_df")))
            .select("category", "term", "df", "f", "postings"))


def class_totals(vocabulary: DataFrame) -> DataFrame:
    """(category, topic, total, average): terms per class and the whole-number mean over the classes."""
    totals = (vocabulary.select("category", F.explode("postings").alias("_p"))
              .groupBy("category", "_p.topic").agg(F.sum("_p.tf").alias("total")))
    mean = totals.groupBy("category").agg(F.floor(F.avg("total")).alias("average"))
    return totals.join(mean, "category")


def idf(f, average):
    """BM25 form; negative for terms more frequent than the mean class is long."""
    return F.log((average + F.lit(1.0)) / (f + F.lit(0.5)))


def scored(vocabulary: DataFrame) -> DataFrame:
    """(category, term, df, f, idf, weights): weights is array of (topic, tf, score), score = tf share x idf.

    The class totals are written first: a table of known small size, which Spark then
    broadcasts by itself instead of shuffling the vocabulary by category.
    """
    totals = class_totals(vocabulary)
    per_category = by_topic(totals, "total", "_totals").join(
        totals.groupBy("category").agg(F.max("average").alias("_average")), "category")
    joined = vocabulary.join(cut(per_category, "class-totals"), "category").withColumn(
        "idf", idf(F.col("f"), F.col("_average")))
    return joined.select(
        "category", "term", "df", "f", "idf",
        F.transform("postings", lambda p: F.struct(
            p["topic"].alias("topic"), p["tf"].alias("tf"),
            (p["tf"] / of_topic("_totals", p["topic"]) * F.col("idf")).alias("score"))).alias("weights"))


def fit(texts: DataFrame, assignments: DataFrame, parameters: DataFrame, stop_words: Sequence[str] = (),
        longest: int = NGRAM_MAX, df_scope: str = "topic") -> DataFrame:
    """The scored vocabulary of all categories. Counting is done once, into a written table."""
    classed = classed_texts(texts, assignments)
    found = class_postings(classed, stop_words, longest, df_scope == "paper")
    return scored(cut(postings(found, cut(parameters, "parameters"), df_scope), "vocabulary"))


def topic_terms(scores: DataFrame) -> DataFrame:
    """(category, topic, term, tf, idf, score), one row per posting."""
    return (scores.select("category", "term", "idf", F.explode("weights").alias("_w"))
            .select("category", "_w.topic", "term", "_w.tf", "idf", "_w.score"))


def top_terms(terms: DataFrame, n: int, score: str = "score", digits: int | None = None) -> DataFrame:
    """The n best terms per topic; ties by term. The rank limit is applied in each task before the shuffle."""
    value = F.col(score) if digits is None else F.round(score, digits)
    order = Window.partitionBy("category", "topic").orderBy(value.desc(), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
