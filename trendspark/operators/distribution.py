"""Approximate topic distribution of each paper from sliding token windows.

Windows of four tokens slide by one. A window's similarity with a topic is the cosine of
their class-TF-IDF weights; similarities below 0.1 count as 0; a paper's share of a topic
is the sum over its windows, scaled to 1. Every window of a paper has the same length, so
no step per token is needed.

A term of a paper has a list of its occurrences, each a range of windows. Its weights come
from the vocabulary once for a slice of papers (``lookup``). In a window a term weighs its
count times its idf: that adds to the product with each of its topics, and squared to the
squared norm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions.arrays import by_topic, of_topic
from trendspark.functions.ngrams import Words, runs, token_slices
from trendspark.functions.text import NGRAM_MAX, tokens
from trendspark.operators.lookup import Slice, looked_up
from trendspark.scratch import cut

# fixed values
WINDOW = 4
MIN_SIMILARITY = 0.1
DIGITS = 9
STEP = 4_000_000  # window-topic additions expanded at once
ROWS = 1 << 16  # terms of papers weighed at once


def window_occurrences(texts: DataFrame, categories: DataFrame, stop_words: Sequence[str] = (),
                       longest: int = NGRAM_MAX, window: int = WINDOW) -> DataFrame:
    """(category, paper_id, term, lo, hi): windows lo[k] .. hi[k] hold the k-th occurrence of the paper's term.

    One row per paper and distinct term, for every category of the paper.
    """
    names = categories.groupBy("paper_id").agg(F.collect_set("category").alias("names"))
    split = texts.join(names.hint("shuffle_hash"), "paper_id").select(
        "paper_id", "names", tokens(F.col("text")).alias("tokens"))
    stop = pa.array(list(stop_words), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in token_slices(batches):
            yield from _placed(rows, stop, longest, window)

    found = split.mapInArrow(run, "paper_id long, names array<string>, term string, lo array<int>, hi array<int>")
    return found.select(F.explode("names").alias("category"), "paper_id", "term", "lo", "hi")


def _places(words: Words, longest: int, window: int) -> Iterator[tuple]:
    """(n, text, gram, bounds, lo, hi, spell): position lists of the terms of some texts, n by n.

    Occurrences longer than a window are in none.
    """
    last_start = np.maximum(words.lengths - window, 0)
    for n, starts, gram, distinct, spell in words.grams(longest):
        paper = words.paper[starts]
        lo = np.maximum(words.place[starts + n - 1] - (window - 1), 0)
        hi = np.minimum(words.place[starts], last_start[paper])
        inside = np.flatnonzero(lo <= hi)
        key = paper[inside] * distinct + gram[inside]
        order = np.argsort(key, kind="stable")
        key, inside = key[order], inside[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        yield n, key[begin] // distinct, key[begin] % distinct, np.r_[begin, len(key)], lo[inside], hi[inside], spell


def _placed(rows: pa.RecordBatch, stop: pa.Array, longest: int, window: int) -> Iterator[pa.RecordBatch]:
    """Position lists of the terms of some papers with their terms."""
    for _, paper, gram, bounds, lo, hi, spell in _places(Words(rows["tokens"], stop), longest, window):
        owner, bounds = pa.array(paper), pa.array(bounds.astype(np.int32))
        if len(paper):
            yield pa.RecordBatch.from_arrays(
                [rows["paper_id"].take(owner), rows["names"].take(owner), spell(gram),
                 pa.ListArray.from_arrays(bounds, pa.array(lo.astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(hi.astype(np.int32)))],
                ["paper_id", "names", "term", "lo", "hi"])


def topic_weights(scores: DataFrame) -> DataFrame:
    """(category, term, idf, weights) with idf x score / topic norm for the topics from 0 on."""
    norms = (scores.select("category", F.explode("weights").alias("_w")).where("_w.topic >= 0")
             .groupBy("category", "_w.topic").agg(F.sqrt(F.sum(F.col("_w.score") * F.col("_w.score"))).alias("norm"))
             .where("norm > 0"))
    inside = scores.join(cut(by_topic(norms, "norm", "_norms"), "topic-norms"), "category")
    scaled = F.transform("weights", lambda w: F.struct(
        w["topic"].alias("topic"),
        (F.col("idf") * w["score"] / of_topic("_norms", w["topic"])).alias("v")))
    return inside.select("category", "term", "idf",
                         F.filter(scaled, lambda w: w["v"].isNotNull() & (w["topic"] >= 0)).alias("weights"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each list begins, its length, the values)."""
    at = column.offsets.to_numpy().astype(np.int64)
    return at[:-1], np.diff(at), column.values


def _shares(rows: pa.Table, min_similarity: float) -> pa.RecordBatch:
    """Topic shares of the papers whose joined terms are ``rows``, all of a paper together."""
    category = rows["category"].combine_chunks()
    paper = rows["paper_id"].to_numpy()
    code = category.dictionary_encode().indices.to_numpy()
    start = np.flatnonzero(np.r_[True, (paper[1:] != paper[:-1]) | (code[1:] != code[:-1])])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(paper)]))
    idf = rows["idf"].to_numpy()
    at, size, lo = _lists(rows["lo"].combine_chunks())
    hi = rows["hi"].combine_chunks().values.to_numpy().astype(np.int64)
    term = np.repeat(np.arange(len(paper)), size)
    place = np.repeat(at, size) + runs(size)
    lo, hi = lo.to_numpy().astype(np.int64)[place], hi[place]
    windows = np.zeros(len(start), np.int64)
    np.maximum.at(windows, group[term], hi + 1)
    first = np.cumsum(windows) - windows
    total = int(windows.sum())

    # how often each term is in each of its windows
    width = hi - lo + 1
    inside, times = np.unique(np.repeat(term, width) * total + np.repeat(first[group[term]] + lo, width) + runs(width),
                              return_counts=True)
    term, window = inside // total, inside % total
    square = np.bincount(window, (times * idf[term]) ** 2, total)

    begin, size, weights = _lists(rows["weights"].combine_chunks())
    topics, values = weights.field("topic").to_numpy(), weights.field("v").to_numpy()
    topic_count = int(topics.max(initial=0)) + 1
    keys, sums = [], []
    ends = np.cumsum(size[term])
    cut_at = np.searchsorted(ends, np.arange(0, ends[-1] + STEP, STEP), side="left")
    for low, high in zip(cut_at, np.r_[cut_at[1:], len(term)], strict=True):
        each = size[term[low:high]]
        entry = np.repeat(begin[term[low:high]], each) + runs(each)
        found, place = np.unique(np.repeat(window[low:high], each) * topic_count + topics[entry], return_inverse=True)
        keys.append(found)
        sums.append(np.bincount(place, np.repeat(times[low:high], each) * values[entry], len(found)))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    dot = np.bincount(place, np.concatenate(sums), len(key))
    window = key // topic_count
    with np.errstate(divide="ignore", invalid="ignore"):
        similarity = np.round(dot / np.sqrt(square[window]), DIGITS)
    kept = (square[window] > 0) & (similarity >= min_similarity)
    owner = np.repeat(np.arange(len(start)), windows)[window[kept]]
    key, place = np.unique(owner * topic_count + key[kept] % topic_count, return_inverse=True)
    mass = np.bincount(place, similarity[kept], len(key))
    owner = key // topic_count
    share = mass / np.bincount(owner, mass, len(start))[owner]
    return pa.RecordBatch.from_arrays(
        [category.take(pa.array(start[owner])), pa.array(paper[start[owner]]),
         pa.array((key % topic_count).astype(np.int32)), pa.array(share)],
        names=["category", "paper_id", "topic", "p"])


def _of_slice(own: Slice, entries: dict[str, np.ndarray], window: int, longest: int,
              min_similarity: float) -> Iterator[pa.RecordBatch]:
    """Topic shares of the papers of a slice, some papers of one category after the other."""
    width = max(1, len(own.names))
    begin = np.cumsum(entries["sizes"]) - entries["sizes"]
    found: dict[str, list] = {name: [] for name in ("name", "paper", "place", "entry")}
    lows, highs, sizes, held = [], [], [], 0
    for n, text, gram, bounds, lo, hi, _ in _places(own.words, longest, window):
        of_n = np.flatnonzero(entries["n"] == n)
        key = entries["gram"][of_n] * width + entries["name"][of_n]
        order = np.argsort(key)
        key, of_n = key[order], of_n[order]
        at, name = own.named(text)
        if len(key) and len(at):
            wanted = gram[at] * width + name
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            met = np.flatnonzero(key[place] == wanted)
            found["name"].append(name[met])
            found["paper"].append(own.owner[text[at[met]]])
            found["place"].append(at[met] + held)
            found["entry"].append(of_n[place[met]])
        held += len(text)
        lows.append(lo)
        highs.append(hi)
        sizes.append(np.diff(bounds))
    if not sum(map(len, found["name"])):
        return
    name, paper, place, entry = (np.concatenate(found[x]) for x in ("name", "paper", "place", "entry"))
    order = np.lexsort((paper, name))
    name, paper, place, entry = name[order], paper[order], place[order], entry[order]
    lo, hi, size = np.concatenate(lows), np.concatenate(highs), np.concatenate(sizes)
    first = np.cumsum(size) - size
    new = np.flatnonzero(np.r_[True, (paper[1:] != paper[:-1]) | (name[1:] != name[:-1]), True])
    low = 0
    while low < len(new) - 1:  # whole papers, one at least
        high = max(low + 1, int(np.searchsorted(new, new[low] + ROWS, "right")) - 1)
        rows = slice(new[low], new[high])
        at, term = place[rows], entry[rows]
        spots = np.repeat(first[at], size[at]) + runs(size[at])
        each = np.repeat(begin[term], entries["sizes"][term]) + runs(entries["sizes"][term])
        weights = pa.StructArray.from_arrays(
            [pa.array(entries["topics"][each].astype(np.int32)), pa.array(entries["values"][each])], ["topic", "v"])
        bounds = pa.array(np.r_[0, np.cumsum(size[at])].astype(np.int32))
        yield _shares(pa.table({
            "category": own.names.take(pa.array(name[rows])), "paper_id": pa.array(own.papers[paper[rows]]),
            "lo": pa.ListArray.from_arrays(bounds, pa.array(lo[spots].astype(np.int32))),
            "hi": pa.ListArray.from_arrays(bounds, pa.array(hi[spots].astype(np.int32))),
            "idf": pa.array(entries["idf"][term]),
            "weights": pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(entries["sizes"][term])].astype(np.int32)), weights)}), min_similarity)
        low = high


def topic_distribution(texts: DataFrame, categories: DataFrame, scores: DataFrame,
                       stop_words: Sequence[str] = (), longest: int = NGRAM_MAX,
                       window: int = WINDOW, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Sparse (category, paper_id, topic, p), p > 0, summing to 1 per paper; papers without mass are absent.

    Slices of papers look their distinct terms up, so a term's weights pass the shuffle once
    for a slice and category. Windows are summed within the slice, some whole papers at once.
    """
    weights = topic_weights(scores).select(
        F.col("category").alias("name"), "term", "idf", F.col("weights.topic").alias("topics"),
        F.col("weights.v").alias("values"))

    def shares(own: Slice, entries: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        return _of_slice(own, entries, window, longest, min_similarity)

    return looked_up(texts, categories.select("paper_id", F.col("category").alias("name")), weights, shares,
                     "category string, paper_id long, topic int, p double", stop_words, longest)


def main_topic(distribution: DataFrame, members: DataFrame, drop_unassigned: bool = False,
               digits: int | None = DIGITS) -> DataFrame:
    """(category, paper_id, topic): the first topic of greatest share; a paper without mass is topic 0."""
    p = F.col("p") if digits is None else F.round("p", digits)
    best = distribution.groupBy("category", "paper_id").agg(
        F.max_by("topic", F.struct(p, -F.col("topic"))).alias("topic"))
    how = "inner" if drop_unassigned else "left"
    return (members.select("category", "paper_id").join(best, ["category", "paper_id"], how)
            .select("category", "paper_id", F.coalesce("topic", F.lit(0)).alias("topic")))


def dense_main_topic(shares: Column) -> Column:
    """First argmax of a dense array of shares."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("int")
