"""Counts of terms per class: one shuffle of packed blocks, whatever the classes of a paper."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trendspark.operators import ctfidf

WORDS = ["graph", "model", "deep", "net", "the", "größe", "loss", "x1"]
TEXTS = [(i, " ".join(WORDS[(i * k) % 8] for k in range(1, 2 + i % 13))) for i in range(60)] + [(7, "graph graph"), (61, "")]
# papers in two categories, some with two topics in one of them
CLASSES = [(c, i, k) for i in range(62) for c, k in {("a", i % 3 - 1), (f"s{i % 4}", i % 3 - 1), ("a", i % 2)}]


def brute(stop=()):
    tf, papers = defaultdict(Counter), defaultdict(Counter)
    of = defaultdict(set)
    for c, i, k in CLASSES:
        of[i].add((c, k))
    for i, text in TEXTS:
        kept = [w for w in text.split() if w not in stop]
        grams = [" ".join(kept[s:s + n]) for n in (1, 2, 3) for s in range(len(kept) - n + 1)]
        for c, k in of[i]:
            for g in grams:
                tf[c, g][k] += 1
        for c in {c for c, _ in of[i]}:
            for g in set(grams):
                papers[c][g] += 1
    return tf, papers


def classed(spark):
    texts = spark.createDataFrame(TEXTS, "paper_id long, text string")
    return ctfidf.classed_texts(texts, spark.createDataFrame(CLASSES, "category string, paper_id long, topic int"))


def test_postings_match_brute_force(spark, monkeypatch):
    want, papers = brute(["the"])
    for part_bytes, slices in ((1 << 22, 1 << 18), (100, 40)):  # one part and slice, then many
        monkeypatch.setattr(ctfidf, "PART_BYTES", part_bytes)
        monkeypatch.setattr(ctfidf, "COUNTED_TOKENS", slices)
        rows = ctfidf.class_postings(classed(spark).repartition(3), ["the"], papers=True).collect()
        assert len(rows) == len(want)
        for r in rows:
            got = {p.topic: p.tf for p in r.postings}
            assert got == dict(want[r.category, r.term]) and len(got) == len(r.postings) == r.df
            assert r.f == sum(got.values()) and r.papers == papers[r.category][r.term]


def test_no_exchange_holds_a_term(spark):
    """Counts used to pass an exchange as rows (category, topic, term), and then others by term."""
    counts = ctfidf.class_term_counts(classed(spark))
    seen = ctfidf.document_frequency(ctfidf.class_postings(classed(spark))).groupBy("category", "df").agg(F.count("*"))
    for df in (counts, seen):
        exchanges = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
        assert exchanges and not [line for line in exchanges if "term" in line]


def test_blocks_are_smaller_than_their_terms():
    """A slice sends a term once for all classes that hold it, compressed."""
    rng = np.random.default_rng(5)
    lists = [[f"word{w}" for w in rng.integers(0, 3000, 200)] for _ in range(100)]
    classes = [[{"category": "a", "topic": i % 7}, {"category": f"source{i % 20}", "topic": i % 7}] for i in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(classes), pa.array(lists)], ["classes", "tokens"])
    (out,) = ctfidf._counted(rows, pa.array([], pa.string()), 3, False, 4)
    read = pa.concat_batches(b for blob in out["block"] for b in ctfidf._merged([blob.as_buffer()]))
    assert read.num_rows > 90_000 and out["block"].nbytes < read["term"].nbytes / 3
