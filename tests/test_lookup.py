import pytest
from pyspark.sql import functions as F

from trendspark.operators import ctfidf, distribution, lookup

WORDS = ["graph", "model", "deep", "net", "loss", "node", "edge"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, " ".join(WORDS[(i + j) % 7] for j in range(9))) for i in range(40)] + [(3, "graph deep deep"), (90, None), (91, "")]
    texts = spark.createDataFrame(rows, "paper_id long, text string")
    assign = spark.createDataFrame([(c, i, i % 3) for i in range(92) for c in ("a", "b") if c == "a" or i % 2],
                                   "category string, paper_id long, topic int")
    parameters = spark.createDataFrame([("a", 1, 100), ("b", 2, 100)], "category string, min_df int, max_df long")
    return texts, assign, ctfidf.scored(ctfidf.postings(ctfidf.class_postings(ctfidf.classed_texts(texts, assign)), parameters))


def exchanged(df):
    """Names of the columns that pass an exchange."""
    def walk(node):
        if "Exchange" in node.nodeName():
            yield from (node.output().apply(i).name() for i in range(node.output().size()))
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    return set(walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan))


def test_no_exchange_has_a_row_for_each_paper_and_term(spark, tables):
    texts, assign, scores = tables
    found = distribution.topic_distribution(texts, assign.select("category", "paper_id"), scores)
    assert not exchanged(found) & {"lo", "hi"}


def test_any_slices_parts_and_filters_give_the_same_shares(spark, tables, monkeypatch):
    texts, assign, scores = tables

    def shares():
        found = distribution.topic_distribution(texts, assign.select("category", "paper_id"), scores)
        return {(r.category, r.paper_id, r.topic): r.p for r in found.collect()}

    want = shares()
    assert want and {c for c, _, _ in want} == {"a", "b"} and not {90, 91} & {i for _, i, _ in want}
    for tokens, part, slots in ((1, 100, 1 << 22), (30, 1 << 20, 1), (1 << 18, 40, 2)):
        monkeypatch.setattr(lookup, "SLICE_TOKENS", tokens)
        monkeypatch.setattr(lookup, "PART_BYTES", part)
        monkeypatch.setattr(lookup, "MOST_SLOTS", slots)
        assert shares() == pytest.approx(want, abs=1e-12)


def test_no_vocabulary_gives_no_shares(spark, tables):
    texts, assign, scores = tables
    empty = scores.where(F.lit(False))
    assert distribution.topic_distribution(texts, assign.select("category", "paper_id"), empty).count() == 0
