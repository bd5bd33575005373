"""What daily keyword counts shuffle."""

from __future__ import annotations

from collections import Counter
from datetime import date

from trendspark.operators import keywords

D1, D2 = date(2020, 1, 1), date(2020, 2, 2)
# a repeated id on two days, a null abstract, a null day
PAPERS = [(1, "graph graph net", "net net", D1), (2, "net", None, D1), (2, "net loss", "the loss", D2), (3, "graph", "", None)]
NAMES = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c"), (3, None), (4, "a")]


def counts(spark):
    papers = spark.createDataFrame(PAPERS, "paper_id long, title string, abstract string, published date")
    return keywords.daily_counts(papers, spark.createDataFrame(NAMES, "paper_id long, category string"), ["the"])


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    return [line for line in plan if "Exchange hashpartitioning" in line]


def test_counts_of_repeated_ids_and_null_days(spark):
    title, abstract = Counter(), Counter()
    for i, t, a, day in PAPERS:
        for name in {n for j, n in NAMES if j == i and n}:
            title.update((w, name, day) for w in t.split())
            abstract.update((w, name, day) for w in (a or "").split() if w != "the")
    got = {(r.token, r.category, r.published): (r.title_count, r.abstract_count, r["count"]) for r in counts(spark).collect()}
    assert got == {k: (title[k], abstract[k], title[k] + abstract[k]) for k in {*title, *abstract}}


def test_a_token_is_shuffled_once_for_all_categories(spark):
    """It used to be a row per category of a paper."""
    token = [line for line in exchanges(counts(spark)) if "token" in line]
    assert len(token) == 1 and "category" not in token[0]
