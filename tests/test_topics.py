import math
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.functions import sizing, text
from trendspark.operators import correlate, ctfidf, distribution, report

STOP = ["the", "of"]
TEXTS = {
    1: "The the model of models learns deep deep deep model",
    2: "graph model of the graph network learns",
    3: "deep graph",
    4: "of the",
    5: "star galaxy star star galaxy cluster of galaxy cluster",
    6: "galaxy model deep star",
    7: "model deep graph star galaxy",
}
TOPIC = {1: 0, 2: 0, 3: 1, 4: -1, 5: 2, 6: 2, 7: 1}


def ngrams(words):
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def kept(words):
    return [w for w in words if w not in STOP]


def brute_scores(min_df=1):
    tf = defaultdict(Counter)
    for i, t in TEXTS.items():
        tf[TOPIC[i]].update(ngrams(kept(t.split())))
    df = Counter(w for c in tf.values() for w in c)
    vocab = {w for w, n in df.items() if n >= min_df}
    total = {k: sum(n for w, n in c.items() if w in vocab) for k, c in tf.items()}
    total = {k: v for k, v in total.items() if v}
    mean = int(sum(total.values()) / len(total))
    f = Counter()
    for c in tf.values():
        f.update(c)
    idf = {w: math.log(1 + (mean - f[w] + 0.5) / (f[w] + 0.5)) for w in vocab}
    score = {k: {w: tf[k][w] / total[k] * idf[w] for w in tf[k] if w in vocab} for k in total}
    return idf, score


def brute_distribution(idf, score):
    out = {}
    for i, t in TEXTS.items():
        words = t.split()
        starts = range(max(len(words) - 3, 1))
        mass = Counter()
        for s in starts:
            bag = Counter(w for w in ngrams(kept(words[s:s + 4])) if w in idf)
            weight = {w: n * idf[w] for w, n in bag.items()}
            norm = math.sqrt(sum(v * v for v in weight.values()))
            if not norm:
                continue
            for k, row in score.items():
                if k < 0:
                    continue
                sim = sum(v * row.get(w, 0.0) for w, v in weight.items())
                sim /= norm * math.sqrt(sum(v * v for v in row.values()))
                if round(sim, 9) >= 0.1:
                    mass[k] += sim
        whole = sum(mass.values())
        if whole:
            out[i] = {k: v / whole for k, v in mass.items()}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "paper_id long, text string")
    assign = spark.createDataFrame([("c", i, k) for i, k in TOPIC.items()], "category string, paper_id long, topic int")
    parameters = spark.createDataFrame([("c", 1, 100)], "category string, min_df int, max_df long")
    scores = ctfidf.fit(texts, assign, parameters, STOP)
    return texts, assign, scores


def test_case_sensitive_stop_words(spark):
    df = spark.createDataFrame([("The the model",)], "text string")
    assert [r.term for r in text.explode_spans(df, ["the"]).collect()] == ["The", "model", "The model"]


def test_null_abstract(spark):
    df = spark.createDataFrame([("t", None)], "title string, abstract string")
    assert df.select(text.input_text(F.col("title"), F.col("abstract"))).first()[0] == "t[SEP]None"
    assert df.select(text.input_text(F.col("title"), F.col("abstract"), "")).first()[0] == "t[SEP]"


def test_sizes(spark):
    df = spark.createDataFrame([(100,), (20000,), (100000,), (760000,)], "n long")
    n = F.col("n")
    got = df.select(sizing.n_neighbors(n), sizing.min_df(n), sizing.min_cluster_size(n), sizing.min_samples(n),
                    sizing.max_df(n)).collect()
    assert [tuple(r) for r in got] == [
        (10, 2, 10, 6, 65), (10, 2, 141, 94, 13000), (10, 10, 316, 210, 65000), (11, 30, 871, 580, 494000)]


def test_scores_match_brute_force(tables):
    idf, score = brute_scores()
    rows = ctfidf.topic_terms(tables[2]).collect()
    assert len(rows) == sum(len(c) for c in score.values())
    for r in rows:
        assert r.score == pytest.approx(score[r.topic][r.term], abs=1e-12)


def test_frequent_terms_have_a_negative_idf(spark):
    """A term more frequent than the mean class is long keeps its negative idf."""
    got = spark.range(1).select(ctfidf.idf(F.lit(10.0), F.lit(4.0)).alias("v")).first().v
    assert got == pytest.approx(math.log(1 + (4 - 10 + 0.5) / (10 + 0.5))) and got < 0


def test_distribution_matches_brute_force(spark, tables):
    texts, assign, scores = tables
    got = defaultdict(dict)
    for r in distribution.topic_distribution(texts, assign.select("category", "paper_id"), scores, STOP).collect():
        got[r.paper_id][r.topic] = r.p
    want = brute_distribution(*brute_scores())
    assert set(got) == set(want) and 4 not in got
    for i in want:
        assert set(got[i]) == set(want[i])
        for k in want[i]:
            assert got[i][k] == pytest.approx(want[i][k], abs=1e-9)


def test_paper_scope(spark):
    texts = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "paper_id long, text string")
    assign = spark.createDataFrame([("c", 1, 0), ("c", 2, 0)], "category string, paper_id long, topic int")
    parameters = spark.createDataFrame([("c", 2, 100)], "category string, min_df int, max_df long")
    assert ctfidf.fit(texts, assign, parameters).count() == 0
    assert [r.term for r in ctfidf.fit(texts, assign, parameters, df_scope="paper").collect()] == ["aa"]


def dense_correlation(x):
    k = x.shape[1]
    out = np.ones((k, k))
    for i in range(k):
        for j in range(k):
            if i == j:
                continue
            p, q = x[:, i] / x[:, i].sum(), x[:, j] / x[:, j].sum()
            m = (p + q) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                kl = [np.where(a > 0, a * np.log(a / m), 0).sum() for a in (p, q)]
            js = 1 - math.sqrt(max(0, (kl[0] + kl[1]) / 2))
            cos = x[:, i] @ x[:, j] / np.linalg.norm(x[:, i]) / np.linalg.norm(x[:, j])
            out[i, j] = np.clip(0.3 * (2 * cos - 1) + 0.7 * (2 * js - 1), -1, 1)
    return out


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = rng.random((40, 5)) * (rng.random((40, 5)) > 0.5)
    x[:20, 3] = 0
    x[20:, 4] = 0
    rows = [("c", i, k, float(x[i, k])) for i in range(40) for k in range(5) if x[i, k] > 0]
    dist = spark.createDataFrame(rows, "category string, paper_id long, topic int, p double")
    topics = spark.createDataFrame([("c", k) for k in range(6)], "category string, topic int")
    got = {(r.i, r.j): r["corr"] for r in correlate.correlations(dist, topics).collect()}
    assert len(got) == 36
    want = dense_correlation(x)
    for i in range(5):
        for j in range(5):
            assert got[i, j] == pytest.approx(want[i, j], abs=1e-12)
        assert got[i, 5] is None and got[5, i] is None
    assert got[5, 5] == 1.0
    assert got[3, 4] == pytest.approx(-0.765576, abs=1e-6)
    low = correlate.correlation_range(correlate.correlations(dist, topics)).first()
    assert low.highest == 1.0 and low.lowest == pytest.approx(want.min())


def test_main_topic_and_series(spark):
    dist = spark.createDataFrame([("c", 2, 0, 0.2), ("c", 2, 1, 0.4), ("c", 2, 2, 0.4)],
                                 "category string, paper_id long, topic int, p double")
    members = spark.createDataFrame([("c", 1), ("c", 2)], "category string, paper_id long")
    main = distribution.main_topic(dist, members)
    assert {r.paper_id: r.topic for r in main.collect()} == {1: 0, 2: 1}
    assert distribution.main_topic(dist, members, drop_unassigned=True).count() == 1
    papers = spark.createDataFrame([(1, date(2020, 1, 5)), (2, date(2020, 3, 1))], "paper_id long, published date")
    topics = spark.createDataFrame([("c", k) for k in range(3)], "category string, topic int")
    series = {(r.month, r.topic): r.n for r in report.monthly_series(main, papers, topics).collect()}
    assert series == {(m, k): 0 for m in ("2020-01", "2020-03") for k in range(3)} | {
        ("2020-01", 0): 1, ("2020-03", 1): 1}
    dense = spark.createDataFrame([([0.0, 0.0, 0.0],), ([0.2, 0.4, 0.4],)], "d array<double>")
    assert [r[0] for r in dense.select(distribution.dense_main_topic(F.col("d"))).collect()] == [0, 1]


def test_relabel(spark):
    df = spark.createDataFrame([("c", i, k) for i, k in enumerate([5, 5, 3, 3, 3, -1, -1, -1, -1])],
                               "category string, paper_id long, topic int")
    sizes = {r.topic: r["count"] for r in report.topic_sizes(report.relabel_by_size(df)).collect()}
    assert sizes == {0: 3, 1: 2, -1: 4}


def test_same_text_resolves_to_last_paper(spark):
    papers = spark.createDataFrame(
        [(1, "a1", "t", "x", date(2020, 1, 1)), (2, "a2", "t", "x", date(2021, 2, 1))],
        "paper_id long, arxiv_id string, title string, abstract string, published date")
    reps = spark.createDataFrame([("c", 0, 1, 1)], "category string, topic int, rank int, paper_id long")
    assert [(r.arxiv_id, r.year) for r in report.representative_papers(reps, papers).collect()] == [("a2", "2021-02")]
