import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark import scratch
from trendspark.operators import encode, represent
from trendspark.plans import embed, ingest, train, trends
from trendspark.schema import RAW_PAPERS
from trendspark.sources import store, testtables
from trendspark.streaming import ingest as stream_ingest
from trendspark.streaming import keywords as stream_keywords


def records(ids, day=1, cats=("A.x",)):
    return [(f"http://x/abs/{i}", f"graph model {i}", "deep graph", [("n",)], list(cats),
             datetime(2020, 1, day), datetime(2020, 1, day), None) for i in ids]


def land(spark, rows, path):
    spark.createDataFrame(rows, RAW_PAPERS).coalesce(1).write.mode("append").parquet(path)


def test_streamed_ingest_is_replay_safe(spark, tmp_path):
    path, root = str(tmp_path / "landing"), str(tmp_path / "store")
    land(spark, records(["1v1", "2v1"]), path)
    land(spark, records(["2v1", "3v1"], 2), path)

    def run(checkpoint):
        stream_ingest.ingest_stream(spark, path, root, str(tmp_path / checkpoint), files_per_batch=1).awaitTermination()
        repo = store.PaperStore(spark, root)
        return (sorted((r.paper_id, r.arxiv_id) for r in repo.papers().collect()),
                sorted((r.paper_id, r.category) for r in repo.bridge().collect()))

    first = run("one")
    assert [i for _, i in first[0]] in (["1v1", "2v1", "3v1"], ["2v1", "3v1", "1v1"])
    assert run("two") == first


def test_stream_reads_the_store_once(spark, tmp_path, monkeypatch):
    path, root, reads = str(tmp_path / "landing"), str(tmp_path / "store"), []
    land(spark, records(["0v1"]), path)
    stream_ingest.ingest_stream(spark, path, root, str(tmp_path / "one")).awaitTermination()
    for day in range(1, 5):
        land(spark, records([f"{day - 1}v1", f"{day}v1"], day), path)
    read = store.PaperStore.papers

    def papers(self):
        reads.append(self)
        return read(self)

    monkeypatch.setattr(store.PaperStore, "papers", papers)
    stream_ingest.ingest_stream(spark, path, root, str(tmp_path / "two"), files_per_batch=1).awaitTermination()
    assert len(reads) == 2  # the last number and the ids, not twice a batch
    repo = store.PaperStore(spark, root)
    assert sorted(r.paper_id for r in read(repo).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.arxiv_id for r in read(repo).collect()) == [f"{day}v1" for day in range(5)]


def test_seen_ids_stay_in_few_tables(spark, tmp_path):
    repo = store.PaperStore(spark, str(tmp_path))
    seen = store.Seen(repo)
    for n in range(9):
        with scratch.scope() as own:
            seen.add(spark.range(n, n + 1).select(F.concat("id", F.lit("v1")).alias("arxiv_id"), F.col("id").alias("paper_id")), own)
    assert len(seen.tables) <= 4 and seen.top == 8
    assert sorted(r.arxiv_id for r in seen.ids().collect()) == [f"{n}v1" for n in range(9)]


def test_streamed_keywords_count_once(spark, tmp_path):
    path, root = str(tmp_path / "landing"), str(tmp_path / "kw")
    land(spark, records(["1v1"], cats=("A", "B")), path)
    stream_keywords.keyword_stream(spark, path, root, str(tmp_path / "c")).awaitTermination()
    land(spark, records(["1v1", "2v1"], cats=("A", "B")), path)
    stream_keywords.keyword_stream(spark, path, root, str(tmp_path / "c")).awaitTermination()
    got = {(r.token, r.category): (r.title_count, r.abstract_count, r["count"])
           for r in stream_keywords.read_counts(spark, root).collect()}
    assert got["graph", "a"] == got["graph", "b"] == (2, 2, 4) and got["deep", "a"] == (0, 2, 2)
    from trendspark.sources import landing
    batch = landing.to_records(spark.read.schema(RAW_PAPERS).parquet(path))
    last = max(int(r.batch_id) for r in spark.read.parquet(f"{root}/ids").select("batch_id").distinct().collect())
    stream_keywords.add_batch(spark, batch, root, last)
    again = {(r.token, r.category): r["count"] for r in stream_keywords.read_counts(spark, root).collect()}
    assert again["graph", "a"] == 4


def test_diversity_skips_the_near_copy():
    words = np.array([[1.0, 0.0], [0.99, 0.1], [0.3, 0.95], [0.6, 0.8], [0.0, 1.0]])
    words /= np.linalg.norm(words, axis=1, keepdims=True)
    assert represent.spread(words, np.array([1.0, 0.0]), 3, 0.7)[0] == 0
    assert 1 not in represent.spread(words, np.array([1.0, 0.0]), 3, 0.7)
    assert sorted(represent.spread(words, np.array([1.0, 0.0]), 9, 0.7)) == [0, 1, 2, 3, 4]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "graph model graph"), (2, "")], "paper_id long, text string")
    rows = {r.paper_id: r.embedding for r in encode.HashingEncoder(32).encode(df).collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6) and not any(rows[2])
    assert encode.HashingEncoder(32).encode(df).schema["embedding"].dataType.simpleString() == "array<float>"
    short = encode.HashingEncoder(32, max_tokens=1).encode(df).where("paper_id = 1").first().embedding
    assert sorted(short)[-2:] == [0.0, 1.0]
    assert encode.HashingEncoder(32).fit(df).encode(df).count() == 2

    def make():
        def embed_batch(texts):
            assert len(texts) <= 2
            return np.array([[len(t), len(texts)] for t in texts])
        return embed_batch

    many = spark.createDataFrame([(i, "x" * i) for i in range(5)], "paper_id long, text string").coalesce(1)
    got = {r.paper_id: r.embedding for r in encode.FunctionEncoder(make, 2).encode(many).collect()}
    assert [got[i][0] for i in range(5)] == [0, 1, 2, 3, 4] and got[4][1] == 1
    assert encode.as_texts("a") == ["a"] and encode.as_texts(np.array([[1], [2]])) == ["1", "2"] and encode.as_texts(3) == ["3"]


def test_tags(spark):
    terms = spark.createDataFrame([("c", 0, t, 1.0) for t in ("Bert", "neural graph", "graph of graph", "of", "quickly")],
                                  "category string, topic int, term string, score double")
    lexicon = spark.createDataFrame([("neural", "ADJ"), ("bert", "PROPN")], "word string, tag string")
    got = {r.term: r.tags for r in represent.pattern_terms(terms, lexicon).collect()}
    assert got == {"Bert": "PROPN", "neural graph": "ADJ NOUN", "graph of graph": "NOUN ADP NOUN"}


@pytest.fixture(scope="module")
def jobs(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    landing = str(base / "landing")
    testtables.raw_papers(spark, sf_dir).write.parquet(landing)
    repo = ingest.backfill(spark, landing, str(base / "store"), date(2017, 9, 12), date(2025, 9, 17))
    wanted = spark.createDataFrame([("doc.EN",), ("doc.FR",)], "code string")
    papers, vectors = embed.embed_categories(spark, repo, encode.HashingEncoder(64), str(base / "pre"),
                                             from_date=date(2018, 1, 1), categories=wanted)
    return base, repo, papers, vectors


def test_whole_run(spark, jobs):
    base, repo, papers, vectors = jobs
    assert {r.category for r in papers.members.select("category").distinct().collect()} == {"doc.en", "doc.fr"}
    assert vectors.count() == papers.members.count() > 0
    topics = papers.members.select("category", "paper_id", (F.pmod("paper_id", F.lit(4)) - 1).cast("int").alias("topic"))
    model = train.fit_topics(papers, vectors, encode.HashingEncoder(64), ["the", "of"], assignments=topics)
    root = str(base / "model")
    store.save_tables(model, root)
    model = store.load_tables(spark, root, train.SCHEMAS)
    out = str(base / "reports")
    moment = F.lit("2025-09-18 01:02:03").cast("timestamp")
    reports = {r.category: json.loads(r.value)
               for r in trends.write_reports(spark, papers, model, out, moment, ["the", "of"]).collect()}
    assert set(reports) == {"doc.en", "doc.fr"}
    english = reports["doc.en"]
    count = papers.members.where("category = 'doc.en'").count()
    assert sum(sum(line) for line in english["topics"]["series"].values()) == count
    assert list(english["topics"]["series"]) == sorted(english["topics"]["series"])
    matrix = np.array(english["topics"]["correlations"], dtype=float)
    assert matrix.shape == (3, 3) and np.allclose(matrix, matrix.T) and np.allclose(np.diag(matrix), 1)
    assert set(english["topics"]["data"]) == set(english["topics"]["papers"]) == {"0", "1", "2"}
    assert all(len(t["keywords"]) <= 10 for t in english["topics"]["data"].values())
    assert all(1 <= len(p) <= 5 for p in english["topics"]["papers"].values())
    assert english["metadata"]["lastUpdated"] == "2025-09-18T01:02:03Z"
    before = reports
    after = {r.category: json.loads(r.value)
             for r in trends.write_reports(spark, papers, model, out, moment, ["the", "of"]).collect()}
    assert after == before


def test_second_embedding_run_adds_nothing(spark, jobs):
    base, repo, papers, vectors = jobs
    _, again = embed.embed_categories(spark, repo, encode.HashingEncoder(64), str(base / "pre"))
    names = {r.category for r in again.select("category").distinct().collect()}
    assert {"doc.en", "doc.fr", "doc.de"} <= names
    assert again.where("category = 'doc.en'").count() == vectors.where("category = 'doc.en'").count()
