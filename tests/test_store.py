from datetime import date, datetime

from pyspark.sql import functions as F

from trendspark.operators.listing import papers_by_category, slice_bounds
from trendspark.functions.ordering import slice_rows, with_row_index
from trendspark.schema import RAW_PAPERS
from trendspark.sources import catalog, landing, store


def raw(spark, rows):
    full = [(f"http://x/abs/{i}", title, "s", [("a",)], cats, stamp, stamp, None)
            for i, title, cats, stamp in rows]
    return spark.createDataFrame(full, RAW_PAPERS)


def papers(spark, rows):
    return landing.to_papers(landing.to_records(raw(spark, rows)))


D1 = datetime(2020, 1, 1)
D2 = datetime(2020, 1, 2)


def test_day_window_includes_both_midnights(spark):
    rows = raw(spark, [("1v1", "a", ["X"], D1), ("2v1", "b", ["X"], D2),
                       ("3v1", "c", ["X"], datetime(2020, 1, 2, 0, 0, 1))])
    got = [r.arxiv_id for r in landing.scan_day(rows, date(2020, 1, 1), None).collect()]
    assert got == ["2v1", "1v1"]
    hits = {str(r.day): r.n for r in landing.day_hits(rows, date(2019, 12, 31), date(2020, 1, 2)).collect()}
    assert hits == {"2019-12-31": 1, "2020-01-01": 2, "2020-01-02": 2}
    span = landing.scan_date_range(rows, date(2020, 1, 1), date(2020, 1, 1))
    assert {r.arxiv_id for r in span.collect()} == {"1v1", "2v1"}


def test_scalar_category_becomes_list(spark):
    df = spark.createDataFrame([("cs.AI",)], "categories string")
    assert landing.as_category_list(df).first().categories == ["cs.AI"]


def test_register_is_insert_ignore(spark, tmp_path):
    repo = store.PaperStore(spark, str(tmp_path))
    batch = papers(spark, [("1v1", "b", ["A.X", "a.x", "B"], D1), ("1v1", "a", ["C"], D1), ("2v1", "t", ["B"], D2)])
    repo.register(batch)
    assert [(r.paper_id, r.arxiv_id, r.title) for r in repo.papers().sort("paper_id").collect()] == [
        (1, "1v1", "a"), (2, "2v1", "t")]
    repo.register(papers(spark, [("1v1", "a", ["D"], D1), ("3v1", "n", ["D"], D1)]))
    repo.register(batch)
    assert [(r.paper_id, r.arxiv_id) for r in repo.papers().sort("paper_id").collect()] == [
        (1, "1v1"), (2, "2v1"), (3, "3v1")]
    assert sorted((r.paper_id, r.category) for r in repo.bridge().collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_interrupted_registration_is_repaired(spark, tmp_path):
    repo = store.PaperStore(spark, str(tmp_path))
    batch = papers(spark, [("1v1", "a", ["C"], D1)])
    spark.createDataFrame([(1, "c")], "paper_id long, category string").write.partitionBy("category").parquet(
        repo.bridge_path)
    repo.register(batch)
    got = papers_by_category(repo.papers(), repo.bridge(), "C").collect()
    assert [(r.paper_id, r.categories) for r in got] == [(2, ["c"])]


def test_slices(spark):
    assert slice_bounds(None, 2) == (None, 2)
    assert slice_bounds(2, None) == (2, None)
    assert slice_bounds(1, 3) == (1, 2)
    rows = [(i, f"{i}", "t", None, date(2020, 1, i)) for i in range(1, 6)]
    table = spark.createDataFrame(rows, "paper_id long, arxiv_id string, title string, abstract string, published date")
    bridge = spark.createDataFrame([(i, "c") for i in range(1, 6)], "paper_id long, category string")

    def ids(a, b):
        return [r.paper_id for r in papers_by_category(table, bridge, "C", start_idx=a, end_idx=b).collect()]

    assert ids(None, 2) == [1, 2]
    assert ids(2, None) == [3, 4, 5]
    assert ids(1, 3) == [2, 3]


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 37 % 1000).cast("long")).repartition(7)
    got = with_row_index(df, [F.col("k")], "i").collect()
    assert all(r.k == r.i for r in got) and len(got) == 1000
    deep = slice_rows(df, [F.col("k")], 990, None).collect()
    assert sorted(r.k for r in deep) == list(range(990, 1000))


def test_dimension(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# head\ncs.AI: Artificial: intelligence\n'q.X': \"Quoted\"\n\ncsx: None such\n")
    dim = catalog.read_dimension(spark, str(path))
    assert {(r.code, r.description) for r in dim.collect()} == {
        ("cs.AI", "Artificial: intelligence"), ("q.X", "Quoted"), ("csx", "None such")}
    assert [r.code for r in catalog.codes(catalog.with_prefix(dim, "cs.")).collect()] == ["cs.AI"]
    assert catalog.with_prefix(dim, "CS.").count() == 0
    assert catalog.descriptions(dim).count() == 3


def test_snapshot_skips_finished_categories(spark, tmp_path):
    path = str(tmp_path / "snap")
    store.snapshot(spark, spark.createDataFrame([("a", 1)], "category string, v int"), path)
    again = store.snapshot(spark, spark.createDataFrame([("a", 9), ("b", 2)], "category string, v int"), path)
    assert sorted((r.category, r.v) for r in again.collect()) == [("a", 1), ("b", 2)]
    assert [r.v for r in store.read_by_category(spark, path, "B").collect()] == [2]


def text_exchanges(df):
    """Exchanges that pass on a title, an abstract or a whole text."""
    def walk(node):
        names = {node.output().apply(i).name() for i in range(node.output().size())}
        if "Exchange" in node.nodeName() and names & {"title", "abstract", "text"}:
            yield node.nodeName()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    return list(walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan))


def test_texts_stay_in_their_buckets(spark, tmp_path):
    from trendspark.operators import ctfidf, distribution, keywords, represent

    repo = store.PaperStore(spark, str(tmp_path), 12)
    words = ["graph", "model", "deep", "net", "loss"]
    repo.register(papers(spark, [(f"{i}v1", " ".join(words[i % 5:] * 3), ["A", "B"], D1) for i in range(40)]))
    repo.register(papers(spark, [(f"{i}v1", "more graph words", ["A"], D2) for i in range(30, 60)]))
    again = store.PaperStore(spark, str(tmp_path))
    assert again.n_buckets == 12 and again.papers().count() == 60
    topics = repo.bridge().select("category", "paper_id", (F.col("paper_id") % 3).cast("int").alias("topic"))
    texts = store.Collection(repo.papers(), repo.bridge()).texts()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classed = ctfidf.classed_texts(texts, topics)
        counts = ctfidf.class_term_counts(classed)
        daily = keywords.daily_counts(repo.papers(), repo.bridge())
        windows = distribution.window_occurrences(texts, repo.bridge())
        terms = counts.select("category", "topic", "term", "tf", F.lit(1.0).alias("idf"), F.lit(0.5).alias("score"))
        docs = represent.representative_docs(texts, topics, terms)
        plain = repo.papers().repartition(3).join(topics.select("paper_id").distinct(), "paper_id")
        assert text_exchanges(plain)
        for df in (classed, counts, daily, windows, docs):
            assert "Bucketed: true" in df._jdf.queryExecution().executedPlan().toString()
            assert not text_exchanges(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert daily.where("token = 'graph' and category = 'a'").agg(F.sum("count")).first()[0] > 0
    assert classed.count() == 60 and docs.count() > 0
