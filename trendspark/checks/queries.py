"""Registered queries: each runs one operator over the whole given tables.

``queries()`` here and ``oracle_sql()`` in the sibling module share their keys and their
column names. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.checks import cluster_sql
from trendspark.functions import dates
from trendspark.functions.ordering import slice_rows, with_row_index
from trendspark.functions.sizing import corpus_parameters
from trendspark.functions.text import explode_spans, tokens
from trendspark.operators import (cluster, correlate, ctfidf, distribution, graph, keywords, listing, neighbors,
                                  reduce, report, represent)
from trendspark.operators.encode import FunctionEncoder, HashingEncoder
from trendspark.plans import embed, train, trends
from trendspark.scratch import cut, scratch_path
from trendspark.sources import catalog, landing, store, testtables
from trendspark.sources.testtables import table
from trendspark.streaming import ingest as stream_ingest
from trendspark.streaming import keywords as stream_keywords

# fixed values
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "on", "for", "with", "that", "by", "this",
              "der", "die", "und", "les", "des", "une", "los", "las", "que", "por")
TAGS = (("the", "DET"), ("of", "ADP"), ("and", "CCONJ"), ("ing", "NOUN"), ("er", "ADJ"), ("de", "ADP"))
DAY = date(2017, 9, 19)
START, END = date(2017, 9, 12), date(2025, 9, 17)
FIRST_RUN = (date(2017, 9, 12), date(2022, 6, 30))
SECOND_RUN = (date(2020, 1, 1), date(2025, 9, 17))


def r6(column) -> F.Column:
    return F.round(column, 6)


# ---- landed records -------------------------------------------------------------------

def record_projection(spark: SparkSession, sf: str) -> DataFrame:
    return landing.to_records(testtables.raw_papers(spark, sf)).select(
        "arxiv_id", "title", F.concat_ws(",", "authors").alias("authors"),
        F.concat_ws(",", "categories").alias("categories"),
        dates.compact_day(F.col("published_date")).alias("day"))


def day_window_scan(spark: SparkSession, sf: str) -> DataFrame:
    return landing.scan_day(testtables.raw_papers(spark, sf), DAY, None).select(
        "arxiv_id", dates.compact_day(F.col("published_date")).alias("day"))


def newest_first_scan(spark: SparkSession, sf: str) -> DataFrame:
    raw = testtables.raw_papers(spark, sf)
    return landing.newest_first(raw, F.col("summary").isNotNull(), 50).select(
        "arxiv_id", F.to_date("published_date").alias("published"))


def id_scan(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "labels").select(F.concat(
        F.lit("2309."), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("v1")).alias("arxiv_id"))
    return landing.scan_ids(testtables.raw_papers(spark, sf), labelled).select("arxiv_id", "title")


def scalar_category(spark: SparkSession, sf: str) -> DataFrame:
    raw = testtables.raw_papers(spark, sf).withColumn("categories", F.element_at("categories", 2))
    return landing.to_papers(landing.to_records(raw)).select(
        "arxiv_id", "published", F.size("categories").alias("n_categories"),
        F.element_at("categories", 1).alias("category"))


def paper_conversion(spark: SparkSession, sf: str) -> DataFrame:
    return landing.to_papers(landing.to_records(testtables.raw_papers(spark, sf))).select(
        "arxiv_id", "published", "title", "abstract", F.concat_ws(",", "categories").alias("categories"))


def backfill_days(spark: SparkSession, sf: str) -> DataFrame:
    return landing.day_hits(testtables.raw_papers(spark, sf), START, END)


def backfill_papers(spark: SparkSession, sf: str) -> DataFrame:
    found = landing.to_papers(landing.scan_date_range(testtables.raw_papers(spark, sf), START, END))
    return store.one_per_id(found).select("arxiv_id", "published", "title")


# ---- store ----------------------------------------------------------------------------

def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two backfills whose periods overlap."""
    raw = testtables.raw_papers(spark, sf)
    return tuple(landing.to_papers(landing.scan_date_range(raw, *run)) for run in (FIRST_RUN, SECOND_RUN))


def register_unseen(spark: SparkSession, sf: str) -> DataFrame:
    first, second = _runs(spark, sf)
    return store.unseen(store.one_per_id(second), first).select("arxiv_id", "published")


def register_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    repo = store.PaperStore(spark, scratch_path(spark, "store"))
    for batch in _runs(spark, sf):
        repo.register(batch)
    return repo.papers().select("paper_id", "arxiv_id", "published")


def category_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return store.bridge_of(testtables.papers(spark, sf))


def list_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return listing.list_by_category(
        testtables.papers(spark, sf), testtables.bridge(spark, sf), "doc.EN",
        date(2019, 1, 1), date(2024, 12, 31), limit=40, offset=5).select("paper_id", "arxiv_id", "published")


def papers_of_category(spark: SparkSession, sf: str) -> DataFrame:
    return listing.papers_by_category(
        testtables.papers(spark, sf).drop("categories"), testtables.bridge(spark, sf), "Doc.De",
        date(2018, 1, 1)).select("arxiv_id", "published", "title", F.concat_ws(",", "categories").alias("categories"))


def papers_any_category(spark: SparkSession, sf: str) -> DataFrame:
    return listing.papers_by_category(
        testtables.papers(spark, sf).drop("categories"), testtables.bridge(spark, sf),
        start_idx=20).select("arxiv_id", F.concat_ws(",", "categories").alias("categories"))


def snapshot_by_category(spark: SparkSession, sf: str) -> DataFrame:
    papers, path = testtables.stored_papers(spark, sf), scratch_path(spark, "snapshot")
    rows = listing.members(papers, testtables.bridge(spark, sf))
    store.snapshot(spark, rows, path)
    members = store.snapshot(spark, rows, path)
    return listing.extraction(papers.select("paper_id", "arxiv_id", "published"), members).groupBy("category").agg(
        F.count("*").alias("n"), F.min("published").alias("first"), F.max("arxiv_id").alias("last_id"))


def snapshot_one_category(spark: SparkSession, sf: str) -> DataFrame:
    papers, path = testtables.stored_papers(spark, sf), scratch_path(spark, "snapshot")
    store.write_by_category(listing.members(papers, testtables.bridge(spark, sf)), path)
    members = store.read_by_category(spark, path, "doc.FR")
    return listing.extraction(papers.select("paper_id", "title"), members)


def pending_categories(spark: SparkSession, sf: str) -> DataFrame:
    bridge = testtables.bridge(spark, sf)
    flagged = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("paper_id"))
    done = bridge.join(flagged, "paper_id", "left_semi").select("category")
    return catalog.pending(bridge.select("category").distinct(), done)


def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    lines = testtables.papers(spark, sf).select(F.explode("categories").alias("code")).distinct().select(
        F.concat("code", F.lit(": papers of "), "code").alias("value"))
    path = scratch_path(spark, "dimension")
    lines.write.text(path)
    return catalog.read_dimension(spark, path)


def category_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return _dimension(spark, sf)


def categories_with_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.codes(catalog.with_prefix(_dimension(spark, sf), "doc."))


# ---- keywords -------------------------------------------------------------------------

def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.daily_counts(testtables.stored_papers(spark, sf), testtables.bridge(spark, sf), STOP_WORDS)


def keyword_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _keywords(spark, sf)


def keyword_upsert(spark: SparkSession, sf: str) -> DataFrame:
    papers, bridge = testtables.stored_papers(spark, sf), testtables.bridge(spark, sf)
    runs = [keywords.daily_counts(papers.where(F.col("published").between(*run)), bridge, STOP_WORDS)
            for run in (FIRST_RUN, SECOND_RUN)]
    return keywords.upsert(*runs).groupBy("token", "category").agg(
        F.sum("title_count").alias("title_count"), F.sum("abstract_count").alias("abstract_count"),
        F.sum("count").alias("count"))


def keywords_of_month(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.lookup(_keywords(spark, sf), "DOC.en", 2020, 2)


def keywords_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.lookup(_keywords(spark, sf), "doc.en", DAY.year, DAY.month, DAY.day)


# ---- text and class TF-IDF ------------------------------------------------------------

def input_texts(spark: SparkSession, sf: str) -> DataFrame:
    return testtables.texts(spark, sf)


def tokenised_texts(spark: SparkSession, sf: str) -> DataFrame:
    words = tokens(F.col("text"))
    return testtables.texts(spark, sf).select(
        "paper_id", F.size(words).alias("n_tokens"), F.md5(F.concat_ws(" ", words)).alias("digest"))


def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return explode_spans(testtables.texts(spark, sf), STOP_WORDS).groupBy("paper_id", "n").agg(
        F.count("*").alias("terms"), F.countDistinct("term").alias("distinct_terms"))


def size_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_parameters(testtables.bridge(spark, sf))


def topic_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return report.topic_sizes(report.relabel_by_size(testtables.assignments(spark, sf)))


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    return ctfidf.classed_texts(testtables.texts(spark, sf), testtables.assignments(spark, sf))


def class_term_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ctfidf.class_term_counts(_classed(spark, sf), STOP_WORDS).groupBy("category", "topic").agg(
        F.sum("tf").alias("total"), F.count("*").alias("distinct_terms"), F.max("tf").alias("highest"))


def document_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return ctfidf.document_frequency(ctfidf.class_postings(_classed(spark, sf), STOP_WORDS)).groupBy("category", "df").agg(
        F.count("*").alias("terms"), F.sum("f").alias("occurrences"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    assigned = testtables.assignments(spark, sf)
    return ctfidf.fit(testtables.texts(spark, sf), assigned, corpus_parameters(assigned), STOP_WORDS)


def class_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return ctfidf.topic_terms(_scores(spark, sf)).select(
        "category", "topic", "term", "tf", r6("idf").alias("idf"), r6("score").alias("score"))


def class_tfidf_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the bounds on the number of papers that hold a term."""
    assigned = testtables.assignments(spark, sf)
    scores = ctfidf.fit(testtables.texts(spark, sf), assigned, corpus_parameters(assigned), STOP_WORDS, df_scope="paper")
    return ctfidf.topic_terms(scores).select(
        "category", "topic", "term", "tf", r6("idf").alias("idf"), r6("score").alias("score"))


def _top_words(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    return ctfidf.top_terms(ctfidf.topic_terms(_scores(spark, sf)), n, digits=9)


def topic_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _top_words(spark, sf).select("category", "topic", "rank", "term", r6("score").alias("score"))


def topic_table(spark: SparkSession, sf: str) -> DataFrame:
    info = report.topic_info(report.topic_sizes(testtables.assignments(spark, sf)), _top_words(spark, sf))
    return info.select("category", "topic", "name", "count", F.concat_ws(
        ",", F.transform("keywords", lambda k: k["word"])).alias("keywords"))


def keyword_tag_patterns(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = spark.createDataFrame(TAGS, "word string, tag string")
    return represent.pattern_terms(ctfidf.topic_terms(_scores(spark, sf)), lexicon, digits=9).select(
        "category", "topic", "rank", "term", "tags", r6("score").alias("score"))


def representative_docs(spark: SparkSession, sf: str) -> DataFrame:
    terms = ctfidf.topic_terms(_scores(spark, sf))
    return represent.representative_docs(
        testtables.texts(spark, sf), testtables.assignments(spark, sf), terms, STOP_WORDS).select(
        "category", "topic", "rank", "paper_id", r6("sim").alias("sim"))


def _stored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in stored representatives: the five longest papers of each topic."""
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "n_chars")
    order = Window.partitionBy("category", "topic").orderBy(F.desc("n_chars"), "paper_id")
    return (testtables.assignments(spark, sf).join(sizes, "paper_id")
            .withColumn("rank", F.row_number().over(order)).where("rank <= 5")
            .select("category", "topic", "rank", "paper_id"))


def representative_papers(spark: SparkSession, sf: str) -> DataFrame:
    return report.representative_papers(_stored_docs(spark, sf), testtables.papers(spark, sf), 3)


def representative_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = represent.representative_table(_stored_docs(spark, sf), testtables.papers(spark, sf))
    return docs.select("category", "topic", F.size("docs").alias("n_docs"),
                       F.md5(F.concat_ws("|", "docs")).alias("digest"))


# ---- distribution and trends ----------------------------------------------------------

def _distribution(spark: SparkSession, sf: str) -> DataFrame:
    return cut(distribution.topic_distribution(
        testtables.texts(spark, sf), testtables.bridge(spark, sf), _scores(spark, sf), STOP_WORDS), "distribution")


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    """A distribution read off the vectors: squares of the positive coordinates, scaled to 1."""
    cells = table(spark, sf, "embeddings").select(
        F.concat(F.lit("label"), "label").alias("category"), F.col("vec_id").alias("paper_id"),
        F.posexplode("embedding").alias("topic", "x")).where("x > 0")
    cells = cells.withColumn("x", F.col("x").cast("double")).withColumn("x", F.col("x") * F.col("x"))
    whole = F.sum("x").over(Window.partitionBy("category", "paper_id"))
    return cells.select("category", "paper_id", "topic", (F.col("x") / whole).alias("p"))


def _share_topics(spark: SparkSession, sf: str) -> DataFrame:
    """One topic more than there are coordinates, so that one has no mass."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("label"), "label").alias("category"), F.size("embedding").alias("_k")).groupBy(
        "category").agg(F.max("_k").alias("_k")).select(
        "category", F.explode(F.sequence(F.lit(0), "_k")).alias("topic"))


def topic_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf).select("category", "paper_id", "topic", r6("p").alias("p"))


def main_topics(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "embeddings").select(
        F.concat(F.lit("label"), "label").alias("category"), F.col("vec_id").alias("paper_id"))
    return distribution.main_topic(_shares(spark, sf), members)


def topic_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.similarities(cut(_shares(spark, sf), "shares"), _share_topics(spark, sf)).select(
        "category", "i", "j", r6("cosine").alias("cosine"), r6("js").alias("js"))


def topic_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.correlations(cut(_shares(spark, sf), "shares"), _share_topics(spark, sf)).select(
        "category", "i", "j", r6("corr").alias("corr"))


def correlation_range(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.correlation_range(topic_correlations(spark, sf))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return testtables.assignments(spark, sf).where("topic >= 0").select("category", "topic").distinct()


def text_topic_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.correlations(_distribution(spark, sf), _topics(spark, sf)).select(
        "category", "i", "j", r6("corr").alias("corr"))


def monthly_series(spark: SparkSession, sf: str) -> DataFrame:
    main = distribution.main_topic(_distribution(spark, sf), testtables.bridge(spark, sf))
    return report.monthly_series(main, testtables.papers(spark, sf), _topics(spark, sf))


def monthly_series_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum slice: series of the given assignment."""
    main = testtables.assignments(spark, sf).where("topic >= 0")
    return report.monthly_series(main, testtables.papers(spark, sf), _topics(spark, sf)).sort(
        "category", "month", "topic")


def monthly_series_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("paper_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("topic"),
        F.to_date("o_orderdate").alias("published"))
    topics = orders.select("category", "topic").distinct()
    return report.monthly_series(orders.drop("published"), orders.select("paper_id", "published"), topics)


def period_metadata(spark: SparkSession, sf: str) -> DataFrame:
    moment = F.lit("2025-09-18 01:02:03").cast("timestamp")
    return report.metadata(testtables.papers(spark, sf), testtables.bridge(spark, sf), moment).select(
        "category", "lastUpdated", "dataVersion", "period.start", "period.end")


def document_info(spark: SparkSession, sf: str) -> DataFrame:
    names = report.topic_info(report.topic_sizes(testtables.assignments(spark, sf)), _top_words(spark, sf))
    return report.document_info(testtables.papers(spark, sf), testtables.assignments(spark, sf), names).select(
        "category", "paper_id", "topic", "name", "arxiv_id", F.md5("text").alias("digest"))


def document_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Document info with given topic shares: three quarters for the own topic, a quarter for the next."""
    own = testtables.assignments(spark, sf).where("topic >= 0")
    shares = own.select("category", "paper_id", "topic", F.lit(0.75).alias("p")).unionByName(
        own.select("category", "paper_id", (F.col("topic") + 1).alias("topic"), F.lit(0.25).alias("p")))
    names = report.topic_info(report.topic_sizes(testtables.assignments(spark, sf)), _top_words(spark, sf))
    info = report.document_info(testtables.papers(spark, sf), testtables.assignments(spark, sf), names, shares)
    listed = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return info.select("category", "paper_id", "topic", "name", F.array_join(F.array_sort(listed), ",").alias("shares"))


def deep_slice(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return slice_rows(events, [F.col("user_id"), F.col("event_id")], offset=100)


# ---- vectors, clusters, representations -----------------------------------------------

def _points(spark: SparkSession, sf: str) -> DataFrame:
    return testtables.bridge(spark, sf).join(testtables.vectors(spark, sf), "paper_id").select(
        "category", "paper_id", F.col("embedding").alias("vector"))


def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.nearest(_points(spark, sf), 10).select(
        "category", "paper_id", "neighbor_id", "rank", r6("distance").alias("distance"))


def core_distances(spark: SparkSession, sf: str) -> DataFrame:
    everything = testtables.vectors(spark, sf).select(
        F.lit("all").alias("category"), "paper_id", F.col("embedding").alias("vector"))
    limits = cluster.size_limits(corpus_parameters(everything))
    samples = {name: v["samples"] for name, v in limits.items()}
    return neighbors.kth_distances(everything, samples).select(
        "category", "paper_id", r6("core").alias("core"))


def similarity_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.similarity_graph(neighbors.nearest(_points(spark, sf), 10)).select(
        "category", "a", "b", r6("weight").alias("weight"))


def reduced_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.reduce_vectors(_points(spark, sf)).select(
        "category", "paper_id", *[F.round(F.col("vector")[i], 6).alias(f"x{i}") for i in range(5)])


def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    everything = testtables.vectors(spark, sf).select(
        F.lit("all").alias("category"), "paper_id", F.col("embedding").alias("vector"))
    return cluster.density_clusters(reduce.reduce_vectors(everything))


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    """The first coordinates of the vectors, moved apart by their label: groups that touch."""
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    away = F.lit(cluster_sql.APART)
    return table(spark, sf, "embeddings").select(
        F.lit("all").alias("category"), F.col("vec_id").alias("paper_id"),
        F.array(x[0] + away * (F.col("label") % 4), x[1] + away * F.floor(F.col("label") / 4), x[2]).alias("vector"))


def tree_weights(spark: SparkSession, sf: str) -> DataFrame:
    points = _planted(spark, sf)
    tree = cluster.reachability_tree(points, cluster.size_limits(corpus_parameters(points)))
    return with_row_index(tree, [F.col("w"), F.col("a"), F.col("b")], "rank").select(
        "category", (F.col("rank") + 1).alias("rank"), r6("w").alias("w"))


def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.density_clusters(_planted(spark, sf))


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_clusters(spark, sf).groupBy("category", "topic").agg(F.count("*").alias("papers"))


def soft_membership(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.soft_membership(_points(spark, sf), testtables.assignments(spark, sf)).select(
        "category", "paper_id", "topic", r6("p").alias("p"))


def text_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    encoded = embed.encode_papers(testtables.papers(spark, sf), HashingEncoder(64))
    return encoded.select("paper_id", F.size("embedding").alias("dim"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")), 4).alias("length"))


def _length_and_words():
    """A stand-in model for a given function: characters and blanks of each text."""
    return lambda texts: np.array([[len(text), text.count(" ")] for text in texts], np.float32).reshape(-1, 2)


def category_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of two categories from a date on, by a given function; a second run over all adds the rest."""
    root = scratch_path(spark, "pre")
    repo = store.PaperStore(spark, f"{root}/store")
    repo.register(testtables.papers(spark, sf).drop("paper_id"))
    wanted = spark.createDataFrame([("doc.EN",), ("src3",)], "code string")
    encoder = FunctionEncoder(_length_and_words)
    embed.embed_categories(spark, repo, encoder, root, from_date=date(2021, 1, 1), categories=wanted)
    _, vectors = embed.embed_categories(spark, repo, encoder, root)
    return vectors.join(repo.papers().select("paper_id", "arxiv_id"), "paper_id").select(
        "category", "arxiv_id", F.col("embedding")[0].cast("long").alias("characters"),
        F.col("embedding")[1].cast("long").alias("blanks"))


def stored_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "embeddings")
    store.write_by_category(_points(spark, sf).withColumnRenamed("vector", "embedding"), path)
    return store.read_by_category(spark, path).select(
        "category", "paper_id", F.size("embedding").alias("dim"),
        r6(F.col("embedding")[0].cast("double")).alias("first"))


def _context(spark: SparkSession, sf: str) -> represent.Context:
    terms = ctfidf.topic_terms(cut(_scores(spark, sf), "scores"))
    texts = testtables.texts(spark, sf)
    encoder = HashingEncoder(256)
    vectors = cut(encoder.encode(texts).select("paper_id", "embedding"), "vectors")
    return represent.Context(texts, testtables.assignments(spark, sf), terms, vectors, encoder, None, STOP_WORDS)


def embedding_keywords(spark: SparkSession, sf: str) -> DataFrame:
    context = _context(spark, sf)
    return represent.run_chain(context, [represent.embedding_keywords()], represent.TOP_WORDS)


def diverse_keywords(spark: SparkSession, sf: str) -> DataFrame:
    context = _context(spark, sf)
    return represent.run_chain(context, [represent.diverse_keywords(top_n=5)])


def keyword_chain(spark: SparkSession, sf: str) -> DataFrame:
    return represent.run_chain(_context(spark, sf), train.default_models())


def _collection(spark: SparkSession, sf: str) -> store.Collection:
    papers = testtables.stored_papers(spark, sf)
    return store.Collection(papers, cut(listing.members(papers, testtables.bridge(spark, sf)), "members"))


def topic_model(spark: SparkSession, sf: str) -> DataFrame:
    """The whole fit, clustering included, on text embeddings; the stored tables are read back."""
    papers = _collection(spark, sf)
    encoder = HashingEncoder(64)
    vectors = papers.members.join(embed.encode_papers(papers.papers, encoder), "paper_id")
    path = scratch_path(spark, "model")
    store.save_tables(train.fit_topics(papers, cut(vectors, "vectors"), encoder, STOP_WORDS), path)
    return store.load_tables(spark, path, train.SCHEMAS)["topic_info"].select("category", "topic", "name", "count")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    terms = cut(_scores(spark, sf), "scores")
    top = ctfidf.top_terms(ctfidf.topic_terms(terms), 10, digits=9).select("category", "topic", "rank", "term", "score")
    model = {"vocabulary": terms, "assignments": testtables.assignments(spark, sf), "keywords": top,
             "representative_docs": _stored_docs(spark, sf)}
    moment = F.lit("2025-09-18 01:02:03").cast("timestamp")
    return trends.write_reports(spark, _collection(spark, sf), model, scratch_path(spark, "reports"),
                                moment, STOP_WORDS)


def trend_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports as written and read back, by what can be told from the JSON itself."""
    shape = ("topics struct<data: map<string, struct<name: string, count: long>>, "
             "correlations: array<array<double>>, series: map<string, array<long>>, "
             "papers: map<string, array<struct<title: string, year: string, arxiv_id: string>>>>, "
             "metadata struct<lastUpdated: string, period: struct<start: string, end: string>>")
    r = _reports(spark, sf).select("category", F.from_json("value", shape).alias("r"))
    counts = F.aggregate(F.flatten(F.map_values("r.topics.series")), F.lit(0).cast("long"), lambda s, n: s + n)
    names = F.array_sort(F.transform(F.map_values("r.topics.data"), lambda t: t["name"]))
    ids = F.array_sort(F.transform(F.flatten(F.map_values("r.topics.papers")), lambda p: p["arxiv_id"]))
    return r.select(
        "category", counts.alias("papers"), F.size(F.map_keys("r.topics.series")).alias("months"),
        F.size("r.topics.correlations").alias("topics"), F.md5(F.concat_ws("|", names)).alias("names"),
        F.md5(F.concat_ws("|", ids)).alias("shown"), F.col("r.metadata.lastUpdated").alias("updated"),
        F.col("r.metadata.period.start").alias("start"), F.col("r.metadata.period.end").alias("end"))


# ---- streams --------------------------------------------------------------------------

def _landed(spark: SparkSession, sf: str) -> str:
    """Two overlapping backfills landed as files."""
    path = scratch_path(spark, "landing")
    raw = testtables.raw_papers(spark, sf)
    for start, end in (FIRST_RUN, SECOND_RUN):
        raw.where(F.to_date("published").between(start, end)).write.mode("append").parquet(path)
    return path


def streamed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "stream")
    stream_ingest.ingest_stream(spark, _landed(spark, sf), f"{root}/store", f"{root}/progress",
                                files_per_batch=1).awaitTermination()
    repo = store.PaperStore(spark, f"{root}/store")
    return repo.papers().join(repo.bridge(), "paper_id").select("arxiv_id", "published", "category")


def streamed_keywords(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "stream")
    stream_keywords.keyword_stream(spark, _landed(spark, sf), f"{root}/counts", f"{root}/progress",
                                   STOP_WORDS, files_per_batch=1).awaitTermination()
    return stream_keywords.read_counts(spark, f"{root}/counts").groupBy("token", "category").agg(
        F.sum("title_count").alias("title_count"), F.sum("abstract_count").alias("abstract_count"),
        F.sum("count").alias("count"))


REGISTERED: list[Callable[[SparkSession, str], DataFrame]] = [
    record_projection, day_window_scan, newest_first_scan, id_scan, scalar_category, paper_conversion,
    backfill_days, backfill_papers, register_unseen, register_two_runs, category_bridge, list_by_category,
    papers_of_category, papers_any_category, snapshot_by_category, snapshot_one_category, pending_categories,
    category_dimension, categories_with_prefix, keyword_daily_counts, keyword_upsert, keywords_of_month,
    keywords_of_day, input_texts, tokenised_texts, ngram_counts, size_parameters, topic_sizes,
    class_term_totals, document_frequencies, class_tfidf, class_tfidf_papers, topic_keywords, topic_table, keyword_tag_patterns,
    representative_docs, representative_papers, representative_table, topic_distribution, main_topics,
    topic_similarities, topic_correlations, correlation_range, text_topic_correlations, monthly_series,
    monthly_series_labels, monthly_series_orders, period_metadata, document_info, document_shares, deep_slice,
    nearest_neighbours, core_distances, similarity_graph, reduced_vectors, density_clusters, tree_weights, vector_clusters, cluster_sizes,
    soft_membership,
    text_embeddings, category_embeddings, stored_embeddings, embedding_keywords, diverse_keywords, keyword_chain, topic_model,
    trend_reports, streamed_ingest, streamed_keywords,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in REGISTERED}
