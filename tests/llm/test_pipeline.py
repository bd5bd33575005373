import corpus_pipeline
from tests.llm.helpers import DOCS
from trendspark.llm import registry


def test_stages_take_effect(spark, tmp_path):
    long = " ".join(f"wort{i}" for i in range(80))
    texts = [long, long, long + " extra", "idiot moron scum loser stupid pathetic " * 3,
             "clean text about nothing in particular", "start " + " ".join(f"item{i}" for i in range(12)) + " end", None]
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1), (4, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"item{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.collect()})
    assert left == [{0, 1, 2, 4, 5, 6}, {1, 2, 4, 5, 6}, {1, 4, 5, 6}, {1, 4, 6}]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 4, 6}


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
