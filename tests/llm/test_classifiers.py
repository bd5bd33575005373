import random
import zlib

from tests.llm.helpers import DOCS, docs, rows
from trendspark.llm import language, learn, quality, toxicity
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def made(seed, n, make):
    random.seed(seed)
    return [make(i) for i in range(n)]


def syllables(parts, n):
    return " ".join("".join(random.choices(parts, k=random.randint(1, 3))) for _ in range(n))


def accuracy(found, truth, name):
    held = [r for r in found.collect() if r.held_out]
    assert all(0 <= r.score <= 1 for r in held)
    return sum(r[name] == truth[r.doc_id] for r in held) / len(held)


def write(spark, folder, texts, labels):
    rows_of = [(i, t, lang, "src0", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows_of, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_toxicity(spark, tmp_path):
    parts = ["ka", "lo", "mi", "ne", "ru", "ta"]

    def make(i):
        text = syllables(parts, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                text[random.randrange(60)] = random.choice(["idiot", "blorp", "vexling"])
        return " ".join(text), "en"

    texts = made(2, 300, make)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(250)] + [(3, None, None), (4, 1, 1)]
    folder = write(spark, tmp_path / "t", texts, labels)
    found = toxicity.op1_toxicity(spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 300
    assert accuracy(found, {i: int(i % 4 == 0) for i in range(300)}, "predicted") > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.collect())


def test_toxicity_without_labels_and_odd_rows(spark):
    none = spark.createDataFrame([], LABELS)
    table = docs(spark, [None, "", "you idiot", "fine words here", "fine words here"]).withColumnRenamed("lang", "score")
    assert toxicity.toxicity_scores(table, none).count() == 5
    assert toxicity.toxicity_scores(docs(spark, []), none).count() == 0
    kept = toxicity.not_toxic(table, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert kept.columns == table.columns


def test_quality(spark, tmp_path):
    parts = ["ka", "lo", "mi", "ne", "ru", "ta"]

    def make(i):
        text = syllables(parts, 80).split()
        if i % 3 == 0:
            text = [[w.upper() + "!!" for w in text], [w + random.choice(["%%%", "###"]) for w in text],
                    [w for w in text[:10] for _ in range(8)]][i // 3 % 3]
        return " ".join(text), "en"

    texts = made(3, 300, make)
    labels = [(i, int(i % 3 != 0), 0) for i in range(240)] + [(7, None, 0)]
    found = quality.op9_quality(spark, write(spark, tmp_path / "q", texts, labels))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert accuracy(found, {i: int(i % 3 != 0) for i in range(300)}, "predicted") > 0.93


def test_quality_without_labels_and_odd_rows(spark):
    none = spark.createDataFrame([], LABELS)
    found = quality.quality_scores(docs(spark, [None, "", "a", "a"]), none)
    assert rows(found, "score") == [(0.5,)] * 4
    assert quality.quality_scores(docs(spark, []), none).count() == 0


def test_language(spark, tmp_path):
    kinds = {"xx": ["ka", "lo", "mi"], "yy": ["ße", "ün", "ort"], "zz": ["qui", "eau", "çe"]}

    def make(i):
        lang = list(kinds)[i % 3]
        return syllables(kinds[lang], 30), lang if i % 10 else None

    texts = made(4, 240, make) + [(None, "xx"), ("12 ?!", "yy"), ("", "zz")]
    found = language.op3_language(spark, write(spark, tmp_path / "l", texts, [(0, 1, 0)]))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (240, 241, 242))
    assert sum(by_id[i].lang_pred == list(kinds)[i % 3] for i in range(240)) > 230
    nothing = docs(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))
    assert rows(language.languages_of(nothing), "lang_pred") == [("und",), ("und",)]
    assert language.languages_of(docs(spark, [])).count() == 0


def test_sample_is_bounded(spark):
    table = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).alias("c"))
    chosen, counts = learn.per_class_sample(table, "c", 200)
    assert counts == {True: 1000, False: 3000}
    sizes = {r.c: r["count"] for r in chosen.groupBy("c").count().collect()}
    assert all(120 < n < 290 for n in sizes.values())
