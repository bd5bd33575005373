"""Small tables for the corpus operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, texts, first=0):
    """Documents of the given texts, ids from ``first`` on."""
    return spark.createDataFrame(
        [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
