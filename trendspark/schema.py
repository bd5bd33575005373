"""Table schemas and the constants shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_PAPERS = T.StructType([
    T.StructField("entry_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("published", T.TimestampType()),
    T.StructField("updated", T.TimestampType()),
    T.StructField("pdf_url", T.StringType()),
])

PAPERS = T.StructType([
    T.StructField("paper_id", T.LongType()),
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("published", T.DateType()),
])

PAPER_CATEGORIES = T.StructType([
    T.StructField("paper_id", T.LongType()),
    T.StructField("category", T.StringType()),
])

KEYWORDS = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("published", T.DateType()),
    T.StructField("title_count", T.LongType()),
    T.StructField("abstract_count", T.LongType()),
    T.StructField("count", T.LongType()),
])

OUTLIER = -1
DATA_VERSION = "0.0.2"
