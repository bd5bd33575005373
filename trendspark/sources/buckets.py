"""Tables bucketed by a key, so that joins and groups by the key leave their rows in place.

A bucketed table is an external table of the session's catalog over a folder. Spark sees
the buckets as a hash partitioning by the key: the other side of a join is sent to them, and
long columns (titles, abstracts) of the bucketed side never pass an exchange. That holds
where the table has at least as many buckets as ``spark.sql.shuffle.partitions``; with fewer
Spark prefers more tasks and shuffles both sides.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table_name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def append(rows: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Adds rows to the table at ``path``, one file for each bucket that gets any; returns the table."""
    spark, name = rows.sparkSession, table_name(path)
    attach(spark, path, rows.schema, key, buckets)
    (rows.repartition(buckets, key).write.format("parquet").mode("append").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return attach(spark, path, rows.schema, key, buckets)


def attach(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table at ``path`` as an earlier session wrote it, or an empty one to add to."""
    name = table_name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"create table if not exists {name} ({columns}) using parquet "
              f"clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    spark.catalog.refreshTable(name)  # another session of this application may have added files
    return spark.table(name)
