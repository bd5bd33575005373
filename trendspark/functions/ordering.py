"""Global row numbers and slices without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.scratch import cut

ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in the low 33 bits
TOP_K_ROWS = 100_000


def with_row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Number rows 0.. in a total order.

    A range sort spreads the rows; each numbers itself within its partition and adds the
    rows of the partitions before it. The offsets table has one row per partition. The
    sorted rows are written once, so numbering and offsets see the same partitions.
    """
    placed = df.sort(*order).withColumns({
        "_part": F.spark_partition_id(),
        "_seq": F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1),
    })
    placed = cut(placed, "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_seq"))
            .drop("_part", "_seq", "_before"))


def slice_rows(df: DataFrame, order: list[Column], offset: int | None = None,
               limit: int | None = None) -> DataFrame:
    """Rows offset .. offset+limit in a total order.

    A bounded slice is a distributed top-k. An open or very deep one would funnel through
    one task, so it goes through numbered rows instead. Either way the rows come sorted.
    """
    start = offset or 0
    if limit is None and start == 0:
        return df.sort(*order)
    if limit is not None and start + limit <= TOP_K_ROWS:
        return df.sort(*order).offset(start).limit(limit) if start else df.sort(*order).limit(limit)
    index = F.col("_slice_index")
    wanted = index >= start
    if limit is not None:
        wanted = wanted & (index < start + limit)
    return with_row_index(df, order, "_slice_index").where(wanted).sort("_slice_index").drop("_slice_index")
