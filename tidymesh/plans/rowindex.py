"""Places of rows in a table of any size, without a single task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymesh.plans.storage import settle


def with_row_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name``: the row's place from 0.

    Rows are dealt by range of the order and numbered within their partition; the numbers of rows in the partitions
    before (one row for each partition) are broadcast. Without an order, rows keep the order in which they are read.
    """
    sorted_ = df.orderBy(*order) if order else df
    marked = settle(sorted_.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    met = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + place).alias(name))
