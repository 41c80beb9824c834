"""Positions in an order over whole tables, without a window of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources import tables


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``number``, from 0 without gaps in the order of ``keys`` (nulls
    first; rows equal in all keys are numbered as they come).

    Rows are dealt by ranges of the keys and written to the shared folder with their
    place in the part, so that a lost executor can't deal them anew; a part's offset is
    the sum of the rows in the parts before it, of which there are as many as shuffle
    partitions. The result's ``path`` is for the caller to delete."""
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = tables.written(dealt.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)).withColumn("_in", F.col("_place").bitwiseAND((1 << 33) - 1)), "order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = rows.join(parts, "_part").select(*df.columns, (F.col("before") + F.col("_in")).alias("number"))
    out.path = rows.path
    return out
