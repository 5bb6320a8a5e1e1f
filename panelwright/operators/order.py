"""Places in a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.session import cut_lineage


def ordinal(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number the rows from 0 in the given order.

    Rows are sorted by range, once, and kept in the checkpoint folder; the sizes of
    the ranges, one row per partition, give the offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    ranges = placed.groupBy("_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.join(offsets, "_part").withColumn(name, F.col("_id") - F.col("_first") + F.col("_before"))
    return numbered.drop("_part", "_id", "_first", "_before")
