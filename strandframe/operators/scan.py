"""Scans in order over a whole table, for groups of any size.

The table is sorted over ranges of its order and written with the number of each
range, so a group that holds much of the table spans many ranges. Windows then
run within ranges, and what a range takes over from those before it comes from a
table with one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.scratch import Scratch


def laid_out(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __part: the number of the range of order that a row is in."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    return Scratch(df.sparkSession, "scan").save(parts, "ranges")


def beside(df: DataFrame, order: list[str], columns: list[str], into: str, ahead: bool = False) -> DataFrame:
    """df (laid_out) with into: a struct of columns of the row before, or ahead, in the whole order; null at the end."""
    row, key = F.struct(*columns), F.struct(*order)
    own = (F.lead if ahead else F.lag)(row).over(Window.partitionBy("__part").orderBy(*order))
    edges = df.groupBy("__part").agg((F.min_by if ahead else F.max_by)(row, key).alias("__edge"))
    # one row for each range
    every = Window.orderBy("__part")
    edges = edges.select("__part", (F.lead if ahead else F.lag)("__edge").over(every).alias("__edge"))
    return df.withColumn(into, own).join(F.broadcast(edges), "__part").withColumn(into, F.coalesce(into, "__edge")).drop("__edge")


def carried(df: DataFrame, order: list[str], value: Column, into: str) -> DataFrame:
    """df (laid_out) with into: the last value that is not null, of this row and all before it in the whole order."""
    df = df.withColumn("__value", value)
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = df.groupBy("__part").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__edge"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("__part", F.last("__edge", ignorenulls=True).over(before).alias("__edge"))
    return df.withColumn(into, own).join(F.broadcast(edges), "__part").withColumn(into, F.coalesce(into, "__edge")).drop("__edge", "__value")
