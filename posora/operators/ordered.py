"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posora.scratch import Scratch

#: Rows of a task where keys are dealt by the size of the table.
A_TASK = 1 << 20


def dealt(rows: DataFrame, *keys: str, a_task: int = A_TASK) -> DataFrame:
    """``rows`` dealt by ``keys`` to so many partitions that each has about ``a_task`` rows.

    A table that needs no more partitions than the session's shuffles have stays as it is. What follows by the same
    keys keeps the partitions, so what a task sorts doesn't grow with the table.
    """
    wanted = -(-rows.count() // a_task)
    return rows.repartition(wanted, *keys) if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered(rows: DataFrame, order: list[Column], name: str = "place", scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``name``: their place in the order, from 1 without gaps.

    Rows are range-partitioned by the order and sorted in their ranges; a row's place is its place in its range after the
    rows of the ranges before, of which the driver knows nothing but a table of one row a range. Rows that are equal in
    the order stand in any order, but each place is given once. No rows give none.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    dealt = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at.alias("_at")))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") - F.shiftleft("_range", 33) + F.col("_start") + 1).drop("_at", "_range", "_start")


def dictionary(columns: list[tuple[DataFrame, str]], scratch: Scratch | None = None) -> DataFrame:
    """(value, id) of the distinct values of all columns; ids follow the values' order, from 1. Nulls have no id."""
    values = None
    for df, c in columns:
        own = df.select(F.col(c).alias("value"))
        values = own if values is None else values.union(own)
    return numbered(values.filter("value IS NOT NULL").distinct(), [F.col("value")], "id", scratch)
