"""Lines of text files with their numbers, read in parallel.

A file is read in blocks by many tasks. Numbers are exact all the same: each block's
lines are counted, the counts of a file are summed in the order of its blocks, and a
line's number is its place in its block plus that sum. Only the counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, source_row, line) of every line that isn't blank; blank lines count in source_row, which starts at 1."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("place"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = lines.join(starts, ["file", "block"]).withColumn("source_row", F.col("place") - F.col("first") + F.col("before") + 1)
    return numbered.filter(F.col("line").rlike(r"\S")).select("file", "source_row", "line")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The fields of `schema` of every line, with file and source_row; a line that isn't JSON fails the read."""
    parsed = numbered_lines(spark, path).withColumn("record", F.from_json("line", schema, {"mode": "FAILFAST"}))
    return parsed.select("file", "source_row", "record.*")
