"""Shards of near-equal bytes over key ranges with sampled splitters.

Keys are (hash of the text, id), so equal texts stand side by side and one
large group of them still has many keys. A size-weighted sample of bounded
size gives quantile boundaries; rows are dealt into ranges, ranges that hold
too much are sampled and subdivided again, and the exact sizes of all ranges
place every row. So shard sizes don't depend on luck in sampling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Sampled keys for each range.
OVERSAMPLE = 8


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int = 1024, id_col: str = "doc_id", text_col: str = "text", together: float = 0.002, scratch: Scratch | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    Shard sizes in bytes differ from equal by less than one row, or by less
    than a group of equal texts that takes at most the share ``together`` of a
    shard: such a group isn't divided. A group that lies in several ranges is judged by its part in
    each. Ranges that are overfull after four subdivisions stay so; shards are even all the same. ``slot`` counts a shard's rows from 0.
    Null text counts one byte; null ids come first among equal texts; an empty
    table gives no rows. At most ``ranges`` * OVERSAMPLE keys go to the driver.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
            F.coalesce(F.xxhash64(id_col), F.lit(0).cast("long")).alias("_sub"),
        )
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = int(min(ranges, max(16, n // 2000)))

    def sample(df: DataFrame, m: int) -> list[tuple[int, int]]:
        """A weighted sample without replacement: the m least of exponential draws over size."""
        draw = -F.log((F.pmod(F.xxhash64("_key", "_sub", F.lit(m)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)) / F.col("size")
        return sorted((r["_key"], r["_sub"]) for r in df.select("_key", "_sub", draw.alias("draw")).orderBy("draw", "_key", "_sub").limit(m).collect())

    def quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
        """Boundaries between parts; a text is divided only where the sample shows it to be heavy."""
        picked = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
        seen = pd.Series([k for k, _ in keys]).value_counts().to_dict()
        return sorted({(k, s) if seen[k] >= 4 else (k, -(1 << 63)) for k, s in picked})

    def ranged(df: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
        keys, subs = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)

        @F.pandas_udf("int")
        def at(key: pd.Series, sub: pd.Series) -> pd.Series:
            k, s = key.to_numpy(), sub.to_numpy()
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for i in np.flatnonzero(lo < hi):
                lo[i] += np.searchsorted(subs[lo[i] : hi[i]], s[i], "right")
            return pd.Series(lo, dtype="int32")

        return df.withColumn("_range", at("_key", "_sub") if bounds else F.lit(0))

    bounds = quantiles(sample(rows, ranges * OVERSAMPLE), ranges)
    for _ in range(4):
        sums = {r["_range"]: (r["bytes"], r["n"]) for r in ranged(rows, bounds).groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = sorted(r for r, (b, k) in sums.items() if k > 1 and b > 4 * total / ranges)
        if not over:
            break
        more = quantiles(sample(ranged(rows, bounds).filter(F.col("_range").isin(over)), ranges * OVERSAMPLE), 4 * len(over))
        merged = sorted({*bounds, *more})
        if merged == bounds:
            break
        bounds = merged
    else:
        sums = {r["_range"]: (r["bytes"], r["n"]) for r in ranged(rows, bounds).groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    starts, at_bytes, at_rows = [], 0, 0
    for r in sorted(sums):
        starts.append((r, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + sums[r][0], at_rows + sums[r][1]
    offsets = docs.sparkSession.createDataFrame(starts, "_range int, _bytes long, _rows long")  # at most the ranges
    order = Window.partitionBy("_range").orderBy("_key", "_sub", "_id")
    own = Window.partitionBy("_range", "_key")
    placed = (
        ranged(rows, bounds)
        .join(F.broadcast(offsets), "_range")
        .withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_bytes"))
        .withColumn("_at", F.row_number().over(order) - 1 + F.col("_rows"))
        .withColumn("_group", F.sum("size").over(own))
        .withColumn("_first", F.min(F.col("_end") - F.col("size")).over(own))
    )
    begins = F.when(F.col("_group") <= together * total / shards, F.col("_first")).otherwise(F.col("_end") - F.col("size"))
    placed = scratch.save(placed.select("_id", "size", "text_crc32", "_at", F.least(F.lit(shards - 1), F.floor(begins * shards / total)).cast("int").alias("shard")))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").cast(kind).alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
