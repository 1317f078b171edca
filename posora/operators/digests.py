"""A digest of an ordered table that many tasks can work on.

Rows fall into ranges of their key. A range's digest is that of its rows as
lines in order; FAN neighbouring digests are digested together, level by level,
until one is left. The result depends on rows and ranges alone, not on how they
are dealt, and two digests of tables tell by their ranges where the tables differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digests that one digest of the next level covers, as bits of the range's number.
FAN_BITS = 4
#: What stands for null, between fields, and between lines.
NULL, FIELD, LINE = "\\N", "\x1f", "\n"


def line_of(*fields: Column | str) -> Column:
    """One text of several fields, unambiguous: separators inside fields are escaped, nulls differ from texts."""

    def text(c: Column | str) -> Column:
        v = (F.col(c) if isinstance(c, str) else c).cast("string")
        for i, mark in enumerate(("\\", FIELD, LINE)):
            v = F.replace(v, F.lit(mark), F.lit("\\" + "\\fl"[i]))
        return F.coalesce(v, F.lit(NULL))

    return F.concat_ws(FIELD, *(text(f) for f in fields))


def range_digests(rows: DataFrame, key: list[str], span: Column, line: Column) -> DataFrame:
    """(span, n, digest) of each range: rows ordered by ``key``, then by line. The rows of one range are sorted in one place, so ``span`` must bound them."""
    inner = F.array_sort(F.collect_list(F.struct(*key, F.col("_line"))))
    lines = F.transform("_rows", lambda r: r["_line"])
    each = rows.select(*key, span.cast("long").alias("span"), line.alias("_line")).groupBy("span").agg(inner.alias("_rows"), F.count("*").alias("n"))
    return each.select("span", "n", F.sha2(F.array_join(lines, LINE), 256).alias("digest"))


def range_digests_streamed(rows: DataFrame, key: list[str], span: Column, line: Column) -> DataFrame:
    """The same by another way: sorted partitions are streamed, a range of any size takes constant memory."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, sha, out = None, 0, None, []
        for pdf in batches:
            for span_, text in zip(pdf["span"], pdf["_line"], strict=True):
                if sha is None or span_ != at:
                    if sha is not None:
                        out.append((at, n, sha.hexdigest()))
                    at, n, sha = span_, 0, hashlib.sha256()
                sha.update((LINE if n else "").encode() + text.encode("utf-8", "surrogatepass"))
                n += 1
            if out:
                yield pd.DataFrame(out, columns=["span", "n", "digest"])
                out = []
        if sha is not None:
            yield pd.DataFrame([(at, n, sha.hexdigest())], columns=["span", "n", "digest"])

    dealt = rows.select(*key, span.cast("long").alias("span"), line.alias("_line")).repartition("span").sortWithinPartitions("span", *key, "_line")
    return dealt.mapInPandas(stream, "span long, n long, digest string")


def merkle_root(ranges: DataFrame, levels: int) -> DataFrame:
    """(n, digest): one row for all ranges (none for no ranges). ``levels`` must take their numbers, from 0 up, to 0: 2^(FAN_BITS * levels) ranges."""
    level = ranges.select("span", "n", "digest")
    for _ in range(levels):
        up = level.groupBy(F.shiftright("span", FAN_BITS).alias("span")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("span", "digest"))).alias("_d"))
        level = up.select("span", "n", F.sha2(F.array_join(F.transform("_d", lambda d: d["digest"]), LINE), 256).alias("digest"))
    return level.select(F.when(F.col("span") == 0, F.col("n")).otherwise(F.raise_error("more ranges than the levels take")).cast("long").alias("n"), "digest")


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(span, n_a, n_b) of the ranges whose digests differ; a missing range has null rows."""
    x, y = (d.select("span", F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"d_{s}")) for d, s in ((a, "a"), (b, "b")))
    return x.join(y, "span", "full").filter(~F.col("d_a").eqNullSafe(F.col("d_b"))).select("span", "n_a", "n_b")
