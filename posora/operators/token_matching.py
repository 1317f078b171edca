"""Tokens and lines that were expected, held against those that were found, each used once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def consumed_tokens(expected: DataFrame, found: DataFrame, key: list[str], token: str = "token") -> DataFrame:
    """(key, n_expected, n_found, n_matched): how many tokens of two multisets match, each occurrence used once.

    Occurrences are counted for each (key, token) on both sides, and the lesser count matches. A key that
    stands on one side has 0 on the other; null tokens are left out.
    """
    sides = []
    for rows, e in ((expected, 1), (found, 0)):
        counts = rows.filter(F.col(token).isNotNull()).groupBy(*key, token).agg(F.count("*").alias("_n"))
        sides.append(counts.select(*key, token, (F.col("_n") * e).alias("_e"), (F.col("_n") * (1 - e)).alias("_f")))
    each = sides[0].union(sides[1]).groupBy(*key, token).agg(F.sum("_e").alias("_e"), F.sum("_f").alias("_f"))
    return each.groupBy(*key).agg(F.sum("_e").alias("n_expected"), F.sum("_f").alias("n_found"), F.sum(F.least("_e", "_f")).alias("n_matched"))


def _first_unused(expected: list, found: list) -> list[int | None]:
    """For each expected line (its distinct tokens) the first found item, not used yet, that has them all; None: there is none."""
    have = [set(f) for f in found]
    places: dict[str, list[int]] = {}
    for i, own in enumerate(have):
        for t in own:
            places.setdefault(t, []).append(i)
    used, out = set(), []
    for line in expected:
        need = set(line)
        # only items with the line's rarest token can have all of them
        near = min((places.get(t, []) for t in need), key=len, default=range(len(have)))
        hit = next((i for i in near if i not in used and need <= have[i]), None)
        if hit is not None:
            used.add(hit)
        out.append(hit)
    return out


def _assigned(expected: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([_first_unused(e, f) for e, f in zip(expected, found, strict=True)], index=expected.index, dtype=object)


def matched_lines(pages: DataFrame, expected: str, found: str) -> DataFrame:
    """``pages`` with n_lines, n_matched, adjacent and in_order.

    ``expected`` and ``found`` are array<array<string>>: the tokens of each line. An expected line takes the first
    found item that has all its tokens and isn't taken; a line without tokens takes the first that is left. ``adjacent`` counts neighbours
    in the expected order that are both matched, ``in_order`` those whose items stand in the same order. Null arrays are empty.
    """
    none = F.array().cast("array<array<string>>")
    assigned = F.pandas_udf(_assigned, "array<int>")
    taken = pages.withColumn("_at", assigned(F.coalesce(expected, none), F.coalesce(found, none)))
    steps = F.filter(F.zip_with(F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: b - a), lambda d: d.isNotNull())
    return taken.select(
        *pages.columns, F.size("_at").cast("long").alias("n_lines"), F.size(F.filter("_at", lambda a: a.isNotNull())).cast("long").alias("n_matched"),
        F.size(steps).cast("long").alias("adjacent"), F.size(F.filter(steps, lambda d: d > 0)).cast("long").alias("in_order"),
    )


def occurrence_numbers(rows: DataFrame, key: list[str], token: str, order: list[str]) -> DataFrame:
    """``rows`` with ``occurrence``: the how manieth of its token it is in its key, from 1."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key, token).orderBy(*order)).cast("long"))
