"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def windows(items: Column, n: int) -> Column:
    """Each run of ``n`` neighbours joined by a space: array<string>. Fewer items than ``n`` give none; null gives null."""

    def joined(v: Column) -> Column:
        count = F.greatest(F.size(v) - n + 1, F.lit(0))
        out = F.slice(v, 1, count)
        for i in range(1, n):
            out = F.zip_with(out, F.slice(v, i + 1, count), lambda a, b: F.concat_ws(" ", a, b))
        return out

    return F.when(items.isNotNull(), let(items, joined))
