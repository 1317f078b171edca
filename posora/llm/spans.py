"""Spans in texts, with DataFrame functions alone.

Arrays and texts can be long. Adding to an array one by one copies it each
time, and ``substring`` walks from the text's start; so both are done in blocks
of about the square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(n: Column) -> Column:
    """The size of a block of n things."""
    return F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What ``step(state, item) -> (state, out)`` puts out for each item, in order: array<``out``>. No items, or null, give none."""
    none, nothing = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def one(acc: Column, x: Column) -> Column:
        after, made = step(acc["s"], x)
        return F.struct(after.alias("s"), F.concat(acc["o"], F.array(made)).alias("o"))

    def blocks(xs: Column) -> Column:
        size = _blocks(F.size(xs))

        def block(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(xs, k * size + 1, size), F.struct(acc["s"].alias("s"), none.alias("o")), one)
            return let(own, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

        last = F.floor((F.size(xs) - 1) / size).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), F.struct(state.alias("s"), nothing.alias("o")), block, lambda acc: F.flatten(acc["o"]))

    return F.when(F.size(items) > 0, let(items, blocks)).otherwise(none)


def outside(spans: Column, length: Column) -> Column:
    """array<struct<start, end>> of what lies before, between and after ``spans`` (sorted by start; they may overlap)."""
    part = "struct<start:int,end:int>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.struct(at.alias("start"), x["start"].cast("int").alias("end"))
        return F.greatest(at, x["end"].cast("int")), F.when(x["start"] >= at, gap)

    gaps = F.filter(scan(spans, F.lit(0), step, part), lambda x: x.isNotNull())
    end = F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"].cast("int"))), F.lit(0))
    return F.concat(gaps, F.array(F.struct(end.alias("start"), length.cast("int").alias("end"))))


def texts(text: Column, spans: Column) -> Column:
    """The text of each span (at least one; sorted and apart), by code point."""

    def cut(v: Column) -> Column:
        size = _blocks(F.size(v["spans"]))
        last = F.floor((F.size(v["spans"]) - 1) / size).cast("int")

        def block(own: Column) -> Column:
            start = own[0]["start"]
            part = F.substring(v["text"], start + 1, F.element_at(own, -1)["end"] - start)
            return let(part, lambda p: F.transform(own, lambda x: F.substring(p, x["start"] - start + 1, x["end"] - x["start"])))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: let(F.slice(v["spans"], k * size + 1, size), block)))

    return let(F.struct(text.alias("text"), spans.alias("spans")), cut)


def replaced(text: Column, spans: Column, mask: str = "") -> Column:
    """``text`` with each span, or run of overlapping ones, replaced by ``mask``."""
    return F.array_join(texts(text, outside(spans, F.length(text))), mask)
