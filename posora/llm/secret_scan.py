"""Secrets in texts, with DataFrame functions alone.

Three kinds have fixed patterns. A fourth, ``entropy``, takes every run of 20 or
more characters of the base64 alphabets and slides a window over it. A counter
for each character and the sum of c * log2(c) over them go along: the character
that enters and the one that leaves change one counter and one term each, so a
step costs the same wherever it is. A run whose best window reaches its
character class's threshold is a span. The allow-list suppresses what it names:
words and repetitions end a window's run, numbers and plain words have none.
Offsets are code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import packed
from .spans import let, replaced, scan

# The base patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
# Candidates, and what is no secret however even its characters.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Thresholds in bits for a window, by character class; the greatest possible is log2 of the window.
HEX_BITS, MIXED_BITS = 3.0, 3.6
#: Whole stretches that are no secrets.
ALLOWED = (
    "^[0-9_+/=-]+$",  # numbers, rules, separators
    "^[A-Za-z_+/=-]+$",  # words without a digit
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: What is no part of a secret: windows stand before or after it.
BETWEEN = r"(?i:example|sample|placeholder|dummy|changeme)|(.)\1{5,}"
#: Characters of a long run that are taken at a time.
CHUNK = 4096
_SPAN = "struct<start:int,end:int,text:string>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches, left to right, from the matches and the texts between them."""
    parts = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), lambda x: x["hit"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text"))

    return F.when(text.rlike(pattern), scan(parts, F.lit(0), step, _SPAN)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _weights(width: int) -> Column:
    """How c * log2(c) grows from c to c + 1, for c = 0, 1, ..."""
    terms = [c * math.log2(c) if c else 0.0 for c in range(width + 2)]
    return F.array(*(F.lit(b - a) for a, b in zip(terms, terms[1:], strict=False)))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of a window of ``width`` characters of ``s`` (printable ASCII)."""
    grows = _weights(width)

    def at(c: Column) -> Column:
        return F.ascii(c) - 31

    def count(counters: Column, c: Column) -> Column:
        return F.ascii(F.substring(counters, at(c), F.lit(1))) - 32

    def put(counters: Column, c: Column, n: Column) -> Column:
        return F.overlay(counters, F.char(n + 32), at(c), F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        goes = x["old"] != ""

        def left(n: Column) -> Column:  # n: how often the character that leaves is there
            rest = F.struct(
                F.when(goes, put(acc["counters"], x["old"], n - 1)).otherwise(acc["counters"]).alias("counters"),
                F.when(goes, acc["sum"] - grows[n - 1]).otherwise(acc["sum"]).alias("sum"),
            )
            return let(rest, lambda r: let(count(r["counters"], x["new"]), lambda m: entered(r, m)))

        def entered(r: Column, m: Column) -> Column:
            total = r["sum"] + grows[m]
            return F.struct(
                put(r["counters"], x["new"], m + 1).alias("counters"), total.alias("sum"), (acc["n"] + 1).alias("n"),
                F.when(acc["n"] >= width - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"),
            )

        return let(F.when(goes, count(acc["counters"], x["old"])).otherwise(F.lit(1)), left)

    def best(chars: Column) -> Column:
        old = F.concat(F.array_repeat(F.lit(""), width), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - width, F.lit(0))))
        steps = F.arrays_zip(chars.alias("new"), F.slice(old, F.lit(1), F.size(chars)).alias("old"))
        start = F.struct(F.lit(" " * 96).alias("counters"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(1e18).alias("least"))
        return F.aggregate(steps, start, step, lambda acc: F.log2(F.lit(float(width))) - acc["least"] / width)

    def one(x: Column) -> Column:
        return let(F.split(x, ""), best)

    def chunks(parts: Column) -> Column:
        """Parts of a long run, each with the characters that its last windows need of the next."""
        lapped = F.transform(parts, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, width - 1)))
        return F.array_max(F.transform(F.filter(lapped, lambda x: F.length(x) >= width), one))

    return F.when(F.length(s) <= CHUNK, one(s)).otherwise(let(F.regexp_extract_all(s, F.lit(f".{{1,{CHUNK}}}"), F.lit(0)), chunks))


def is_secret_like(s: Column) -> Column:
    """Whether a stretch of the run ``s`` that the allow-list doesn't name has a window of high entropy for its class."""

    def high(x: Column) -> Column:
        allowed = reduce(lambda a, b: a | b, (x.rlike(p) for p in ALLOWED))
        bits = F.when(x.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
        return (F.length(x) >= WINDOW) & ~allowed & (window_entropy(x) >= bits)

    return F.exists(F.split(s, BETWEEN, -1), high)


def secret_spans(text: Column) -> Column:
    """array<struct<start, kind_order, end, kind>> of a text's secrets, by start, then kind. Null and empty text have none."""
    text = F.coalesce(text, F.lit(""))
    long_run = text.rlike("[A-Za-z0-9+/_=-]{20,}")
    none = F.array().cast(f"array<{_SPAN}>")

    def kinds(spans: Column, order: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind_order"), x["end"].alias("end"), F.lit(KINDS[order]).alias("kind")))

    assigned = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= ASSIGN_VALUE)
    guarded = [F.when(long_run, found(text, p)).otherwise(none) for p in (ACCESS, HEX, CANDIDATE)]
    odd = F.filter(guarded[2], lambda x: is_secret_like(x["text"]))
    return F.array_sort(F.concat(kinds(assigned, 0), kinds(guarded[0], 1), kinds(guarded[1], 2), kinds(odd, 3)))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of each row.

    Rows are scanned one by one: null and empty text have no spans, repeated rows and null ids
    are kept, an empty table gives no rows. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), secret_spans(F.col(text_col)).alias("found"))
    base = F.filter("found", lambda x: x["kind_order"] < 3)

    def number(kind: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind_order"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(k) for k in range(len(KINDS))]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret, or run of overlapping ones, replaced by ``mask``.

    Null and empty texts and all other columns, whatever their names, stay as they are; repeated rows are
    masked alike; an empty table gives no rows.
    """
    text = F.col(f"doc.`{text_col}`")
    rows = packed(docs).withColumn("found", secret_spans(text))
    clean = F.when(F.size("found") > 0, replaced(text, F.col("found"), mask)).otherwise(text)
    return rows.select(F.col("doc").withField(f"`{text_col}`", clean).alias("doc")).select("doc.*")
