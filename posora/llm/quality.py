"""Quality rules: repetition and length rules, and a hashed n-gram likelihood ratio.

The corpus statistics are two multinomials over hashed n-grams, here character
trigrams within and across words: one of all documents and one of a trusted target. A document's score is
its mean log ratio of target to corpus over its grams; every document is held
against the same fixed threshold. Both statistics cover all their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, mixed, packed, summed, vectors

#: Counters for grams; the statistics are two vectors of this length whatever the input.
BUCKETS = 1 << 16
#: A document whose mean log ratio is under this is rejected.
THRESHOLD = -0.5
#: Added to each counter, as a share of the mean counter.
SMOOTHING = 0.1

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SHAPE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def word_runs(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def gram_buckets(text: str | None) -> np.ndarray:
    """The counters of a text's grams: character trigrams within and across words, letters lower-cased and digits alike."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_SHAPE).split()) + b" ", np.uint8).astype(np.uint64)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    gram = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]
    return (mixed(gram + np.uint64(1)) >> np.uint64(48)).astype(np.int64)


def counted(docs: DataFrame, text_col: str = "text", trusted_col: str | None = None) -> dict[str, np.ndarray]:
    """Gram counts of all rows (``raw``) and of those with a true ``trusted_col`` (``target``)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {"raw": np.zeros(BUCKETS, np.int64), "target": np.zeros(BUCKETS, np.int64)}
        for pdf in batches:
            for text, trusted in zip(pdf["_text"], pdf["_trusted"], strict=True):
                own = np.bincount(gram_buckets(text), minlength=BUCKETS)
                total["raw"] += own
                if trusted:
                    total["target"] += own
        yield vectors(total)

    trusted = F.coalesce(F.col(trusted_col), F.lit(False)) if trusted_col else F.lit(False)
    rows = docs.select(F.col(text_col).alias("_text"), trusted.alias("_trusted"))
    found = summed(rows.mapInPandas(count, "key string, vec binary"))
    zero = np.zeros(BUCKETS, np.int64)
    return {k: found.get(k, zero) for k in ("raw", "target")}


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target share / corpus share) of each counter, smoothed; zeros when either is empty."""
    if not raw.sum() or not target.sum():
        return np.zeros(BUCKETS, np.float64)
    share = [(v + SMOOTHING * v.sum() / BUCKETS) / (v.sum() * (1 + SMOOTHING)) for v in (raw, target)]
    return np.log(share[1]) - np.log(share[0])


def rules(text: str | None, known: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; zeros for null."""
    words = word_runs(text)
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOLS.findall(text or "")), 0, 0
    joined = b"".join(words)
    chars = len(joined) if text.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [line for line in text.split("\n") if word_runs(line)] if "\n" in text else [text]
    repeats = 0
    if n >= 3:
        h = known.of(words)
        p = np.uint64(0x9E3779B97F4A7C15)
        _, which, counts = np.unique(mixed((h[:-2] * p + h[1:-1]) * p + h[2:]), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[which] > 1)
        if len(twice):
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[twice + k] = True
            repeats = int(covered.sum())
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, verdict) of each row: all its columns, and struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept>.

    ``trusted`` has the ids of the trusted target in its column ``id_col``.
    Rows are judged one by one: null text has no words and fails, repeated rows
    get equal verdicts, null ids are judged but never trusted. With no trusted
    text every score is 0. Other columns don't leave the JVM and may have any name.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(True))
    # One shuffle of the texts at every size: ids grow with the labels, so they are never broadcast.
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_words")).join(ids.hint("merge"), "_id", "left")
    stats = counted(marked, "_words", "_trusted")
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(stats["raw"], stats["target"]))  # BUCKETS doubles

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, weight = WordHashes(), ratio.value
        for texts in batches:
            out = pd.DataFrame([rules(t, known) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            out["score"] = [float(weight[b].mean()) if len(b := gram_buckets(t)) else 0.0 for t in texts]
            out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
            yield out

    return packed(docs).withColumn("verdict", judge(F.col(f"doc.`{text_col}`")))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, and the fields of the verdict) of each row; see ``judged``."""
    rows = judged(docs.select(F.col(id_col), F.col(text_col)), trusted, id_col, text_col, threshold)
    return rows.select(F.col(f"doc.`{id_col}`").alias(id_col), "verdict.*")
