"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier weighs
hashed character n-grams by the log ratio of their shares in the languages
with that bit and in those without, so one pass that counts n-grams by
language trains all bits on every labelled row. A text's mean margin for each
bit, weighted by how seldom the bit errs in training, is compared with all
codewords; the nearest one is the prediction and the gap to the second
says how sure it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mixed, summed, vectors

#: Counters for n-grams, by language.
BUCKETS = 1 << 16
#: Up to so many languages codes are exhaustive; beyond, random and dense with so many bits for each doubling.
EXHAUSTIVE, BITS = 5, 12
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> bytes:
    """Lower-cased letters in UTF-8 with single spaces between and around; empty without a letter."""
    if not text:
        return b""
    out = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(c.isalpha() for c in out[:64]) and not any(c.isalpha() for c in out):
        return b""
    return f" {out} ".encode("utf-8", "surrogatepass")


def gram_buckets(raw: bytes) -> np.ndarray:
    """Counters of all two-, three- and four-byte grams."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = []
    gram = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        gram = gram[:-1] << np.uint64(8) | b[n - 1 :]
        out.append((mixed(gram + np.uint64(n << 40)) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def codewords(k: int) -> np.ndarray:
    """A k x bits matrix of -1 and 1 with distinct rows and columns that split the languages."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        cols = [[1] + [1 if c >> i & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols, float).T
    rng = np.random.default_rng(7)
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(BITS * np.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        least = min((np.abs(code[i] - code[i + 1 :]).sum(1).min() for i in range(k - 1)), default=0)
        if least > gap:
            best, gap = code, least
    return best


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # counters x bits
    trust: np.ndarray  # of each bit, summing to 1

    def margins(self, raw: bytes) -> np.ndarray:
        return np.tanh(self.weights[gram_buckets(raw)].mean(0) * 4)

    def decode(self, raw: bytes) -> tuple[str, float]:
        """The language of the nearest codeword under the weighted loss, and a score: its share of the two nearest's closeness."""
        near = (self.trust * (1 - self.margins(raw) * self.code) / 2).sum(1)
        if len(near) == 1:
            return self.languages[0], 1.0
        first, second = np.argsort(near, kind="stable")[:2]
        return self.languages[first], float(np.clip((near[second] + 1e-9) / (near[first] + near[second] + 2e-9), 0.0, 1.0))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> CodeModel:
    """Learn from every row of ``labelled`` with a text and a language.

    The driver gets one count vector for each language. Bits are trusted by their
    errors on about ``per_language`` texts of each language, all of a rarer one (the bounded sample; the
    texts themselves stay in the executors). Rows without text or language teach nothing; no rows give a model without languages.
    Languages are few enough for the driver to hold a vector of each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["_text"], pdf["_lang"], strict=True):
                own = np.bincount(gram_buckets(letters_only(text)), minlength=BUCKETS + 1)
                own[BUCKETS] = 1  # the last counter is for texts
                if lang in total:
                    total[lang] += own
                else:
                    total[lang] = own.astype(np.int64)
        if total:
            yield vectors(total)

    rows = labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    sums = {k: v for k, v in summed(rows.mapInPandas(count, "key string, vec binary")).items() if v[:BUCKETS].any()}
    found, texts = {k: v[:BUCKETS] for k, v in sums.items()}, {k: int(v[BUCKETS]) for k, v in sums.items()}
    languages = sorted(found)
    code = codewords(len(languages))
    if not languages:
        return CodeModel([], code, np.zeros((BUCKETS, 1)), np.ones(1))
    shares = np.array([(found[k] + 0.5) / (found[k].sum() + 0.5 * BUCKETS) for k in languages])
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits))
    for j in range(bits):
        yes, no = shares[code[:, j] > 0], shares[code[:, j] < 0]
        if len(yes) and len(no):
            weights[:, j] = np.log(yes.mean(0)) - np.log(no.mean(0))
    model = CodeModel(languages, code, weights, np.full(bits, 1 / bits))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen, wrong = shared.value, np.zeros(bits), np.zeros(bits)
        for pdf in batches:
            for text, lang in zip(pdf["_text"], pdf["_lang"], strict=True):
                raw = letters_only(text)
                if raw and lang in m.languages:
                    seen += 1
                    wrong += m.margins(raw) * m.code[m.languages.index(lang)] <= 0
        yield vectors({"seen": seen, "wrong": wrong})

    # of each language every so many-th text by hash, all of a rare one
    part = F.create_map(*(F.lit(x) for k in languages for x in (k, -(-texts[k] // per_language))))[F.col("_lang")]
    held = summed(rows.filter(F.pmod(F.xxhash64("_text"), part) == 0).mapInPandas(errors, "key string, vec binary"), "float64")
    rate = (held["wrong"] + 1) / (held["seen"] + 2) if held else np.full(bits, 0.5)
    trust = np.maximum(np.log((1 - rate) / rate), 0.01)
    model.trust = trust / trust.sum()
    return model


def predict(docs: DataFrame, model: CodeModel, text_col: str = "text", ambiguous_under: float = 0.55, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score and ambiguous of each row.

    Null text, text without a letter and a model without languages give ``und``
    with score 0. Only the text decides; repeated rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            found = [m.decode(raw) if m.languages and (raw := letters_only(t)) else (UNKNOWN, 0.0) for t in pdf["_text"]]
            out = pdf.drop(columns="_text")
            out["lang_pred"], out["score"] = pd.Series([f[0] for f in found], out.index, object), [f[1] for f in found]
            out["ambiguous"] = out["score"] < ambiguous_under
            yield out

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInPandas(guess, schema + ", lang_pred string, score double, ambiguous boolean")
