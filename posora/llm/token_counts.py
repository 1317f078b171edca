"""Token counts at every prefix of a text, for a byte-level BPE with word ends.

``prefix_counts`` stores one signed byte for each code point: by how much the
token count of the prefix grows there (16 bits each in the rare text where a
step does not fit, marked in ``step_bytes``). The running sum at i is the exact
number of tokens of ``text[:i]``, so truncation and budget questions are
answered from the stored bytes.

Prefixes of a text are taken as texts of their own: a prefix that ends within a
word counts that part as a word. Special strings count as one token once they
are complete. Null text is empty, with no prefixes. Prefix offsets are code
points of the text as given.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, PrefixEncoder

#: Fixed values of the vocabulary's pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: The same for lower-case text of ASCII and accented Latin letters alone, with and without white space.
PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff \t-\r]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Texts to ids and to prefix counts; what words give is remembered up to a bound."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["model"]["merges"])}
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.encoder = PrefixEncoder(vocab, ranks, model["model"]["end_of_word_suffix"])
        self.words, self.plain_words, self.plain_all = regex.compile(WORD_PATTERN), re.compile(PLAIN_WORDS), re.compile(PLAIN_WORDS + r"|[ \t-\r]+")
        self.letters = byte_alphabet()
        self.id_bytes, self.steps = Memo(self._ids, limit), Memo(self._steps, limit)

    def _symbols(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))

    def _ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(self._symbols(word))]).tobytes()

    def _counts(self, word: str) -> tuple[int, ...]:
        """Token counts of the word's prefixes, by code point."""
        if word in ("'re", "'ve", "'ll"):  # the second character alone is a word of its own
            return (1, self._counts("'")[0] + self._counts(word[1])[0], self.encoder.counts(word)[2])
        counts = self.encoder.counts(self._symbols(word))
        if len(counts) != len(word):
            ends = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)
            counts = tuple(counts[i - 1] for i in ends)
        return counts

    def _steps(self, word: str) -> bytes | np.ndarray:
        """Signed change of the count at each code point; an array where one needs 16 bits."""
        if word[0] in " \t\n\r\x0b\x0c":
            return bytes(len(word))
        counts = self._counts(word)
        if len(counts) < 127:
            return bytes(b - a & 255 for a, b in zip((0, *counts), counts, strict=False))
        steps = np.diff(np.array(counts, np.int64), prepend=0)
        return steps.astype(np.int8).tobytes() if (steps == steps.astype(np.int8)).all() else steps.astype("<i2")

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text)

    def _parts(self, text: str) -> list[str]:
        return self.special.split(text) if "<|" in text else [text]

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit values."""
        if not text:
            return b""
        out = []
        for part in self._parts(text):
            if part in self.specials:
                out.append(array("I", [self.specials[part]]).tobytes())
            else:
                found = self.plain_words.findall(part.lower()) if PLAIN.match(part) else self.words.findall(self._normal(part))
                out += map(self.id_bytes.__getitem__, found)
        return b"".join(out)

    def prefix_steps(self, text: str | None) -> tuple[bytes, int]:
        """The change of the count at each code point, and the bytes that each takes."""
        if not text:
            return b"", 1
        if "<|" not in text and PLAIN.match(text):
            found = list(map(self.steps.__getitem__, self.plain_all.findall(text.lower())))
            try:
                return b"".join(found), 1
            except TypeError:
                wide = [x if isinstance(x, np.ndarray) else np.frombuffer(x, np.int8) for x in found]
                return np.concatenate(wide).astype("<i2").tobytes(), 2
        steps = np.diff(np.array(self._all_counts(text), np.int64), prepend=0)
        kind = "i1" if (steps == steps.astype(np.int8)).all() else "<i2"
        return steps.astype(kind).tobytes(), np.dtype(kind).itemsize

    def _all_counts(self, text: str) -> list[int]:
        """Prefix counts by code point of any text, special strings included."""
        counts: list[int] = []
        total, held = 0, ""
        for part in self._parts(text):
            if part in self.specials:
                before = self._part_counts(held)[-1] if held else 0
                inside = self._part_counts(held + part)[len(held) :]
                counts += [total - before + c for c in inside[:-1]] + [total + 1]
                total, held = total + 1, ""
            elif part:
                own = self._part_counts(part)
                counts += [total + c for c in own]
                total, held = total + own[-1], part
        return counts

    def _part_counts(self, part: str) -> list[int]:
        """Prefix counts of text without special strings. Where normalising moves code points the
        text between two white spaces is counted prefix by prefix."""
        counts: list[int] = []
        before = 0
        for piece in regex.findall(r"\p{White_Space}+|\P{White_Space}+", part):
            if regex.match(r"\p{White_Space}", piece):
                counts += [before] * len(piece)
                continue
            normal = piece.lower() if PLAIN.match(piece) else self._normal(piece)
            if len(normal) == len(piece) and all(c < "\x7f" or self._stays(c) for c in piece):
                own, at = [], 0
                for m in self.words.finditer(normal):
                    own += [at + c for c in self._counts(m[0])]
                    at = own[-1]
            else:
                own = [sum(self._counts(w)[-1] for w in self.words.findall(self._normal(piece[:i]))) for i in range(1, len(piece) + 1)]
            counts += [before + c for c in own]
            before = counts[-1]
        return counts

    def _stays(self, c: str) -> bool:
        """Whether a code point normalises to one by itself and doesn't join with the one before."""
        return len(self._normal(c)) == 1 and unicodedata.combining(c) == 0 and not "\u1160" <= c <= "\u11ff"


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder for each Python worker and vocabulary."""
    return WordBpe(path)


def counts_of(steps: bytes, step_bytes: int) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... code points."""
    return np.cumsum(np.frombuffer(steps, "i1" if step_bytes == 1 else "<i2"), dtype=np.int64)


def longest_prefix(steps: bytes, step_bytes: int, budget: int) -> int:
    """The most code points of a prefix that takes at most ``budget`` tokens."""
    within = np.flatnonzero(counts_of(steps, step_bytes) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_steps, step_bytes, fit_chars) of each row of ``docs``.

    ``fit_chars`` is the longest prefix within ``budget`` tokens. Rows with
    null ids or equal rows are kept as they are; an empty table gives none.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            found = [enc.prefix_steps(t) for t in pdf["_text"]]
            totals = [int(np.frombuffer(s, "i1" if k == 1 else "<i2").sum(dtype=np.int64)) for s, k in found]
            fit = [longest_prefix(s, k, budget) if n > budget else len(s) // k for (s, k), n in zip(found, totals, strict=True)]
            yield pd.DataFrame({"_id": pdf["_id"], "n_bytes": pdf["n_bytes"], "n_tokens": totals, "prefix_steps": [s for s, _ in found], "step_bytes": [k for _, k in found], "fit_chars": fit})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(count, f"_id {kind}, n_bytes long, n_tokens long, prefix_steps binary, step_bytes int, fit_chars long").withColumnRenamed("_id", id_col)
