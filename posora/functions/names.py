"""Names and keys: the scalar normalisers that identities and links are built on.

Everything stays in Spark's own expressions but for NFKC and case folding, which
Spark lacks; those run once a batch in an Arrow function. Null in, null out.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Codes of one substance, and words that a salt or form adds to a name's end.
EQUIVALENT_CODES = {
    "D001289": "D000274",
    "D000195": "D000982",
    "D000983": "D000309",
    "D000904": "D000719",
}
SUFFIX_PHRASES = ["extended-release granules", "enteric-coated granules", "dried sodium carbonate", "solid dispersions"]
SUFFIX_WORDS = [
    "hydrochloride", "hydrobromide", "oxalate", "succinate", "tartrate", "mesylate", "sulfate", "citrate", "fumarate",
    "maleate", "acetate", "propionate", "nitrate", "palmitate", "stearate", "ethanolate", "sodium", "potassium", "calcium",
    "magnesium", "hydrate", "monohydrate", "dihydrate", "trihydrate", "sesquihydrate", "micronized", "granules",
]

_CLOSED = re.compile(r"\([^(\[{)]*\)|\[[^(\[{\]]*\]|\{[^(\[{}]*\}")
_LOCANT = re.compile(r"(?<=-[^\W\d_])/(?=[^\W\d_]-)")


def clean(c: Column) -> Column:
    """Text without outer white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def first_field(fields: Column, *names: str) -> Column:
    """The value of the first of `names` that the map has, whatever the case of its keys; of keys alike the last."""

    def alike(name: str) -> Column:
        return F.filter(F.map_entries(fields), lambda e: F.lower(F.trim(e["key"])) == name.strip().lower())

    found = F.lit(None).cast("string")
    for name in reversed(names):
        same = alike(name)
        found = F.when(F.size(same) > 0, F.try_element_at(same, F.lit(-1))["value"]).otherwise(found)
    return found


def date_text(c: Column) -> Column:
    """Eight digits in any punctuation become yyyy-mm-dd; other text stays."""
    text, digits = clean(c), F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) == 8, F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(text)


def code_list(c: Column) -> Column:
    """Distinct codes of a comma-separated text, in their order, blanks left out."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), clean), lambda x: x.isNotNull()))


def equivalent_code(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in EQUIVALENT_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


def _outside(text: str, at: int) -> bool:
    """Whether no bracket is open at `at`: pairs go from the inside out, and an opener that stays is open."""
    head, before = text[:at], ""
    while head != before:
        head, before = _CLOSED.sub("", head), head
    return not any(b in head for b in "([{")


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKC and case folding; a slash between one-letter locants outside brackets becomes a comma."""

    def fold(text):
        if text is None:
            return None
        text = unicodedata.normalize("NFKC", text).strip().casefold()
        if "/" in text:
            places = {m.start() for m in _LOCANT.finditer(text) if _outside(text, m.start())}
            text = "".join("," if i in places else ch for i, ch in enumerate(text))
        return text

    return texts.map(fold)


def ingredient_name(c: Column) -> Column:
    """One spelling of an ingredient: folded, no trailing class number, single blanks, none about + and /."""
    text = F.regexp_replace(folded(c), r"\s*\(\s*분류번호\s*:[^)]+\)\s*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*([+/])\s*", "$1")
    return F.trim(text)


def moiety_name(c: Column) -> Column:
    """The name without the words of salt and form at its end, of which at least one word stays; mixtures stay whole."""
    name = ingredient_name(c)
    bare = F.when(name.rlike(r"^dilute .*\([^()]*\)$"), F.regexp_replace(name, r"\s*\([^()]*\)$", "")).otherwise(name)
    diluted = F.regexp_replace(F.regexp_replace(bare, "^dilute ", ""), " solution$", "")
    bare = F.when(bare.startswith("dilute "), F.trim(diluted)).otherwise(bare)
    ends = "|".join(SUFFIX_PHRASES + SUFFIX_WORDS)
    return F.when(name.rlike("[+/]"), name).otherwise(F.regexp_replace(bare, f"^(.+?)(?: (?:{ends}))+$", "$1"))


def digest_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix_ and the first `length` upper-case hex digits of the SHA-256 of the parts, joined by NUL; null if a part is."""
    joined = F.concat(*(x for p in parts for x in (F.lit("\0"), p.cast("string"))))
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(F.sha2(F.substring(joined, F.lit(2), F.length(joined)), 256), 1, length)))


def set_signature(c: Column) -> Column:
    """A set of codes as sorted JSON, equal for equal sets."""
    return F.to_json(F.array_sort(F.array_distinct(c)))


def scripts(c: Column) -> Column:
    """Which scripts a text has."""
    return F.struct(c.rlike("[가-힣]").alias("hangul"), c.rlike("[A-Za-z]").alias("latin"), c.rlike("[0-9]").alias("digit"))
