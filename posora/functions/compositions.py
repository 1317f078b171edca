"""Compositions: from the text of a product's ingredients to one set of codes.

A text is split outside its brackets (an Arrow function, since brackets nest); all else
is expressions and joins on rows of one part each. Reference names are reduced to a count
and one code for each name before the join, so no set of codes is ever gathered there.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posora.functions.names import _CLOSED, clean, equivalent_code, ingredient_name, moiety_name, set_signature

# Dosage words that may stand in brackets after a name, the word that marks an alias, patterns.
DOSAGE_QUALIFIERS = ["주사제", "정제", "경구제", "경구용", "경구"]
INCLUDES = "포함"
CLASS_NUMBER = r"\(\s*분류번호\s*:[^)]+\)\s*$"
IN_BRACKETS = r"^(.*?)\s*\(([^()]*)\)\s*$"
MIXTURE_CODE = r"\[([A-Z][0-9]{6})\]"
KOREAN_IN_BRACKETS = r"\([^()]*[가-힣][^()]*\)\s*$"

_LOCANT_OR = r"(?<=-[^\W\d_])/(?=[^\W\d_]-)"


def top_level(text: str, separators: str, keep_locants: bool = False) -> list[str]:
    """Parts of a text between separators outside brackets, trimmed, blanks left out.

    Closed pairs are blanked from the inside out; an opener that stays hides all after it.
    """
    text = unicodedata.normalize("NFKC", text).strip()
    mask, before = text, None
    while mask != before:
        before, mask = mask, _CLOSED.sub(lambda m: "\0" * len(m[0]), mask)
    mask = re.sub(r"[(\[{].*", "", mask, flags=re.DOTALL)
    kept = {m.start() for m in re.finditer(_LOCANT_OR, text)} if keep_locants else set()
    cuts = [i for i, ch in enumerate(mask) if ch in separators and i not in kept]
    parts = [text[a:b].strip() for a, b in zip([0, *(i + 1 for i in cuts)], [*cuts, len(text)], strict=True)]
    return [p for p in parts if p]


def split_parts(c: Column, separators: str = "+/", keep_locants: bool = True) -> Column:
    """Array of the parts of a text outside brackets; empty for null and blank text."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: top_level(t, separators, keep_locants) if t is not None else [])

    return split(c)


def atoms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, names, qualifier, alternatives): one row for each part of each text; none for null or blank text.

    ``names`` has two members where the brackets after a name give another name for it,
    and none where nothing is left; ``qualifier`` is a dosage word in brackets.
    """
    parts = rows.select(F.col(id_col), F.posexplode(split_parts(F.col(text_col))).alias("part", "_part"))
    parts = parts.withColumn("_raw", F.trim(F.regexp_replace("_part", CLASS_NUMBER, "")))
    bracketed = F.col("_raw").rlike(IN_BRACKETS)
    named = parts.select(
        id_col, "part", bracketed.alias("_two"),
        ingredient_name(F.col("_raw")).alias("_whole"),
        ingredient_name(F.regexp_extract("_raw", IN_BRACKETS, 1)).alias("_base"),
        ingredient_name(F.regexp_extract("_raw", IN_BRACKETS, 2)).alias("_note"),
        ingredient_name(F.split_part(F.regexp_extract("_raw", IN_BRACKETS, 2), F.lit(INCLUDES), F.lit(1))).alias("_alias"),
    )
    base, note = F.col("_base"), F.col("_note")
    qualified = F.col("_two") & (base != "") & note.isin(DOSAGE_QUALIFIERS)
    includes, latin = note.contains(INCLUDES), note.rlike(r"^[a-z0-9 .,'\-]+$")
    names = (
        F.when(~F.col("_two"), F.array("_whole"))
        .when(base == "", F.array().cast("array<string>"))
        .when(qualified, F.array(base))
        .when(includes, F.array(base, F.col("_alias")))
        .when(latin, F.array(base, note))
        .otherwise(F.array("_whole"))
    )
    told = F.col("_two") & (base != "") & ~qualified
    names = F.array_distinct(F.filter(names, lambda x: x != ""))
    return named.select(
        id_col, "part", names.alias("names"), F.when(qualified, note).alias("qualifier"),
        F.when(told & includes, F.size(names) > 1).otherwise(told & latin).alias("alternatives"),
    )


def _one_code(named: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    counted = named.groupBy(*keys).agg(F.count_distinct("_code").alias(f"{prefix}_n"), F.min("_code").alias(f"{prefix}_code"))
    return counted


def resolved(rows: DataFrame, known: DataFrame, id_col: str, text_col: str, category_col: str | None = None) -> DataFrame:
    """(id, codes, signature) of each id: the codes of all parts, or null where a part has not exactly one.

    ``known`` has columns ``name`` and ``code``, and ``category_col`` where names count in their
    category only. A part's own name decides; only where it is unknown is the name without salt and form
    tried. Ids are those of ``rows``, taken once each; an id with several texts needs all parts of all of them.
    """
    by = [category_col] if category_col else []
    exact = known.select(*by, ingredient_name(F.col("name")).alias("_key"), equivalent_code(clean(F.col("code"))).alias("_code"))
    exact = exact.filter("_key <> '' AND _code IS NOT NULL").distinct()
    bare = exact.withColumn("_moiety", moiety_name(F.col("_key"))).filter("_moiety <> _key AND _moiety <> ''")
    either = exact.unionByName(bare.select(*by, F.col("_moiety").alias("_key"), "_code"))

    single = atoms(rows, id_col, text_col)
    single = single.withColumn("_key", F.when((F.size("names") == 1) & F.col("qualifier").isNull(), F.element_at("names", 1)))
    if by:
        single = single.join(rows.select(id_col, category_col).distinct(), id_col)
    single = single.withColumn("_bare", moiety_name(F.col("_key")))
    found = single.join(_one_code(exact, [*by, "_key"], "_e"), [*by, "_key"], "left")
    found = found.join(_one_code(either, [*by, "_key"], "_m").withColumnRenamed("_key", "_bare"), [*by, "_bare"], "left")
    code = F.when(F.col("_e_n") == 1, F.col("_e_code")).when(F.col("_e_n").isNull() & (F.col("_m_n") == 1), F.col("_m_code"))
    per_id = found.groupBy(id_col).agg(F.bool_and(code.isNotNull()).alias("_all"), F.array_sort(F.collect_set(code)).alias("_codes"))
    out = rows.select(id_col).distinct().join(per_id, id_col, "left").withColumn("codes", F.when(F.col("_all"), F.col("_codes")))
    return out.select(id_col, "codes", set_signature(F.col("codes")).alias("signature"))


def mixture(c: Column) -> Column:
    """struct(entries: array<struct<code, name>>, reason) of texts like `[D000001]name/[D000002]name`.

    Null and blank texts have no entries and no reason. The reason is `malformed`, `unnamed`
    or `conflict` (one code, two names), and then there are no entries either.
    """
    text = clean(c)
    tail = rf"(?s){MIXTURE_CODE}((?:(?!{MIXTURE_CODE}).)*)"
    codes, names = F.regexp_extract_all(text, F.lit(tail), 1), F.regexp_extract_all(text, F.lit(tail), 2)

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"^\s*/*\s*|\s*/*\s*$", "")

    entries = F.array_distinct(F.zip_with(codes, names, lambda k, n: F.struct(k.alias("code"), bare(F.regexp_replace(bare(n), KOREAN_IN_BRACKETS, "")).alias("name"))))
    reason = (
        F.when(~text.rlike(rf"^[ /\t\r\n]*{MIXTURE_CODE}"), "malformed")
        .when(F.exists(entries, lambda e: e["name"] == ""), "unnamed")
        .when(F.size(entries) > F.size(F.array_distinct(codes)), "conflict")
    )
    none = F.array().cast("array<struct<code:string,name:string>>")
    return F.struct(F.when(text.isNull() | reason.isNotNull(), none).otherwise(entries).alias("entries"), reason.alias("reason"))
