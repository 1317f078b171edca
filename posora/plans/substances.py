"""From names in source texts to substances: composition texts, groups of names, representative names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posora.functions.compositions import split_parts
from posora.functions.names import digest_id
from posora.operators.matching import substance_name

#: Why a text wasn't split, the method of exact names, and what is known of a substance.
AMBIGUOUS = "ambiguous_composition_delimiter"
EXACT = "normalized_name_exact"
STATUSES = ["resolved_external_exact", "resolved_external_structured", "resolved_source_relation", "local_exact_unsolved"]


def safe_slash_split(texts: DataFrame, trusted: DataFrame, text_id: str, text: str, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(id, component, key) of composition texts, and (id, text, reason) of those that can't be split for sure.

    A slash parts ingredients, but it also stands in ratios and designations: a text with one outside brackets is split
    only if every part is a trusted name. A text without is one component. Components of one spelling count once; blank and null texts give none.
    """
    rows = texts.select(F.col(text_id).alias("_id"), F.trim(text).alias("_text")).filter("_text <> ''")
    known = trusted.select(substance_name(F.col(name)).alias("key")).filter("key <> ''").distinct().withColumn("sure", F.lit(True))
    parts = rows.select("_id", "_text", F.posexplode(split_parts(F.col("_text"), "/", False)).alias("place", "component")).withColumn("key", substance_name(F.col("component")))
    told = parts.join(known, "key", "left").groupBy("_id", "_text").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce("sure", F.lit(False))).alias("sure"), F.array_sort(F.collect_list(F.struct("place", "component", "key"))).alias("parts"),
    )
    unsure = F.col("_text").contains("/") & ((F.col("n") < 2) | ~F.col("sure"))
    each = told.filter(~unsure).select("_id", F.explode("parts").alias("p")).select("_id", "p.*").filter("key <> ''")
    first = each.groupBy("_id", "key").agg(F.min_by("component", "place").alias("component"))
    return first.select(F.col("_id").alias(text_id), "component", "key"), told.filter(unsure).select(F.col("_id").alias(text_id), F.col("_text").alias(text), F.lit(AMBIGUOUS).alias("reason"))


def representative(english: str = "name_en", korean: str = "name_ko"):
    """The aggregate of a group's name: the shortest English one, then by lower case and as it stands; Korean where there is none."""
    # a struct of nulls would come before all names
    en = F.min_by(english, F.when(F.col(english).isNotNull(), F.struct(F.length(english), F.lower(english), F.col(english))))
    ko = F.min_by(korean, F.when(F.col(korean).isNotNull(), F.struct(F.length(korean), F.col(korean))))
    return F.coalesce(en, ko)


def grouped_substances(observations: DataFrame, matches: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(substance_id, canonical_name, identity_status, n_names) of all substances, and (key, substance_id, name) of their names.

    ``observations`` has key, name_en and name_ko (blank ones null), ``matches`` (key, external, method), ``related`` keys that a source relation
    places. A name with exactly one external id belongs to that id's substance, so such names merge; any other is a
    substance of its own. Null keys are left out.
    """
    named = observations.filter("key IS NOT NULL").groupBy("key").agg(representative().alias("name"))
    one = matches.groupBy("key").agg(F.count_distinct("external").alias("k"), F.min("external").alias("external"), F.bool_or(F.col("method") == EXACT).alias("exact")).filter("k = 1").drop("k")
    placed = named.join(one, "key", "left").join(related.select("key", F.lit(True).alias("related")).distinct(), "key", "left")
    own = F.when(F.col("external").isNotNull(), digest_id("SUB", 20, F.lit("UNII"), F.col("external"))).otherwise(digest_id("SUB", 20, F.col("key")))
    placed = placed.withColumn("substance_id", own)
    status = (
        F.when(F.bool_or(F.col("external").isNotNull()), F.when(F.bool_or(F.coalesce("exact", F.lit(False))), STATUSES[0]).otherwise(STATUSES[1]))
        .when(F.bool_or(F.coalesce("related", F.lit(False))), STATUSES[2]).otherwise(STATUSES[3])
    )
    folded = placed.groupBy("substance_id").agg(status.alias("identity_status"), F.count("*").alias("n_names"))
    canonical = observations.join(placed.select("key", "substance_id"), "key").groupBy("substance_id").agg(representative().alias("canonical_name"))
    return folded.join(canonical, "substance_id").select("substance_id", "canonical_name", "identity_status", "n_names"), placed.select("key", "substance_id", "name")
