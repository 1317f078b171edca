"""Local substance names to the identifiers of an outside register, by a cascade of spellings.

Every distinct name gives rows of spellings with a rank; one join finds them all, and the
least rank that answers wins. Register names are reduced to a count and one identifier a
spelling first, so a common spelling is one row in that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posora.functions.forms import _nfkc_folded

# Methods in their order, wrappers of names, what rules an alias in brackets out, letters, isotopes.
METHODS = [
    "normalized_name_exact", "approved_typo_alias", "approved_nomenclature_alias", "source_wrapper_exact",
    "source_declared_alias", "typography_greek", "typography_apostrophe", "typography_isotope",
]
WRAPPERS = [
    r"(?i)\s*\((경구|경구제|주사제|정제|질내삽입링|비경구형|외용제는 제외)\)\s*$",
    r"(?i)\s*함유제제\s*$",
    r"(?i)\s*\(분류번호\s*:\s*[^)]*\)\s*$",
]
IN_BRACKETS = r"^(.*?)\s*\(([^()]*)\)\s*$"
NO_ALIAS = r"(?i)[가-힣]|\d|strain|rdna|분류|외용|경구|주사|정제|질내|비경구|micronized"
ISOTOPE = r"(?i)\(\s*(\d{1,3})\s*(f|i|tc|mo|lu)\s*\)"
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}


def substance_name(c: Column) -> Column:
    """NFKC, folded case, single blanks; everything else of a name counts."""
    return F.trim(F.regexp_replace(_nfkc_folded(c), r"\s+", " "))


def _spellings(c: Column) -> Column:
    """array<struct<rank, method, parts>>: what a name may stand for; all parts must mean one substance."""
    name = F.trim(c)
    unwrapped = F.coalesce(*[F.when(F.trim(F.regexp_replace(c, p, "")) != name, F.trim(F.regexp_replace(c, p, ""))) for p in WRAPPERS])
    equals = F.filter(F.transform(F.split(c, "="), F.trim), lambda x: x != "")
    inner = F.regexp_extract(name, IN_BRACKETS, 2)
    bracketed = F.when(name.rlike(IN_BRACKETS) & ~inner.rlike(NO_ALIAS), F.array(F.trim(F.regexp_extract(name, IN_BRACKETS, 1)), F.trim(inner)))
    declared = F.when(c.contains("="), F.when(F.size(equals) >= 2, equals)).otherwise(bracketed)
    greek = c
    for letter, word in GREEK.items():
        greek = F.replace(greek, F.lit(letter), F.lit(word))
    straight = F.regexp_replace(c, "[’‘]", "'")
    saint = F.regexp_replace(straight, r"(?i)\bSt\.\s+", "St ")
    curly, isotope = c.rlike("[’‘]"), c.rlike(ISOTOPE)
    found = [
        (30, 3, F.when(unwrapped.isNotNull(), F.array(unwrapped))),
        (40, 4, declared),
        (50, 5, F.when(greek != c, F.array(greek))),
        (60, 6, F.when(curly, F.array(straight))),
        (61, 6, F.when(curly, F.array(saint))),
        (70, 7, F.when(isotope, F.array(F.regexp_replace(c, ISOTOPE, " ($1$2)")))),
        (71, 7, F.when(isotope, F.array(F.regexp_replace(c, ISOTOPE, " $1$2")))),
    ]
    rows = [F.struct(F.lit(rank).alias("rank"), F.lit(METHODS[m]).alias("method"), parts.alias("parts")) for rank, m, parts in found]
    return F.filter(F.array(*rows), lambda s: s["parts"].isNotNull())


def matched(local: DataFrame, register: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, status, method, substance_id, external_name, dataset) of each distinct name of ``local`` (column name).

    ``register``: name, substance_id, dataset. ``aliases``: reviewed rows of method, name, evidence_name,
    substance_id, which hold only if the evidence means that one substance. A name of the register itself
    gives every substance that has it, in one row each; other methods give one or none. Status is
    `selected` for one, `ambiguous` for several and `unsolved` for no substance. Null names are left out;
    of several register names of one spelling the least in lower case is shown, and the least dataset.
    """
    known = register.select(substance_name(F.col("name")).alias("_key"), "name", "substance_id", "dataset")
    known = known.filter("_key <> '' AND substance_id IS NOT NULL").groupBy("_key", "substance_id").agg(
        F.min_by("name", F.struct(F.lower("name"), F.col("name"))).alias("external_name"), F.min("dataset").alias("dataset")
    )
    single = known.groupBy("_key").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("substance_id", "external_name", "dataset")])
    single = single.filter("_n = 1").drop("_n")

    names = local.select("name").filter("name IS NOT NULL").distinct().withColumn("_own", substance_name(F.col("name")))
    exact = names.join(known, names["_own"] == known["_key"]).drop("_key", "_own").withColumn("method", F.lit(METHODS[0]))
    rest = names.join(known.select("_key").distinct(), names["_own"] == F.col("_key"), "left_anti")

    reviewed = aliases.select(
        F.col("method").alias("_method"), substance_name(F.col("name")).alias("_own"), substance_name(F.col("evidence_name")).alias("_key"),
        F.col("evidence_name").alias("_evidence"), F.col("substance_id").alias("_target"),
    )
    by_review = rest.join(reviewed, "_own").join(single, "_key").filter("_target = substance_id").select(
        "name", F.array_position(F.lit(METHODS), F.col("_method")).cast("int").alias("rank"), F.col("_method").alias("method"), "substance_id",
        F.when(F.col("_method") == METHODS[2], F.col("_evidence")).otherwise(F.col("external_name")).alias("external_name"), "dataset",
    )

    spelt = rest.select("name", F.explode(_spellings(F.col("name"))).alias("_s")).select("name", "_s.*")
    parts = spelt.select("name", "rank", "method", F.posexplode("parts").alias("_at", "_part")).withColumn("_key", substance_name(F.col("_part")))
    by_spelling = (
        parts.join(single, "_key", "left")
        .groupBy("name", "rank", "method")
        .agg(
            F.bool_and(F.col("substance_id").isNotNull()).alias("_all"), F.count_distinct("substance_id").alias("_n"),
            *[F.min_by(c, "_at").alias(c) for c in ("substance_id", "external_name", "dataset")],
        )
        .filter("_all AND _n = 1")
    )
    fields = ["method", "substance_id", "external_name", "dataset"]
    either = by_review.unionByName(by_spelling.select(*by_review.columns))
    best = either.groupBy("name").agg(F.min_by(F.struct(*fields), F.struct("rank", *fields)).alias("_b")).select("name", "_b.*")
    found = exact.unionByName(best)
    counts = found.groupBy("name").agg(F.count("*").alias("_n"))
    out = names.select("name").join(counts, "name", "left").join(found, "name", "left")
    status = F.when(F.col("_n").isNull(), "unsolved").when(F.col("_n") == 1, "selected").otherwise("ambiguous")
    return out.select("name", status.alias("status"), *fields)
