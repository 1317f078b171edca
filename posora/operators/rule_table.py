"""An ordered table of naming rules: the first whose pattern matches and whose base is known wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A regular expression whose first group is the base name, and the relation of the whole name to it."""

    relation: str
    pattern: str


def first_rules(names: DataFrame, rules: list[Rule], known: DataFrame, name: str = "name", base: str = "base") -> DataFrame:
    """(name, relation, base, rule) of the distinct names that a rule places; rules come in order, from 1.

    ``known`` has the names that may be bases, in its column ``base``. A name isn't its own base. Patterns are held against a name in one
    pass; only bases that they yield are looked up. Null names are left out; names that no rule places have no row.
    """
    listed = names.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    hits = F.array(*(F.when(F.col("name").rlike(r.pattern), F.struct(F.lit(i).alias("rule"), F.lit(r.relation).alias("relation"), F.regexp_extract("name", r.pattern, 1).alias("base"))) for i, r in enumerate(rules, 1)))
    found = listed.select("name", F.explode(F.filter(hits, lambda h: h.isNotNull() & (h["base"] != "") & (h["base"] != F.col("name")))).alias("h")).select("name", "h.*")
    sure = found.join(known.select(F.col(base).alias("base")).distinct(), "base")
    return sure.groupBy("name").agg(F.min_by(F.struct("relation", "base", "rule"), "rule").alias("w")).select("name", "w.relation", "w.base", F.col("w.rule").cast("long").alias("rule"))
