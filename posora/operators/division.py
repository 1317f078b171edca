"""Relational division: what holds for all parts of a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def divided(parts: DataFrame, offers: DataFrame, whole: str, part: str, target: str) -> DataFrame:
    """(whole, target): the targets that offer every part of a whole.

    ``parts`` has (whole, part), ``offers`` (part, target); repeated rows count once. A null part is
    offered by no target, so its whole has none; null wholes and targets are left out. Wholes without parts have no row.
    """
    wanted = parts.select(whole, part).filter(F.col(whole).isNotNull()).distinct()
    needed = wanted.groupBy(whole).agg(F.count("*").alias("_needed"))
    met = wanted.join(offers.select(part, target).filter(F.col(target).isNotNull()).distinct(), part).groupBy(whole, target).agg(F.count("*").alias("_met"))
    return met.join(needed, whole).filter("_met = _needed").select(whole, target)


def resolved_by_all_parts(parts: DataFrame, names: DataFrame, whole: str, part: str, name: str, target: str) -> DataFrame:
    """(whole, n_parts, targets, outcome) of every whole: its targets if each part has exactly one, else none.

    ``parts`` has (whole, part, name), a part with a row for each of its names; ``names`` has (name, target). The
    outcome is ``none`` where a part has no target or more than one, else ``one`` or ``several`` by the distinct targets of all parts.
    """
    listed = parts.select(whole, part, name).filter(F.col(whole).isNotNull())
    found = listed.join(names.select(name, target).distinct(), name, "left").groupBy(whole, part).agg(F.collect_set(target).alias("_t"))
    # a part's targets are those of its few names; a whole's are those of its parts
    each = found.groupBy(whole).agg(F.count("*").alias("n_parts"), F.bool_and(F.size("_t") == 1).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_t")))).alias("_t"))
    targets = F.when(F.col("_all"), F.col("_t")).otherwise(F.slice("_t", 1, 0))
    outcome = F.when(~F.col("_all"), "none").when(F.size("_t") == 1, "one").otherwise("several")
    return each.select(whole, "n_parts", targets.alias("targets"), outcome.alias("outcome"))
