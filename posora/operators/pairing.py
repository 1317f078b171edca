"""One-to-one matching of scored pairs in greedy order, in rounds.

The greedy rule takes pairs from the best down and skips those whose ends are
taken. A pair that is the best left for both of its ends is what the rule takes
next for them, whatever the rest does, so all such pairs are taken at once; then
pairs with a taken end go. The rounds end when no pair is left, with exactly
the matching of the sequential rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posora.scratch import Scratch


def greedy_matching(pairs: DataFrame, left: str, right: str, rank: list[Column], scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``pairs`` that the greedy rule takes; the least ``rank`` comes first, then the least ends.

    Ranks hold no nulls. Pairs with a null end can't be taken; of equal pairs one is. No pairs give none. The number of rounds is
    the longest chain of pairs that wait for one another: few in practice, though a chain of ever better neighbours takes half its length.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    sound = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    # the row itself ends the order, so that equal pairs differ in nothing that counts
    order = F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank)), F.col(left).alias("l"), F.col(right).alias("r"))
    rest = scratch.save(sound.select(F.struct(*(F.col(f"`{c}`") for c in pairs.columns)).alias("row"), order.alias("o")).dropDuplicates(["o"]))
    taken = []
    while not rest.isEmpty():
        lefts = rest.groupBy(F.col("o.l").alias("l")).agg(F.min("o").alias("best"))
        rights = rest.groupBy(F.col("o.r").alias("r")).agg(F.min("o").alias("best"))
        mutual = lefts.join(rights.select(F.col("best").alias("other")), F.col("best") == F.col("other")).select("best")
        won = scratch.save(rest.join(mutual, F.col("o") == F.col("best"), "left_semi"))
        taken.append(won)
        ends_l, ends_r = won.select(F.col("o.l").alias("tl")), won.select(F.col("o.r").alias("tr"))
        left_over = rest.join(ends_l, F.col("o.l") == F.col("tl"), "left_anti").join(ends_r, F.col("o.r") == F.col("tr"), "left_anti")
        after = scratch.save(left_over)
        scratch.drop(rest)
        rest = after
    out = taken[0] if taken else rest
    for t in taken[1:]:
        out = out.union(t)
    return out.select("row.*")
