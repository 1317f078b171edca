"""Named slices of a data set, and their combinations, in one pass over the rows.

Each row becomes the bit mask of the predicates that hold for it. Rows are
counted by mask; slices and combinations are then sums over the masks, whose
number doesn't grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of an id's digest that a fingerprint sums up.
DIGITS = 12


def slice_plan(rows: DataFrame, predicates: dict[str, Column], row_id: str, least: int = 1, pairs: bool = True) -> DataFrame:
    """(slice, n, fingerprint) of each predicate, ``all`` and, with ``pairs``, each two predicates joined by ``&``, of ``least`` rows at least.

    A predicate that is null doesn't hold. The fingerprint sums digests of the ids, so it doesn't
    depend on their order and repeated ids count again; null ids count as rows and add nothing. At most 62 predicates.
    """
    if len(predicates) > 62:
        raise ValueError("a mask holds 62 predicates")
    names = list(predicates)
    mask = F.lit(0).cast("long")
    for i, p in enumerate(predicates.values()):
        mask = mask + F.when(p, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    part = F.conv(F.substring(F.md5(F.col(row_id).cast("string").cast("binary")), 1, DIGITS), 16, 10).cast("decimal(20,0)")
    masks = rows.select(mask.alias("mask"), part.alias("part")).groupBy("mask").agg(F.count("*").alias("n"), F.sum("part").alias("f"))
    bits = F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(i)) for i in range(len(names)))), lambda b: b.isNotNull())
    own = F.transform("bits", lambda b: F.struct(b.alias("a"), F.lit(-1).alias("b")))
    both = F.flatten(F.transform("bits", lambda a: F.transform(F.filter("bits", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    wanted = F.concat(F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), own, *([both] if pairs else []))
    each = masks.withColumn("bits", bits).select("n", "f", F.explode(wanted).alias("s")).groupBy("s").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    label = F.array(*(F.lit(n) for n in names))
    first, second = F.get(label, F.col("s.a")), F.get(label, F.col("s.b"))
    name = F.when(F.col("s.a") < 0, "all").when(F.col("s.b") < 0, first).otherwise(F.concat(first, F.lit("&"), second))
    return each.filter(F.col("n") >= least).select(name.alias("slice"), "n", F.coalesce("f", F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))
