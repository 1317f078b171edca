"""Splits of a data set into parts of given shares that keep components whole.

The rule is sequential: components come by falling size, equal sizes by a seeded
digest, and each goes to the part that is furthest below its share, relative to
that share. No task walks all components, though. Among components of one size
every part's deficit falls by the same step each time it is chosen, so the
order of choices merges one arithmetic progression a part, and the choice at any
place of the run follows from the state before the run alone. The state is folded
over the distinct sizes, then every component finds its part by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that cut the components of one size into pieces that are ranked apart.
PIECE = 3


class Shares:
    """Parts and their integer weights, for a total of ``total``."""

    def __init__(self, weights: list[int], total: int):
        self.weights, self.total, self.whole = weights, total, sum(weights)
        # a part whose share is under one counts as if it were one
        self.scale = [max(w * total, self.whole) for w in weights]

    def deficit(self, k: int, assigned: int) -> Fraction:
        return Fraction(self.weights[k] * self.total - assigned * self.whole, self.scale[k])

    def best(self, assigned: list[int], among: list[int]) -> int:
        return max(among, key=lambda k: (self.deficit(k, assigned[k]), -k))

    def before(self, assigned: list[int], size: int, k: int, c: int) -> int:
        """How many choices of a run of ``size`` come before the ``c``-th (from 0) of part ``k``."""
        own, n = self.deficit(k, assigned[k] + size * c), c
        for j in range(len(self.weights)):
            if j != k:
                # the i-th choice of j comes first while its deficit is greater, or equal and j stands before k
                limit = (Fraction(self.weights[j] * self.total) - own * self.scale[j]) / self.whole - assigned[j]
                steps = limit / size
                whole = steps.numerator // steps.denominator
                exact = whole == steps
                n += max(0, whole + (0 if exact and j > k else 1))
        return n

    def at(self, assigned: list[int], size: int, place: int) -> int:
        """The part chosen at ``place`` (from 0) of a run of components of ``size``."""
        for k in range(len(self.weights)):
            low, high = 0, place
            while low < high:
                mid = (low + high) // 2
                if self.before(assigned, size, k, mid) < place:
                    low = mid + 1
                else:
                    high = mid
            if self.before(assigned, size, k, low) == place:
                return k
        raise AssertionError("a place of a run belongs to one part")

    def after(self, assigned: list[int], size: int, n: int) -> list[int]:
        """What is assigned after ``n`` components of ``size``."""
        out = []
        for k, had in enumerate(assigned):
            low, high = 0, n
            while low < high:  # the least c that isn't among the first n
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self.before(assigned, size, k, mid) < n else (low, mid)
            out.append(had + size * low)
        return out


def run_states(runs: Iterator[tuple[int, int]], shares: Shares, count: int) -> Iterator[tuple[int, list[int], dict[int, int]]]:
    """(size, assigned before, forced places) of each run (size, n) by falling size.

    Where no more components are left than parts are empty, each goes to an empty part.
    """
    parts = range(len(shares.weights))
    assigned, chosen, done = [0] * len(parts), [0] * len(parts), 0
    for size, n in runs:
        start, forced = list(assigned), {}
        free = max(0, min(n, count - len(shares.weights) - done))  # while more are left than there are parts
        if free:
            assigned = shares.after(assigned, size, free)
            chosen = [c + (a > b) for c, a, b in zip(chosen, assigned, start, strict=True)]
        for place in range(free, n):
            empty = [k for k in parts if not chosen[k]]
            forced[place] = k = shares.best(assigned, empty if empty and count - done - place <= len(empty) else list(parts))
            assigned[k] += size
            chosen[k] += 1
        done += n
        yield size, start, forced


def balanced_split(components: DataFrame, names: list[str], weights: list[int], seed: int = 0) -> DataFrame:
    """(component, size, split) of each row of ``components`` (component: string, size: long).

    Shares are the weights by size; null sizes and sizes under one count as one. Components are distinct; a null one
    is left out. Fewer components than parts leave parts empty. No rows give none.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component")), 256)
    rows = components.filter("component IS NOT NULL").select("component", F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(1)).alias("size"), digest.alias("digest"))
    rows = rows.withColumn("piece", F.substring("digest", 1, PIECE))
    # the place of a component in its run: by digest in its piece, after the pieces before it
    pieces = rows.groupBy("size", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("size", "piece", F.coalesce(before, F.lit(0)).alias("start"))
    placed = rows.join(starts, ["size", "piece"]).withColumn("place", F.row_number().over(Window.partitionBy("size", "piece").orderBy("digest", "component")) - 1 + F.col("start"))
    runs = pieces.groupBy("size").agg(F.sum("n").alias("n"))
    total = runs.agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("count")).first()
    shares, count = Shares(weights, int(total["total"] or 0)), int(total["count"] or 0)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordered = ((int(s), int(n)) for pdf in batches for s, n in zip(pdf["size"], pdf["n"], strict=True))
        held = []
        for size, state, forced in run_states(ordered, shares, count):
            held.append((size, state, [f"{p}:{k}" for p, k in forced.items()]))
            if len(held) == 5000:
                yield pd.DataFrame(held, columns=["size", "state", "forced"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["size", "state", "forced"])

    # one task walks the distinct sizes with a state of one number a part
    states = runs.repartition(1).sortWithinPartitions(F.desc("size")).mapInPandas(fold, "size long, state array<long>, forced array<string>")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for size, place, state, forced in zip(pdf["size"], pdf["place"], pdf["state"], pdf["forced"], strict=True):
                fixed = dict(tuple(map(int, f.split(":"))) for f in forced)
                out.append(names[fixed[place] if place in fixed else shares.at([int(v) for v in state], int(size), int(place))])
            yield pd.DataFrame({"component": pdf["component"], "size": pdf["size"], "split": out})

    return placed.join(states, "size").select("component", "size", "place", "state", "forced").mapInPandas(choose, "component string, size long, split string")


def component_sizes(members: DataFrame, component: str | Column, size: str | Column) -> DataFrame:
    """(component, size): the summed sizes of the members of each component."""
    named = members.select((F.col(component) if isinstance(component, str) else component).alias("component"), (F.col(size) if isinstance(size, str) else size).alias("_s"))
    return named.groupBy("component").agg(F.sum("_s").alias("size"))


def exposure_split(catalog: DataFrame, exposed: DataFrame, family: str, seed: int = 0) -> DataFrame:
    """``catalog`` with ``split``: families that were seen before are train, the rest goes to val and test, whole and balanced by rows.

    ``exposed`` has the seen families in its column ``family``. Null families are left out.
    """
    seen = exposed.select(F.col(family).alias("_f")).filter("_f IS NOT NULL").distinct()
    rows = catalog.filter(F.col(family).isNotNull())
    fresh = rows.join(seen, rows[family] == seen["_f"], "left_anti")
    parts = balanced_split(component_sizes(fresh, family, F.lit(1)), ["val", "test"], [1, 1], seed).select(F.col("component").alias("_f"), "split")
    known = seen.withColumn("split", F.lit("train"))
    return rows.join(known.union(parts), rows[family] == F.col("_f")).drop("_f")
