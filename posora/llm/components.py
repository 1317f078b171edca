"""Connected components of an edge table, by contraction.

Each round points every node at its smallest neighbour, jumps once along those
pointers and replaces the edges by edges between the pointed-at nodes, so the
edge table shrinks by at least half; it ends when no edge is left. Nothing is
collected: the driver learns only whether edges remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of all nodes of ``edges`` (a, b); component is the least id reachable.

    Null ends, loops and repeated edges are ignored. No edges: no rows.
    """
    cur = scratch.save(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    )
    labels: DataFrame | None = None
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("id"), F.col("b").alias("to")).union(cur.select("b", "a"))
        near = scratch.save(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")))
        jump = near.alias("x").join(near.alias("y"), F.col("x.to") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.to").alias("to"))
        jump = scratch.save(jump)
        ja, jb = jump.select(F.col("id").alias("a"), F.col("to").alias("ta")), jump.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        nxt = scratch.save(
            cur.join(ja, "a").join(jb, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct()
        )
        if labels is None:
            new = scratch.save(jump.select("id", F.col("to").alias("component")))
        else:
            j = jump.select(F.col("id").alias("component"), "to")
            new = scratch.save(labels.join(j, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
            scratch.drop(labels)
        scratch.drop(cur, near, jump)
        labels, cur = new, nxt
    if labels is None:
        return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
