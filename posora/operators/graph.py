"""Connected components of an edge table, by contraction.

Each round points every node at that of its neighbours and itself whose hash is
least, jumps once along those pointers and replaces the edges by edges between
the pointed-at nodes. Hashes differ from round to round, so nodes go by a
constant share a round, whatever their ids (with ids in place of hashes, a chain
in the order of its ids would lose two nodes a round). It ends when no edge is
left; the rounds' pointers, which shrink as the nodes do, then give every node
its component, last round first. Nothing is collected: the driver learns only
whether edges remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posora.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) of all nodes of ``edges`` (a, b); component is the least id reachable.

    Null ends are ignored, repeated edges are harmless, a node with loops alone is a component. No edges: no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    given = scratch.save(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    cur = scratch.save(given.filter("a < b"))
    rounds: list[tuple[DataFrame, DataFrame]] = []  # pointers (id, to), and the least given id of each node pointed at (to, least)
    while not cur.isEmpty():
        seed = F.lit(len(rounds))

        def placed(c: str):
            return F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("to"))

        both = cur.select(F.col("a").alias("id"), F.col("b").alias("to")).union(cur.select("b", "a"))
        near = scratch.save(both.groupBy("id").agg(F.min(placed("to")).alias("n")).select("id", F.least("n", placed("id"))["to"].alias("to")))
        jump = scratch.save(near.alias("x").join(near.alias("y"), F.col("x.to") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.to").alias("to")))
        own = jump.withColumn("least", F.col("id"))
        if rounds:
            own = jump.join(rounds[-1][1].select(F.col("to").alias("id"), "least"), "id")
        least = scratch.save(own.groupBy("to").agg(F.min("least").alias("least")))
        ja, jb = jump.select(F.col("id").alias("a"), F.col("to").alias("ta")), jump.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        nxt = scratch.save(cur.join(ja, "a").join(jb, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct())
        scratch.drop(cur, near)
        rounds.append((jump, least))
        cur = nxt
    scratch.drop(cur)
    labels: DataFrame | None = None
    for jump, least in reversed(rounds):
        ends = least.withColumnRenamed("least", "component")
        if labels is not None:
            ends = least.join(labels.select(F.col("id").alias("to"), "component"), "to", "left").select("to", F.coalesce("component", "least").alias("component"))
        new = scratch.save(jump.join(ends, "to").select("id", "component"))
        scratch.drop(jump, least, *([] if labels is None else [labels]))
        labels = new
    loops = given.filter("a = b").select(F.col("a").alias("id"), F.col("b").alias("component"))
    return loops if labels is None else labels.union(loops.join(labels.select("id"), "id", "left_anti"))
