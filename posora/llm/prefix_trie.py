"""Prefix trie of conversations, built as a Patricia tree.

Turns become digests where they are read; texts are never shuffled. Positions
come from one range sort by (conversation, turn), so that a conversation of any
length spreads over tasks. Each conversation is cut into blocks of BLOCK turns;
equal blocks after equal prefixes are one entry with its number of copies. The
entries are range-sorted by (prefix, digests). Each range is streamed once with
a stack, which holds the path of the current entry and makes points only where
paths branch or end; an edge keeps the digests and words of the nodes on it. A
range also makes each node that it shares with its neighbours, so ranges merge
by adding up what they know of the same node. Weights of entries make all
aggregates sums: of copies for members, of the words of copies and of the words of
nodes of its own for saved tokens. Last, edges are expanded to their nodes, whose
values follow from the lower end's by the suffix sums of the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Turns of a block: the longest array of digests that a row holds.
BLOCK = 128
#: Ids of a range of 2^ID_BITS are joined into one piece before they are digested.
ID_BITS = 12
#: Points that a task hands over at a time.
ROWS = 2000

_WORD = r"[^\x20\x09-\x0D]+"
_POINT = "h1 long, h2 long, depth long, p1 long, p2 long, parent_depth long, e1 array<long>, e2 array<long>, ew array<long>, n long, saved long, leaves long, children long, rep long, own_words long, own_leaf long"


def turn_digests(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, at, t1, t2, w): digests and words of each turn; null role or text is empty, rows without an id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(id_col).cast("long").alias("id"), F.col(order_col).alias("at"), role.alias("role"), text.alias("text")).filter("id IS NOT NULL")
    return rows.select("id", "at", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role", F.lit(1)).alias("t2"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("w"))


def ordered(digests: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns as sorted and written, and for each (id, part) of them the row before the conversation's first, as if it had been one run.

    Ties in the order go by digest, so the result doesn't depend on the rows' places.
    """
    order = [F.col("id"), F.col("at").asc_nulls_first(), F.col("t1"), F.col("t2")]
    row = F.monotonically_increasing_id()  # the part, and the place in it, of the rows as they are written
    dealt = scratch.save(digests.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t1", "t2", "w", row.alias("row")))
    dealt = dealt.withColumn("part", F.shiftright("row", 33))
    spans = dealt.groupBy("id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, scratch.save(spans.select("id", "part", (F.col("first") - F.coalesce(before, F.lit(0)) - 1).alias("zero"), "n"))


def rebuilt(digests: DataFrame, scratch: Scratch, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (id, pos, t1, t2, w) and ids of the conversations that begin with up to ``most`` - 1 turns of their group's first.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation
    c - c % ``group`` (all if fewer, none if absent) and then its own after its first h.
    """
    dealt, spans = ordered(digests, scratch)
    lengths = spans.groupBy("id").agg(F.sum("n").alias("length"))
    ids = lengths.select("id", "length", (F.col("id") - F.col("id") % group).alias("base"), (F.crc32(F.col("id").cast("string").cast("binary")) % most).alias("h"))
    ids = ids.join(lengths.select(F.col("id").alias("base"), F.col("length").alias("there")), "base", "left")
    ids = scratch.save(ids.select("id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    places = spans.join(ids, "id").select("id", "part", "zero", "h", "taken")
    turns = dealt.join(places, ["id", "part"]).withColumn("at", F.col("row") - F.col("zero"))
    own = turns.filter("at > h").select("id", (F.col("at") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "w")
    first = turns.filter((F.col("at") < most) & (F.col("id") % group == 0)).select(F.col("id").alias("base"), F.col("at").alias("pos"), "t1", "t2", "w")
    wanted = ids.filter("taken > 0").select("id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("pos"))
    return own.union(wanted.join(first, ["base", "pos"]).select("id", "pos", "t1", "t2", "w")), ids.select("id")


def as_they_are(digests: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (id, pos, t1, t2, w) and ids of the conversations themselves."""
    dealt, spans = ordered(digests, scratch)
    turns = dealt.join(spans, ["id", "part"]).select("id", (F.col("row") - F.col("zero")).alias("pos"), "t1", "t2", "w")
    return turns, spans.select("id").distinct()


class Path:
    """The stack of points on the way to the current entry of one range."""

    def __init__(self, left: tuple | None, right: tuple | None):
        self.left, self.right, self.root, self.stack, self.out = left, right, None, [], []

    def _emit(self, p: dict, parent: int) -> None:
        d = p["depth"]
        saved, leaves = p["nw"] - p["words"], p["leaves"]
        if d:
            saved -= p["n"] * int(self.pw[d - 1])
            if p["seen"] < d - 1:
                saved += int(self.pw[d - 1] - self.pw[p["seen"]])
        own = p["own"] if p["end"] else 0
        deep, real = self.k * self.block, d > 0  # a root's own values are those of the node that the block hangs on
        self.out.append((
            self.x1[d], self.x2[d], deep + d, self.x1[parent] if real else None, self.x2[parent] if real else None, deep + parent if real else None,
            self.x1[parent + 1 : d], self.x2[parent + 1 : d], self.w[parent : d - 1] if real else self.w[:0],
            p["n"] if real else 0, saved if real or not self.k else 0, leaves if real or not self.k else 0, p["children"], p["rep"] if real else None, own, p["own_leaf"],
        ))

    def _cut(self, depth: int, last: int = -1) -> None:
        """Close what is deeper than ``depth`` and have a point there; the right neighbour counts nodes down to ``last``."""
        while self.stack[-1]["depth"] > depth:
            p = self.stack.pop()
            if self.stack[-1]["depth"] < depth:
                self.stack.append({"depth": depth, "n": 0, "nw": 0, "words": 0, "leaves": 0, "children": 0, "rep": p["rep"], "seen": p["seen"], "end": False, "more": 0, "own": 0, "own_leaf": 0})
            if p["end"] and not p["children"] and not p["more"] and p["depth"] > last:
                p["own_leaf"] = 1
                p["leaves"] += 1
            top = self.stack[-1]
            self._emit(p, top["depth"])
            for key in ("n", "nw", "words", "leaves"):
                top[key] += p[key]
            top["rep"] = min(top["rep"], p["rep"]) if top["rep"] is not None else p["rep"]
            top["children"] += p["depth"] > last

    def close(self, final: bool) -> None:
        """End the current tree; ``final``: the range ends here too."""
        if self.stack:
            last = self.right[1] if final and self.right and self.right[0] == self.root else -1
            for depth in range(max(last, 0), -1, -1):
                self._cut(depth, last)
            self._emit(self.stack.pop(), 0)

    def add(self, e, block: int) -> None:
        root = (e.s1, e.s2, e.k)
        t = np.asarray(e.t)
        blank = {"n": 0, "nw": 0, "words": 0, "leaves": 0, "children": 0, "rep": None, "end": False, "more": 0, "own": 0, "own_leaf": 0}
        if root != self.root:
            self.close(False)
            shared = self.left[1] if self.root is None and self.left and self.left[0] == root else -1
            self.root, self.k, self.block = root, e.k, block
            self.stack = [{**blank, "depth": d, "seen": shared} for d in range(max(shared, 0) + 1)]
            shared = max(shared, 0)
        else:
            m = min(len(t), len(self.t))
            differ = np.flatnonzero(t[:m] != self.t[:m])
            shared = (int(differ[0]) if len(differ) else m) // 2
            self._cut(shared)
        self.t, self.w = t, np.asarray(e.w)
        self.pw = np.concatenate([[0], np.cumsum(self.w)])
        self.x1, self.x2 = (np.bitwise_xor.accumulate(np.concatenate([[s], x])) for s, x in ((e.s1, e.x1), (e.s2, e.x2)))
        own = int(self.pw[-1] - self.pw[shared])
        self.stack.append({"depth": len(self.w), "n": e.n, "nw": e.nw, "words": own + e.below_words, "leaves": e.below_leaves, "children": 0, "rep": e.rep, "seen": shared, "end": True, "more": e.n - e.stop, "own": own, "own_leaf": 0})


def points_of(entries: DataFrame, edges: dict, block: int) -> DataFrame:
    """The points of each range of ``entries`` and the nodes that it shares with its neighbours."""
    columns = [c.split()[0] for c in _POINT.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        # column by column: a missing value must not turn long integers into floats
        return pd.DataFrame({c: pd.array(v, "Int64") if c in ("p1", "p2", "parent_depth", "rep") else v for c, v in zip(columns, map(list, zip(*rows, strict=True)), strict=True)})

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, path, out = None, None, []
        for pdf in batches:
            for e in pdf.itertuples(index=False):
                if e.part != part:
                    if path:
                        path.close(True)
                        out += path.out
                    part, path = e.part, Path(*edges.get(e.part, (None, None)))
                path.add(e, block)
                if len(path.out) + len(out) >= ROWS:
                    yield frame(out + path.out)
                    out, path.out = [], []
        if path:
            path.close(True)
            out += path.out
        if out:
            yield frame(out)

    return entries.repartition("part").sortWithinPartitions("part", "s1", "s2", "k", "t").mapInPandas(grow, _POINT)


def shared_turns(a: list[int], b: list[int]) -> int:
    m = min(len(a), len(b))
    return next((i for i in range(m) if a[i] != b[i]), m) // 2


def ids_digest(ends: DataFrame) -> DataFrame:
    """(h1, h2, digest): SHA-256 of the comma-joined ascending ids of each node; pieces of near ids are joined first, then streamed in order."""
    pieces = ends.groupBy("h1", "h2", F.shiftright("id", ID_BITS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("piece"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for pdf in batches:
            rows = []
            for h1, h2, piece in zip(pdf["h1"], pdf["h2"], pdf["piece"], strict=True):
                if (h1, h2) != key:
                    if key:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = (h1, h2), hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pd.DataFrame(rows, columns=["h1", "h2", "digest"])
        if key:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["h1", "h2", "digest"])

    return pieces.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "range").mapInPandas(stream, "h1 long, h2 long, digest string")


def prefix_trie(turns: DataFrame, ids: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """All nodes of the trie of the conversations ``ids`` with ``turns`` (id, pos from 1 without gaps, t1, t2, w).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256); a conversation without turns ends at the root. No ids: no rows.
    """
    x = turns.select("id", F.floor((F.col("pos") - 1) / block).alias("k"), "pos", "t1", "t2", "w", F.xxhash64("t1", "t2", "pos").alias("x1"), F.xxhash64("pos", "t2", "t1").alias("x2"))
    cut = x.groupBy("id", "k").agg(F.expr("bit_xor(x1)").alias("b1"), F.expr("bit_xor(x2)").alias("b2"), F.sum("w").alias("words"))
    whole = Window.partitionBy("id").orderBy("k")
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(0, Window.unboundedFollowing)
    chain = scratch.save(cut.select(
        "id", "k", "b1", "b2", F.coalesce(F.expr("bit_xor(b1)").over(before), F.lit(0)).alias("s1"), F.coalesce(F.expr("bit_xor(b2)").over(before), F.lit(0)).alias("s2"),
        F.sum("words").over(after).alias("tail"), (F.count("*").over(after) == 1).alias("stop"),
    ))

    rows = x.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "x1", "x2", "w"))).alias("own")).join(chain, ["id", "k"])

    def each(name: str) -> Column:
        return F.transform("own", lambda v: v[name])

    key = ["k", "s1", "s2", "b1", "b2"]
    arrays = F.struct(F.flatten(F.transform("own", lambda v: F.array(v["t1"], v["t2"]))).alias("t"), each("x1").alias("x1"), each("x2").alias("x2"), each("w").alias("w"))
    entries = rows.select(*key, "id", "tail", "stop", arrays.alias("a")).groupBy(*key).agg(F.first("a").alias("a"), F.min("id").alias("rep"), F.count("*").alias("n"), F.sum("tail").alias("nw"), F.sum(F.col("stop").cast("long")).alias("stop"))
    entries = entries.select(*key, "a.*", "rep", "n", "nw", "stop")
    entries = scratch.save(entries.repartitionByRange("s1", "s2", "k", "t").withColumn("part", F.spark_partition_id()))

    place = F.struct("s1", "s2", "k", "t")
    ends = entries.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last")).orderBy("part").collect()  # two arrays of a block for each range
    left, right = {}, {}
    for p, q in zip(ends, ends[1:], strict=False):
        if p["last"][:3] == q["first"][:3]:
            left[q["part"]] = right[p["part"]] = (tuple(p["last"][:3]), shared_turns(p["last"]["t"], q["first"]["t"]))
    edges = {r["part"]: (left.get(r["part"]), right.get(r["part"])) for r in ends}

    none = F.lit(0).cast("long")
    flat = entries.withColumns({"below_words": none, "below_leaves": none})
    deep = entries.filter("k > 0")
    if not deep.isEmpty():
        # nodes of later blocks belong to the least conversation of the entry that first has them; each block is told what lies below it
        found = points_of(flat.filter("k > 0"), edges, block).filter("own_words > 0 OR own_leaf > 0").groupBy("h1", "h2").agg(F.sum("own_words").alias("own_words"), F.sum("own_leaf").alias("own_leaf"))
        named = deep.select(F.col("rep").alias("id"), "k", F.expr("s1 ^ b1").alias("h1"), F.expr("s2 ^ b2").alias("h2")).join(found, ["h1", "h2"]).select("id", "k", "own_words", "own_leaf")
        named = scratch.save(named)
        later = whole.rowsBetween(1, Window.unboundedFollowing)
        below = chain.join(named.select("id").distinct(), "id", "left_semi").join(named, ["id", "k"], "left")
        below = below.select(*key, F.sum("own_words").over(later).alias("bw"), F.sum("own_leaf").over(later).alias("bl")).groupBy(*key).agg(F.sum("bw").alias("bw"), F.sum("bl").alias("bl"))
        flat = entries.join(below, key, "left").select(*entries.columns, F.coalesce("bw", none).alias("below_words"), F.coalesce("bl", none).alias("below_leaves"))

    points = points_of(flat, edges, block)
    every = ids.agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n > 0")
    top = every.selectExpr("0L AS h1", "0L AS h2", "0L AS depth", "n", "0L AS saved", "0L AS leaves", "0L AS children", "rep", "CAST(NULL AS struct<parent_depth:bigint,p1:bigint,p2:bigint,e1:array<bigint>,e2:array<bigint>,ew:array<bigint>>) AS up")
    up = F.struct("parent_depth", "p1", "p2", "e1", "e2", "ew")
    merged = points.select("h1", "h2", "depth", "n", "saved", "leaves", "children", "rep", up.alias("up")).union(top)
    merged = merged.groupBy("h1", "h2", "depth").agg(*(F.sum(c).alias(c) for c in ("n", "saved", "leaves", "children")), F.min("rep").alias("rep"), F.expr("max_by(up, up.parent_depth)").alias("up"))
    merged = scratch.save(merged.withColumn("leaves", F.when((F.col("depth") == 0) & (F.col("children") == 0), 1).otherwise(F.col("leaves"))))

    stops = chain.filter("stop").select(F.expr("s1 ^ b1").alias("h1"), F.expr("s2 ^ b2").alias("h2"), "id")
    turnless = ids.join(chain.filter("k = 0").select("id"), "id", "left_anti").select(none.alias("h1"), none.alias("h2"), "id")
    parents = merged.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("rep").alias("parent_rep"))
    full = merged.select("*", F.col("up.p1").alias("p1"), F.col("up.p2").alias("p2")).join(parents, ["p1", "p2"], "left").join(ids_digest(stops.union(turnless)), ["h1", "h2"], "left")
    # nodes on the edge, top down, then its lower end; place i of the edge lies at depth parent_depth + 1 + i
    on_edge = F.coalesce(F.size("up.ew"), F.lit(0))
    rest = F.aggregate(F.slice("up.ew", F.col("i") + 1, F.greatest(on_edge - F.col("i"), F.lit(0))), none, lambda a, v: a + v)
    last = F.col("i") == on_edge
    nodes = full.withColumn("i", F.explode(F.sequence(F.lit(0), on_edge)))
    return nodes.select(
        F.col("rep").alias("conv_id"), (F.col("depth") - on_edge + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("parent_rep")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        (F.col("saved") + F.when(last | on_edge.eqNullSafe(0), none).otherwise((F.col("n") - 1) * rest)).cast("long").alias("saved_tokens"),
        F.when(last & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
