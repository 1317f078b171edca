"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

Several rotations, each learnt for balanced binary codes, give each vector one
code for each; the codes are cut into chunks, and each chunk is a table.
Vectors that agree in a chunk, or differ in one bit of it, are candidates. The
chunks widen with the number of vectors, so that buckets stay small, and the
wider they are the more tables are taken: so many that pairs at the threshold,
made from the sample, meet in one of them nearly always (RECALL). A pair belongs
to the first table in which it meets, so each is compared once and nothing has
to be made distinct. Tables hold codes alone; vectors go once to the blocks that
compare them: buckets are cut into blocks of bounded size, pairs of blocks are
compared as matrices in double precision, and only sums of links and spanning
edges leave a block. Equal vectors are compared as one and counted with their
number. Vectors of each length are a search of their own, with an index of its
own. Where no tables reach the recall, which narrow vectors may bring about, all
vectors of that length are one bucket, so nothing is lost; that is logged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch

#: Rows that rotations are learnt from, for each length and whatever the input.
SAMPLE = 4096
ITERATIONS, ROTATIONS = 30, 24
#: The share of pairs at the threshold that must meet, as measured on mates of the sample.
RECALL, MATES = 0.985, 1024
#: Vectors of a block, and rows of blocks that one call compares.
BLOCK, ROWS = 1024, 6000

KEYS = ["dims", "table", "a", "b", "i", "j"]


def learn_rotation(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for ``sign((v - mean) @ projection)``: principal directions, then alternating code and rotation steps."""
    mean = x.mean(0)
    centred = x - mean
    _, vecs = np.linalg.eigh(centred.T @ centred)
    basis = vecs[:, ::-1][:, :bits]
    v = centred @ basis
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1],) * 2))
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, basis @ r


def codes(x: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of bits for each vector, the rotations' codes side by side."""
    return np.concatenate([(x - m) @ p >= 0 for m, p in models], 1)


def chunk_values(bits: np.ndarray, width: int) -> np.ndarray:
    """Codes as one integer for each chunk of ``width`` bits (a shorter rest is left out)."""
    n = bits.shape[1] // width
    return bits[:, : n * width].reshape(len(bits), n, width) @ (1 << np.arange(width, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; neither overflow nor underflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def mates(x: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """For each unit vector one at the given cosine, in a random direction."""
    off = np.random.default_rng(seed).normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine * cosine) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)


def meetings(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """In which tables (columns) the rows of two arrays of bits meet."""
    diff = chunk_values(a, width) ^ chunk_values(b, width)
    return (diff & (diff - 1)) == 0


class Index:
    """Rotations, the width of chunks and the number of tables for ``n`` vectors like those of the sample."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, width: int | None = None):
        learnt, dims = unit(sample[::2]), sample.shape[1]
        x = unit(sample[1::2])  # measured on others than learnt from, on so many mates of few vectors that chance counts little
        x = np.tile(x, (-(-MATES // len(x)), 1))
        y = mates(x, threshold, 99)
        self.models: list[tuple[np.ndarray, np.ndarray]] = []
        self.width = width or int(np.clip(np.ceil(np.log2(max(2, n))) + 4, 6, 40))
        a = b = np.empty((len(x), 0), bool)
        while True:
            met = np.logical_or.accumulate(meetings(a, b, self.width), 1).mean(0) if a.shape[1] >= self.width else np.empty(0)
            enough = np.flatnonzero(met >= RECALL)
            if len(enough):
                self.tables = int(enough[0]) + 1
                break
            if len(self.models) < ROTATIONS:
                self.models.append(learn_rotation(learnt, min(64, dims), len(self.models)))
                a, b = (np.concatenate([old, codes(v, self.models[-1:])], 1) for old, v in ((a, x), (b, y)))
            elif self.width > 4:
                self.width -= 2  # larger buckets rather than lost pairs
            else:
                logging.getLogger(__name__).warning("no tables reach the recall for vectors of length %d: they are compared as one bucket", dims)
                self.width, self.tables = 0, 1
                break
        self.models = self.models[: -(-self.tables * self.width // min(64, dims))]

    def values(self, x: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros((len(x), 1), np.int64)
        return chunk_values(codes(unit(x), self.models), self.width)[:, : self.tables]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Pairs of cosine at least ``threshold`` link; vectors of different lengths have none. Vectors that are null, empty,
    zero or not finite link with nothing; so do rows with a null id, which get a null component. An empty
    table gives no rows. Repeated ids count as further vectors, equal vectors all link with each other. Other
    columns of ``vectors`` aren't read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = rows.filter(F.col("id").isNotNull() & fine)
    copies = scratch.save(sound.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("v")))
    lengths = copies.groupBy("dims").agg(F.count("*").alias("n")).filter("n > 1").collect()  # a table of embeddings has few lengths
    indexes: dict[int, Index] = {}
    for r in lengths:
        picked = copies.filter(F.col("dims") == r["dims"]).select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
        indexes[r["dims"]] = Index(np.array([p["v"] for p in picked]), r["n"], threshold, chunk)
    empty = spark.createDataFrame([], f"id {kind}, n long")
    if indexes:
        shared = spark.sparkContext.broadcast(indexes)  # at most ROTATIONS narrow matrices for each length

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dims, part in pdf.groupby("dims"):
                    if dims not in shared.value:  # a single vector
                        continue
                    values = shared.value[dims].values(np.stack(part["v"].to_numpy()))
                    for t in range(values.shape[1]):
                        yield pd.DataFrame({"dims": dims, "table": t, "value": values[:, t], "rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "values": list(values)})

        entries = scratch.save(copies.mapInPandas(encode, f"dims int, table int, value long, rep {kind}, copies long, values array<long>"))
        # each entry is in its own bucket and looks into those one bit away; of two such buckets only the pair (less, greater) is compared
        bucket = ["dims", "table", "value"]
        sizes = entries.groupBy(*bucket).agg(F.count("*").alias("n"))
        widths = spark.createDataFrame([(d, x.width) for d, x in indexes.items()], "dims int, width int")  # a row for each length
        flips = F.when(F.col("width") > 0, F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        pairs = scratch.save(
            sizes.join(F.broadcast(widths), "dims")
            .select("dims", "table", F.col("value").alias("a"), "n", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.coalesce(flips, F.array().cast("array<bigint>")))).alias("flip"))
            .withColumn("b", F.col("a").bitwiseXOR(F.col("flip")))
            .filter("a <= b")
            .join(sizes.select("dims", "table", F.col("value").alias("b"), F.col("n").alias("m")), ["dims", "table", "b"])
            .filter("a < b or n > 1")
        )
        # a bucket pair is cut into pairs of blocks; every row goes to the blocks it takes part in
        cut = pairs.withColumn("na", F.ceil(F.col("n") / BLOCK)).withColumn("nb", F.ceil(F.col("m") / BLOCK))
        own = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
        side_a = entries.join(cut.withColumnRenamed("a", "value"), bucket).withColumn("i", own % F.col("na")).withColumn("j", F.explode(F.sequence(F.when(F.col("value") == F.col("b"), F.col("i")).otherwise(F.lit(0).cast("long")), F.col("nb") - 1)))
        side_b = entries.join(cut.filter("a < b").withColumnRenamed("b", "value"), bucket).withColumn("j", own % F.col("nb")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)))
        same = entries.join(cut.filter("a = b and na > 1").select("dims", "table", F.col("a").alias("value"), "a", "b", "na", "nb"), bucket).withColumn("j", own % F.col("nb")).filter("j > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j") - 1)))
        fields = ["rep", "copies", "values"]
        blocks = (
            side_a.select("dims", "table", F.col("value").alias("a"), "b", "i", "j", F.lit(0).alias("side"), *fields)
            .union(side_b.select("dims", "table", "a", F.col("value").alias("b"), "i", "j", F.lit(1).alias("side"), *fields))
            .union(same.select("dims", "table", "a", "b", "i", "j", F.lit(1).alias("side"), *fields))
        )

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(KEYS, ignore_index=True)
            keys = pdf[KEYS].to_numpy()
            rep, copies, side, vecs, values = (pdf[c].to_numpy() for c in ("rep", "copies", "side", "v", "values"))
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            links, firsts, seconds, start = np.zeros(len(keys), np.int64), [], [], 0
            for end in ends:
                _, t, a, b, i, j = keys[start]
                own = np.arange(start, end)
                left = own[side[start:end] == 0]
                right = left if a == b and i == j else own[side[start:end] == 1]
                start = end
                if not len(left) or not len(right):
                    continue
                x = unit(np.stack(vecs[left]))
                linked = x @ (x if right is left else unit(np.stack(vecs[right]))).T >= threshold
                u, v = np.nonzero(np.triu(linked, 1) if right is left else linked)
                if not len(u):
                    continue
                u, v = left[u], right[v]
                diff = np.stack(values[u])[:, :t] ^ np.stack(values[v])[:, :t]
                first = ((diff & (diff - 1)) != 0).all(1)
                u, v = u[first], v[first]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                firsts.append(rep[u])
                seconds.append(rep[v])
            edges = spanning(np.concatenate(firsts), np.concatenate(seconds)) if firsts else []
            linked = links > 0
            out = [pd.DataFrame({"id": rep[linked], "n": links[linked]}), pd.DataFrame(edges, columns=["a", "b"])]
            return pd.concat(out, ignore_index=True).astype({c: "Int64" for c in ("id", "n", "a", "b")})[["id", "n", "a", "b"]]

        size = cut.agg(F.sum(F.col("n") * F.col("nb") + F.col("m") * F.col("na"))).first()[0] or 0
        groups = max(8, int(size) // ROWS)
        dealt = blocks.join(copies.select("rep", "v"), "rep").withColumn("_group", F.pmod(F.xxhash64(*KEYS), F.lit(groups)))
        found = scratch.save(dealt.groupBy("_group").applyInPandas(compare, f"id {kind}, n long, a {kind}, b {kind}"))
        counts = found.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
        labels = components(found.filter("a is not null").select("a", "b"), scratch)
    else:
        counts, labels = empty, spark.createDataFrame([], f"id {kind}, component {kind}")
    classes = (
        copies.join(counts, copies["rep"] == counts["id"], "left").drop("id")
        .join(labels, F.col("rep") == labels["id"], "left")
        .select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = sound.join(classes, sound["v"] == classes["_v"]).select("id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(F.col("id").isNotNull() & fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Edges of a spanning forest of the graph with edges (a, b)."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (rx := root(x)) != (ry := root(y)):
            parent[ry] = rx
            kept.append((x, y))
    return kept
