"""Exact n-gram Jaccard join and its connected classes.

Shingles have one global order: rare first, by a table of counts over the whole
corpus, then by hash. Two sets that reach the threshold share one of the first
few shingles of each (the prefix), so documents meet on prefix shingles. Pairs
must pass the length filter, the positional filter and the suffix filter (a
lower bound on what the sets can't share, from parity summaries whose size goes
with the set's), and each pair left is verified once on the whole texts.

Equal sets are one entry. Dense groups don't become all pairs: documents that
share a shingle are first held against one of them, in a few rounds whose
work is linear in the entries; only pairs that still lie in different classes
are then listed in full, so no link between classes is missed. A pair is listed
where it first meets: an entry goes to its shingle's bucket with the few shared
shingles before it, and two entries that have one of these in common have met there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, WordHashes, slices, summed, vectors, windows

#: Bits of a shingle's place in the table of counts: as many as the documents need, in these bounds (32 MB of counts in a task at most).
COUNT_BITS = (18, 22)
#: Shared shingles before one that go with it in the last round.
BEFORE = 8
#: Rounds in which documents are held against one of their bucket.
ROUNDS = 2


def shingle_set(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the lower-cased words."""
    return np.unique(windows(known.of_text(text), n))


def parity_bits(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Bits (in 64s), each the parity of the number of shingles that fall on it; about ten for each
    shingle by which two sets of this size may differ, in a power of two, 256 at least."""
    apart = 2 * len(shingles) * (100 - percent) / (100 + percent)
    size = max(256, 1 << int(np.ceil(np.log2(max(1.0, 10 * apart)))))
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def least_apart(a: F.Column, b: F.Column) -> F.Column:
    """At least so many shingles are in one of two sets alone, from their parities; the longer summary is folded to the shorter."""
    size = F.least(F.size(a), F.size(b))

    def folded(x: F.Column) -> F.Column:
        return F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``.

    Rows link when 100 * shared >= percent * united shingles; a class is what
    links reach and is named by its least id. Null or wordless text links with
    nothing, a null id gets a null class, repeated ids count as one document, an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count_bits = int(np.clip(np.ceil(np.log2(max(1, docs.count()))), *COUNT_BITS))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = WordHashes(), np.zeros(1 << count_bits, np.int64)
        at = np.uint64(64 - count_bits)
        for pdf in slices(batches):
            sets = [shingle_set(t, n, known) for t in pdf["text"]]
            counts += np.bincount((np.concatenate(sets) >> at).astype(np.int64), minlength=1 << count_bits)
            both = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sets], "sig": pd.Series(both, pdf.index, object), "key": pd.Series([None] * len(pdf), pdf.index, object), "vec": pd.Series([None] * len(pdf), pdf.index, object)})
        part = vectors({"counts": counts})
        yield pd.DataFrame({"id": pd.Series([None], dtype="Int64" if kind in ("bigint", "int") else object), "n": [0], "sig": pd.Series([None], dtype=object), "key": part["key"], "vec": part["vec"]})

    first = scratch.save(rows.mapInPandas(summarise, f"id {kind}, n long, sig binary, key string, vec binary"))
    sets = first.filter("key is null").select("id", "n", "sig")
    counted = summed(first.filter("key is not null").select("key", "vec")).get("counts", np.zeros(1 << count_bits, np.int64))
    order = spark.sparkContext.broadcast(np.argsort(np.argsort(counted, kind="stable"), kind="stable").astype(np.uint32))  # 16 MB at most

    worded = sets.filter("n > 0 and id is not null")
    classes = worded.groupBy("sig").agg(F.min("id").alias("rep"))
    reps = classes.select(F.col("rep").alias("id"))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place = WordHashes(), order.value
        at, low = np.uint64(64 - count_bits), np.uint64((1 << 64 - count_bits) - 1)
        for pdf in slices(batches):
            ids, ns, heads, bits = [], [], [], []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(t, n, known)
                if len(s):
                    p = prefix_length(len(s), percent)
                    ranked = place[(s >> at).astype(np.int64)].astype(np.uint64) << at | s & low
                    ids.append(i)
                    ns.append(len(s))
                    heads.append(np.sort(np.partition(ranked, p - 1)[:p]).view(np.int64))
                    bits.append(parity_bits(s, percent))
            if ids:
                few = np.stack([np.bitwise_xor.reduce(b.reshape(-1, 4)) for b in bits])
                yield pd.DataFrame({"id": ids, "n": ns, "head": heads, "bits": bits, **{f"b{k}": few[:, k] for k in range(4)}})

    heads = rows.filter(F.col("id").isNotNull()).mapInPandas(prefixes, f"id {kind}, n int, head array<long>, bits array<long>, b0 long, b1 long, b2 long, b3 long")
    entries = scratch.save(heads.join(reps, "id", "left_semi"))
    scratch.release()
    bands = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100)).cast("int")
    tokens = entries.withColumn("band", bands).select("id", "n", "band", F.posexplode("head").alias("pos", "token")).withColumn("c", F.col("id"))
    ends = entries.select("id", "n", "bits")

    def needed(a: str, b: str) -> F.Column:
        return F.ceil(F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100.0 + percent) - 1e-9)

    def near(a: str, b: str) -> F.Column:
        """The length and positional filters."""
        na, nb, pa, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
        length = (100 * na >= percent * nb) & (100 * nb >= percent * na)
        return length & (F.least(pa, pb) + 1 + F.least(na - pa - 1, nb - pb - 1) >= needed(a, b))

    def alike(pairs: DataFrame) -> DataFrame:
        """The suffix filter."""
        both = pairs.join(ends.alias("p"), F.col("a") == F.col("p.id")).join(ends.alias("q"), F.col("b") == F.col("q.id"))
        return both.filter(F.col("p.n") + F.col("q.n") - least_apart(F.col("p.bits"), F.col("q.bits")) >= 2 * needed("p", "q")).select("a", "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held_id, held = WordHashes(), None, None
        for pdf in batches:
            keep = []
            for b, ta, tb in zip(pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if held_id != b:
                    held_id, held = b, shingle_set(tb, n, known)
                own = shingle_set(ta, n, known)
                shared = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(100 * shared >= percent * (len(own) + len(held) - shared))
            yield pdf.loc[keep, ["a", "b"]]

    def verified(pairs: DataFrame) -> DataFrame:
        # only texts of the pairs' documents are dealt; where these are few Spark broadcasts their ids
        own = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = rows.join(own, "id", "left_semi")
        ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        out = scratch.save(pairs.join(ta, "a").join(tb, "b").mapInPandas(verify, f"a {kind}, b {kind}").distinct())
        scratch.drop(own)
        return out

    labels: DataFrame | None = None
    seen: DataFrame | None = None

    def relabelled(links: DataFrame) -> DataFrame:
        """Labels after ``links`` between ids."""
        if labels is None:
            return components(links, scratch)
        la, lb = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        between = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(between, scratch)
        moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
        old = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        fresh = joined.join(labels.select("id"), "id", "left_anti")
        return scratch.save(old.union(fresh))

    def listed(tokens: DataFrame) -> DataFrame:
        """All pairs of different classes that share a token and pass the filters, each where it first meets."""
        # dealt by the document, once, before its tokens become rows again
        alive = tokens.repartition("id").groupBy("id", "n", "band", "c").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("own"))
        alive = alive.join(entries.select("id", *(f"b{k}" for k in range(4))), "id")
        each = alive.select("id", "n", "band", "c", *(f"b{k}" for k in range(4)), "own", F.posexplode("own").alias("k", "at"))
        each = each.select("id", "n", "band", "c", *(f"b{k}" for k in range(4)), F.col("at.pos").alias("pos"), F.col("at.token").alias("token"), F.expr(f"transform(slice(own, greatest(k - {BEFORE}, 0) + 1, least(k, {BEFORE})), x -> x.token)").alias("before"))
        # sets of like length are in one band or in neighbouring ones
        other = each.withColumn("below", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("below"))
        x, y = each.alias("x"), other.alias("y")
        apart = F.when(F.col("y.below") == 0, F.col("x.c") < F.col("y.c")).otherwise(F.col("x.c") != F.col("y.c"))
        bits = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(1, 4)), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
        close = F.col("x.n") + F.col("y.n") - bits >= 2 * needed("x", "y")  # the suffix filter by 256 bits; all bits follow for each pair
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & apart & near("x", "y") & ~F.arrays_overlap("x.before", "y.before") & close)
        return met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()

    listings: list[DataFrame] = []
    for r in range(rounds + 1):
        # Most tokens stand in one document alone, or in documents of quite other lengths. All are dealt once; what goes on
        # are those of several classes, in documents whose next shorter or longer one of the token passes the length filter.
        bucket = Window.partitionBy("token")
        below, above = F.lag("n").over(bucket.orderBy("n")), F.lead("n").over(bucket.orderBy("n"))
        told = tokens.select("*", F.coalesce(100 * below >= percent * F.col("n"), F.lit(False)).alias("down"), F.coalesce(100 * F.col("n") >= percent * above, F.lit(False)).alias("up"))
        told = told.select("*", F.min("c").over(bucket).alias("c0"), F.max("c").over(bucket).alias("c1"))
        kept = scratch.save(told.filter("c0 < c1 and (down or up)").select("id", "n", "band", "pos", "token", "c"))
        if r:
            scratch.drop(held)
        tokens = held = kept
        if r == rounds:
            met = listed(tokens)
        else:
            # the bucket's first document, then one drawn anew for each bucket and round; tokens are dealt once, to find it and to meet it
            draw = F.struct("id", "n", "pos", "c") if not r else F.struct(F.xxhash64("id", "token", F.lit(r)).alias("draw"), "id", "n", "pos", "c")
            hubbed = tokens.withColumn("hub", F.min(draw).over(Window.partitionBy("token", "band"))).filter("hub.c != c")
            hubbed = hubbed.select(F.struct("id", "n", "pos").alias("x"), F.col("hub").alias("y"))
            met = hubbed.filter(near("x", "y"))
            met = met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
        if seen is not None:
            met = met.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.save(alike(met))
        listings.append(pairs)
        scratch.release()
        if not pairs.isEmpty():
            links = verified(pairs)
            labels = relabelled(links)
            scratch.drop(links)
            seen = pairs if seen is None else seen.union(pairs)
        scratch.release()
        if r < rounds and labels is not None:
            named = labels.select("id", F.col("component").alias("_c"))
            tokens = tokens.drop("c").join(named, "id", "left").withColumn("c", F.coalesce("_c", "id")).drop("_c")
    scratch.drop(entries, *listings, held)
    if labels is None:
        labels = spark.createDataFrame([], f"id {kind}, component {kind}")
    named = classes.join(labels, F.col("rep") == labels["id"], "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    linked = worded.join(named, "sig").select("id", "n", "component_id")
    alone = sets.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
