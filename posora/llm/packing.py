"""Best-fit packing of token pieces into sequences, with certified bin counts.

Pieces of full length are sequences of their own. The others are dealt by hash
into partitions of a bounded number of pieces; each runs best-fit decreasing
and compares its bins with a lower bound from dual feasible functions. Where
the two are equal the partition is certified. Full bins stay, as none can be
better. Bins that are not full exchange their documents: those of all partitions are
gathered in ever fewer, again bounded, partitions and packed anew, until one
partition is left or a round saves nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .token_counts import encoder

#: Pieces that one partition packs at a time.
PIECES = 60_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length (0, 1, ...), longest first into the fullest bin that has room."""
    room_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # distinct rooms in use, sorted
    bins = np.empty(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k == len(rooms):
            b, left, n = n, capacity - size, n + 1
        else:
            left = rooms[k] - size
            own = room_bins[rooms[k]]
            b = own.pop()
            if not own:
                del room_bins[rooms.pop(k)]
        bins[i] = b
        if left:
            if left not in room_bins:
                insort(rooms, left)
                room_bins[left] = []
            room_bins[left].append(b)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions, over their parameters."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in np.unique(np.minimum(sizes, capacity // 2)):  # sizes over capacity - k count whole, those under k not at all
        kept = np.where(sizes > capacity - k, capacity, np.where(sizes >= k, sizes, 0))
        best = max(best, -(-int((kept * counts).sum()) // capacity))
    for k in range(1, 9):  # rounded to k-ths, where (k + 1) sizes don't divide the capacity
        whole = (k + 1) * sizes
        kept = np.where(whole % capacity == 0, sizes * k, whole // capacity * capacity)
        best = max(best, -(-int((kept * counts).sum()) // (k * capacity)))
    return best


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and the closing id, cut only past the capacity.

    Null text is empty and gives the closing id alone.
    """
    tail = np.array([closing_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["_id"], pdf["_text"], strict=True):
                ids = enc.encode(text) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096, per_partition: int = PIECES, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` (with a column length of 1 to capacity) and sequence_id, offset, certified.

    ``certified`` says that the last partition that packed the piece used no
    more bins than the lower bound, or that the piece fills its sequence. No
    pieces give no rows; equal pieces are packed one by one.
    """
    scratch = scratch or Scratch(pieces.sparkSession)
    cols = pieces.columns
    rows = scratch.save(pieces.withColumn("_key", F.xxhash64(*cols)).withColumn("_row", F.monotonically_increasing_id()))
    short = rows.filter(F.col("length") < capacity)
    n = short.count()
    done = rows.filter(F.col("length") >= capacity).select("_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    finished = [done]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_key", "_row"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=used)
        first = pdf["_row"].groupby(bins).min().to_numpy()
        return pd.DataFrame({
            "_row": pdf["_row"], "_key": pdf["_key"], "length": lengths, "sequence_id": first[bins],
            "offset": pd.Series(lengths, index=pdf.index).groupby(bins).cumsum().to_numpy() - lengths,
            "full": (fill == capacity)[bins], "certified": used == lower_bound(lengths, capacity), "bins": used,
        })

    schema = "_row long, _key long, length long, sequence_id long, offset long, full boolean, certified boolean, bins int"
    todo = short.select("_row", "_key", "length")
    groups, last = max(8, -(-n // per_partition)), None
    while n:
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("_key", "_row", F.lit(groups)), F.lit(groups)))
        packed = scratch.save(dealt.groupBy("_group").applyInPandas(one, schema))
        finished.append(packed.filter("full").select("_row", "sequence_id", "offset", "certified"))
        rest = packed.filter("not full")
        n, bins = rest.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        smaller = max(1, -(-n // per_partition))
        if groups == 1 or (last is not None and bins >= last and smaller >= groups):
            finished.append(rest.select("_row", "sequence_id", "offset", "certified"))
            break
        last, groups, todo = bins, smaller, rest.select("_row", "_key", "length")
    placed = finished[0]
    for f in finished[1:]:
        placed = placed.union(f)
    return rows.join(placed, "_row").select(*cols, "sequence_id", "offset", "certified")


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The pieces of ``docs`` and where each stands."""
    return pack(token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), capacity, scratch=scratch).withColumnRenamed("_id", id_col)
