"""Whitening of embeddings from an exact covariance.

Entries become integers. With n distinct vectors and their sums S, the centred
vectors times n, n * x - S, are integers too, so the matrix of their products can
be had without any rounding: each integer is split into limbs of LIMB bits,
limbs are multiplied as float64 matrices over so few rows that every sum stays
under 2^53, and products are put together again as big integers, which add up
over tasks in any order to the same matrix. Only its eigenvectors are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, summed, vectors

#: Bits of a limb, and rows of a product: sums of 2^ROW_BITS products of two limbs stay under 2^53.
LIMB, ROW_BITS = 20, 12
#: Big integers travel as PLANES numbers of PLANE bits, which tasks can add as 64-bit integers: 2^32 of them.
PLANE, PLANES = 31, 8
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Directions whose share of the variance is under this have none; rounding alone gives as much.
LEAST_SHARE = 1e-13


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """float64 matrices whose sum, each times 2^(LIMB * place), is the integer matrix ``y``; all but the last are in [0, 2^LIMB)."""
    out = []
    while True:
        if not len(y) or (-(1 << LIMB - 1) <= y.min() and y.max() < 1 << LIMB - 1):
            out.append(y.astype(np.float64))
            return out
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y as a matrix of Python integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), 1 << ROW_BITS):
        parts = limbs(y[at : at + (1 << ROW_BITS)])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                g = (a.T @ b).astype(np.int64).astype(object)
                total += (g if i == j else g + g.T) * (1 << LIMB * (i + j))
    return total


def to_planes(values: np.ndarray) -> np.ndarray:
    out, mask = [], (1 << PLANE) - 1
    for _ in range(PLANES - 1):
        out.append((values & mask).astype(np.int64))
        values = values >> PLANE
    return np.concatenate([*out, values.astype(np.int64)])


def from_planes(planes: np.ndarray) -> np.ndarray:
    parts = planes.reshape(PLANES, -1).astype(object)
    return sum(p * (1 << PLANE * k) for k, p in enumerate(parts))


@dataclass
class Whitener:
    """Of the vectors of one length: their number and sums, and the leading components with eigenvalues."""

    n: int
    sums: np.ndarray  # Python integers
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit integers where these hold it, else as Python integers."""
        most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        if self.n * most + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """A column for each component, NaN for those without variance."""
        flat = self.eigenvalues <= 0
        scale = np.where(flat, np.nan, np.sqrt(np.where(flat, 1.0, self.eigenvalues)))
        return (y.astype(np.float64) / self.n) @ self.components / scale


def deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None where 64 bits don't hold it."""
    most = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    if most * most * y.shape[1] < 1 << 62:
        return (y * y).sum(1).astype(np.int64).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in y)]


def stacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """(length, rows, matrix of their column x) of each batch, by the length of vectors."""
    for pdf in batches:
        for dims, part in pdf.groupby(pdf["x"].map(len)):
            yield int(dims), part, np.stack(part["x"].to_numpy())


def fit(x: DataFrame, most: int, scratch: Scratch) -> dict[int, Whitener]:
    """A whitener of the distinct rows of ``x`` (array<long>) for each length of vectors.

    The driver gets n, S and one square matrix of each length; a table of embeddings has few.
    """
    spark = x.sparkSession
    own = scratch.save(x.distinct())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for dims, _, m in stacked(batches):
            high, low = (m >> 32).sum(0).astype(object), (m & 0xFFFFFFFF).sum(0).astype(object)
            total[dims] = total.get(dims, 0) + np.append(high * (1 << 32) + low, len(m))
        yield vectors({str(d): to_planes(v) for d, v in total.items()})

    counted = {int(k): from_planes(v) for k, v in summed(own.mapInPandas(count, "key string, vec binary")).items()}
    blank = {d: Whitener(int(v[-1]), v[:-1], np.zeros((d, 0)), np.zeros(0), []) for d, v in counted.items()}
    sums = spark.sparkContext.broadcast(blank)  # a vector for each length

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for dims, _, m in stacked(batches):
            total[dims] = total.get(dims, 0) + products(sums.value[dims].centred(m))
        yield vectors({str(d): to_planes(v.ravel()) for d, v in total.items()})

    found = {int(k): from_planes(v).reshape(int(k), int(k)) for k, v in summed(own.mapInPandas(multiply, "key string, vec binary")).items()}
    for dims, m in found.items():
        model = blank[dims]
        cube = model.n**3
        covariance = np.array([[v / cube for v in row] for row in m])
        trace = sum(m.diagonal()) / cube
        values, vecs = np.linalg.eigh(covariance)
        values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
        model.eigenvalues, model.components = np.where(values > LEAST_SHARE * trace, values, 0.0), vecs
        model.explained = [float(max(v, 0.0) / trace) if trace else None for v in values]
    ready = spark.sparkContext.broadcast(blank)  # at most ``most`` columns for each length

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for dims, _, m in stacked(batches):
            z = ready.value[dims].whitened(ready.value[dims].centred(m))
            total[dims] = total.get(dims, 0.0) + np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield vectors({str(d): v for d, v in total.items()})

    for key, v in summed(own.mapInPandas(spread, "key string, vec binary"), "float64").items():
        model = blank[int(key)]
        sound = model.eigenvalues > 0
        if sound.any():
            k = len(sound)
            mean = v[:k] / model.n
            off = v[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)
            model.identity_error = float(np.abs(off[np.ix_(sound, sound)]).max())
    scratch.drop(own)
    return blank


def whiten(rows: DataFrame, most: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each sound row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; null ids and repeated rows are
    kept, equal vectors are learnt from once. Each length of vectors is a fit of its own. A direction without variance
    (a single vector, a constant entry) has null ``whitened``; without any variance ``explained`` and
    ``identity_error`` are null too. ``deviation`` is null where 64 bits don't hold it. No rows give none.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    kind = rows.schema[id_col].dataType.simpleString()
    v = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = v.filter("v IS NOT NULL AND size(v) > 0").filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    x = sound.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    models = spark.sparkContext.broadcast(fit(x.select("x"), most, scratch))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dims, part, m in stacked(batches):
            model = models.value[dims]
            y = model.centred(m)
            z = model.whitened(y)
            k = z.shape[1]
            yield pd.DataFrame({
                "id": part["id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), "n": model.n,
                "deviation": pd.array(deviations(y), "Int64").repeat(k), "whitened": pd.array(z.ravel(), "Float64") if not np.isnan(z).any() else pd.array([None if np.isnan(c) else c for c in z.ravel()], "Float64"),
                "explained": pd.array(model.explained * len(part), "Float64"), "identity_error": pd.array([model.identity_error] * (k * len(part)), "Float64"),
            })

    out = x.mapInPandas(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
