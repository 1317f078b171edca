"""Whitening against plain versions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA

from posora.llm import whitening
from posora.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, id long, x int, n int, component string, key string"


def test_products_and_planes_are_exact():
    rng = random.Random(1)
    for bits in (3, 19, 20, 21, 40, 62):
        y = np.array([[rng.randint(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(300)], np.int64)
        plain = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
        found = whitening.products(y)
        assert found.tolist() == plain
        assert whitening.products(y.astype(object)).tolist() == plain
        assert (whitening.from_planes(whitening.to_planes(found.ravel())) == found.ravel()).all()
    worst = np.full((1 << whitening.ROW_BITS, 2), (1 << whitening.LIMB) - 1 + (1 << 40), np.int64)
    assert whitening.products(worst)[0, 1] == len(worst) * int(worst[0, 0]) ** 2


def check(rows, sound, most):
    """Every figure from fractions and a plain eigendecomposition."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in sound.items()}
    fitted = sorted(set(map(tuple, x.values())))
    n, d = len(fitted), len(fitted[0])
    sums = [sum(v[k] for v in fitted) for k in range(d)]
    centred = [[Fraction(n * v[k] - sums[k], n) for k in range(d)] for v in fitted]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(most, d)
    got = {}
    for r in rows:
        got[r.vec_id, r.component] = r
    assert len(got) == len(rows) == k * len(sound)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-8
    z = {}
    for i, v in x.items():
        y = [n * c - s for c, s in zip(v, sums, strict=True)]
        for c in range(1, k + 1):
            r = got[i, c]
            assert r.n == n and r.deviation == sum(e * e for e in y)
            assert math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9)
        z[tuple(v)] = [got[i, c].whitened for c in range(1, k + 1)]
    m = np.array([z[v] for v in fitted])
    assert np.abs(m.T @ m / n - np.eye(k)).max() < 1e-8
    # each component of z is the centred x along one eigenvector: its covariance with x is sqrt(e) times that vector
    loads = m.T @ np.array([[float(c) for c in v] for v in centred]) / n
    assert np.allclose(loads @ cov, values[:k, None] * loads, atol=1e-6 * values[0] ** 1.5)


@pytest.mark.parametrize("dims", [3, 20])
def test_whitening_equals_plain_version(spark, dims):
    rng = np.random.default_rng(dims)
    vecs = (rng.normal(size=(150, dims)) * np.arange(1, dims + 1)).tolist()
    sound = dict(enumerate(vecs + vecs[:20]))  # copies are learnt from once
    odd = [None, [], [1.0] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)]
    rows = [(i, v, 1, 2, 3, "c", "k") for i, v in sound.items()] + [(1000 + i, v, 1, 2, 3, "c", "k") for i, v in enumerate(odd)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), sound, 16)


def test_query_equals_plain_version(spark):
    sf = f"{DATA}/sf0.001"
    sound = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(QUERIES["op12_whitening"](spark, sf).collect(), sound, 16)


def test_odd_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(*r, 1, 2, 3, "c", "k") for r in rows], SCHEMA)).collect()

    assert run([]) == [] and run([(1, None)]) == []
    one = run([(1, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = run([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0])])  # one entry is constant, one vector of another length
    assert {(r.vec_id, r.component, r.whitened is None) for r in flat} == {(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True), (3, 1, True)}
    assert {round(abs(r.whitened), 9) for r in flat if r.whitened is not None} == {1.0}
    huge = run([(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [0.5, 3.0])])
    assert len(huge) == 6 and {r.deviation for r in huge} == {None, 64**2 + 192**2}
    assert all(math.isfinite(r.explained) for r in huge)
