"""The index of the embedding search on the given tables, at the query's own setting."""

import numpy as np
import pytest
from conftest import DATA

from posora.llm import embedding_dedup
from posora.llm.embedding_dedup import near_duplicates
from posora.llm.queries import QUERIES


def brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_goes_through_tables_and_equals_brute_force(spark, sf, monkeypatch):
    made = []
    own = embedding_dedup.Index.__init__
    monkeypatch.setattr(embedding_dedup.Index, "__init__", lambda self, *a, **k: (own(self, *a, **k), made.append(self))[0])
    got = {r.vec_id: r for r in QUERIES["op5_embedding_dedup"](spark, f"{DATA}/{sf}").collect()}
    assert made and all(i.width > 0 and i.tables > 0 for i in made)
    rows = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").collect()
    linked = brute(np.array([r.embedding for r in rows], float))
    assert len(got) == len(rows)
    assert sum(got[r.vec_id].n_links for r in rows) >= 0.98 * linked.sum()
    assert all(got[r.vec_id].n_links <= n for r, n in zip(rows, linked.sum(1), strict=True))


def test_recall_of_mates_at_the_threshold(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(8)
    own = np.concatenate([x, *(embedding_dedup.mates(x[rng.permutation(len(x))[:300]], c + 1e-9, int(100 * c)) for c in (0.95, 0.96, 0.98))])
    linked = brute(own)
    out = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")).collect()
    assert linked.sum() >= 1700
    assert sum(r.n_links for r in out) >= 0.97 * linked.sum()
    assert all(r.n_links <= linked[r.vec_id].sum() for r in out)


def test_narrow_vectors_lose_nothing(spark):
    rng = np.random.default_rng(9)
    for dims in (1, 2, 3):
        x = rng.normal(size=(120, dims))
        linked = brute(x)
        out = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
        assert sum(r.n_links for r in out) >= 0.95 * linked.sum()
        assert all(r.n_links <= linked[r.vec_id].sum() for r in out)
