"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import DATA

import posora.plans.corpus_shapes  # noqa: F401 - registers its queries
from posora.operators.relational import ORACLE_SQL, QUERIES

SF = f"{DATA}/{os.environ.get('TEST_SF', 'sf0.001')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(ORACLE_SQL[name])
    theirs = rows([c[0] for c in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in found.description)
    assert ours == theirs
    assert ours
