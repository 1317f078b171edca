"""Each plan of the domain against its SQL, over the driver's tables and over small reviewed ones."""

import duckdb
import pytest
from golden_tables import GOLDEN, frame, values
from test_relational import db, rows  # noqa: F401 - the fixture

import posora.plans.corpus_cases  # noqa: F401 - registers its cases
from posora.plans.cases import ORACLE_SQL, PLANS, QUERIES, with_tables
from test_relational import SF


def same(df, found):
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows([c[0] for c in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in found.description)
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_equals_sql(spark, db, name):  # noqa: F811
    same(QUERIES[name](spark, SF), db.execute(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(n for n, (_, _, used) in PLANS.items() if set(used) <= set(GOLDEN)))
def test_plan_equals_sql_on_reviewed_rows(spark, name):
    plan, sql, used = PLANS[name]
    same(plan(*(frame(spark, t) for t in used)), duckdb.connect().execute(with_tables(sql, [values(t) for t in used])))
