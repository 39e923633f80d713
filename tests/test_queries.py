"""Every query with an SQL twin gives the twin's rows, names and types on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, oracle, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    found = oracle.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in df.dtypes} == {x[0]: str(x[1]) for x in found.description}
    order = sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_twin(spark, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
