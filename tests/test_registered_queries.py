"""Every registered query against its DuckDB statement."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

# The queries of the library itself; others bring their own tests.
QUERIES = {name: query for name, query in queries().items() if query.__module__.startswith("checks.")}
ORACLES = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            connection.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_statement(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in places) for r in cursor.fetchall()), key=repr)
    assert rows == expected


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_stays_on_the_jvm_and_free_of_products(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
