"""Registered queries of the variant engine against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from varsift.plans import catalogue

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
# needs 90 usable variants, which the smallest tables barely have
NEEDS_MORE = {"norm_model", "error_model_fit", "fitness_run"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "events"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def text(value) -> str:
    return f"{value:.5f}" if isinstance(value, float) else str(value)


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - NEEDS_MORE))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    spark.catalog.clearCache()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns) == rows(result.fetchall(), columns)


def test_names_are_not_those_of_corpus_operators():
    """Names that begin with "op" are the corpus operators'; they tell whether those are installed."""
    assert not [name for name in {**catalogue.queries(), **catalogue.oracle_sql()} if name.startswith("op")]
