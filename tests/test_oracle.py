"""Every SQL-checkable query against its DuckDB twin at sf0.001 (exact values)."""

import duckdb
import pytest

import __spark_entry__ as E
from attrita.sources.tables import TABLE_NAMES, table_path
from conftest import SF001
from tools.compare import _norm

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    return c


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    s = E.queries()[name](spark, SF001).toPandas()
    o = con.sql(SQL[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _norm(s) == _norm(o)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"geography", "churn_rate_pct", "customers", "churned"}
