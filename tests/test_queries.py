"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, PLANS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def rows(values, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(str(v[i]) if not isinstance(v[i], float) else repr(v[i] + 0.0) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df, sql = PLANS[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(PLANS.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert PLANS[name](spark, SF).count() > 0


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__ as entry

    assert PLANS.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()
