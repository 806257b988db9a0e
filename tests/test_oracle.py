"""Every registered query with an oracle matches DuckDB at sf0.01, and every
registered query runs and keeps a stable schema at sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK, SF_SMALL
from oracle_check import compare, duck

ORACLE = sorted(E.oracle_sql())
ROWS_ONLY = sorted(set(E.queries()) - set(ORACLE))


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", ORACLE)
def test_oracle_pair(spark, con, name):
    spdf = E.queries()[name](spark, SF_CHECK).toPandas()
    ddf = con.sql(E.oracle_sql()[name]).df()
    status, why = compare(spdf, ddf)
    assert status in ("EXACT", "NEAR"), why


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = E.queries()[name](spark, SF_CHECK)
    rows = df.collect()
    assert len(rows) >= 1
    assert list(rows[0].asDict()) == df.columns      # stable, named schema


def test_entry_smoke(spark):
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0]["r2"] > 0.99
    assert set(df.columns) >= {"r2", "rmse", "mae", "r2_std", "train_r2"}


def test_oracle_names_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    _ = SF_SMALL
