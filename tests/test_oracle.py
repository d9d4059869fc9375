"""Every query with SQL gives the SQL's rows; every other query gives rows of a stable schema."""

import oracle
import pytest

from lodestone.plans import catalog, register  # noqa: F401

D = "/root/testdata/sf0.01"
#: Queries whose tables hold no such case; tests over small tables cover them.
NO_ROWS = {"orm_parse", "ddl_parse"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, con, name):
    got, want, _, _ = oracle.compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], D)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, D)
    rows = df.collect()  # all columns are evaluated
    assert (rows or name in NO_ROWS) and len(set(df.columns)) == len(df.columns)
