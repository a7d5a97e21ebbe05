"""Every query of the catalog against its SQL."""

import pytest

from orbitlake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(name, spark, small, same_as_sql):
    same_as_sql(catalog.QUERIES[name](spark, small), catalog.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, small):
    df = catalog.QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
