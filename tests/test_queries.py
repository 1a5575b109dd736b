"""Every registered route query against its SQL twin; those without one must run."""

import pytest

from trackloom.plans import function_queries, more_queries, place_queries, recurrences, region_queries, state_queries  # noqa: F401
from trackloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
