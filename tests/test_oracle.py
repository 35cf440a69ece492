"""Every catalogue query against its SQL on the driver's tables."""

import pytest
from helpers import compared

from loomtext.plans import catalogue, derived, oracle

SQL = oracle.statements() | derived.statements()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    ours, theirs = compared(catalogue.QUERIES[name](spark, sf_dir), duck, SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(SQL)))
def test_query_runs(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
