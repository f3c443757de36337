"""Every query of the library against its SQL on the smallest tables."""

import pytest
from oracle import same

import sparrowloom.plans  # noqa: F401
from sparrowloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert registry.FLAGSHIP in registry.QUERIES


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
