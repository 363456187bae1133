"""Every query with an SQL twin gives its rows; the others are held against NumPy in test_values.py."""

import pytest

from panelweave import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


def test_every_query_has_a_check():
    without = set(catalog.QUERIES) - set(catalog.SQL)
    assert without == {"S-09_signature"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
