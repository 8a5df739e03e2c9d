"""Every registered query of the library against its SQL, or at least runnable."""

import pytest

from perceptra import catalog

from .oracle import SMALL, agree, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_gives_the_same_rows(spark, con, name):
    agree(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name])


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
