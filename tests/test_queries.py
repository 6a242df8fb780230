"""Every query of the engine against its SQL, and the others for rows."""

from __future__ import annotations

import pytest

from tests.oracle import SF, database, differences
from tremolite.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(spark, QUERIES[name], SQL[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
