"""Every registered query against its SQL counterpart on the supplied tables."""

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert differences(frame, db, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
