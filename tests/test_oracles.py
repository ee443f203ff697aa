"""Every query with an SQL equivalent, row for row, on the small tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, db, name):
    rows = entry.queries()[name](spark, sf).toPandas()
    verdict = compare(rows, db.execute(SQL[name]).df())
    assert verdict.startswith("ok"), verdict


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
