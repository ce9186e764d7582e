"""Every named query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_points
from pulsecart.plans import all_queries, all_sql
from oracle import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert all_sql().keys() == all_queries().keys()
    assert entry_points.queries().keys() >= all_queries().keys()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, name):
    check(entry_points.queries()[name](spark, FOLDER), db, entry_points.oracle_sql()[name])


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert sorted(r["loghour"] for r in rows) == [f"{h:02d}" for h in range(24)]
