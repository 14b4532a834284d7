"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import bag, compare, duck, sql_bag

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        assert compare(got, sql_bag(con, entry.oracle_sql()[name])) is None
    else:
        assert sum(got[1].values()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
