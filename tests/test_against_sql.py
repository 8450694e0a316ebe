"""The registered queries beside their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    line = compare(spark, con, SF, name, entry.queries()[name], SQL[name])
    assert line.startswith("ok"), line


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "reorder_point" in df.columns
