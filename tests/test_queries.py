"""Every named query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from passagekit.catalog.queries import QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = driver.queries()[name](spark, FOLDER)
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert rows.count() > 0
    else:
        assert differences(rows, duck.sql(sql)) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 40
