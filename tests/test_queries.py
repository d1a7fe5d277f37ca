"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
import check
from suite.registry import QUERIES, TWINS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(TWINS) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in result.collect()]
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert check.plain(rows, result.columns) == check.plain(cursor.fetchall(), columns)
