"""Every registered query beside its SQL, over whole tables at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from gradeframe.plans.catalog import QUERIES
from gradeframe.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items()


def test_entry(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""
