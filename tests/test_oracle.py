import pytest

import __spark_entry__ as entry
from runlens.plans.oracles import ORACLES
from runlens.plans.queries import QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
