"""Every registered engine query against its SQL, on the smallest tables."""

import pytest
from compare import connection, difference

from samplewell.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck.sql(ORACLES[name])) is None
