import pytest
from oracle import assert_same

from placeweave.plans import boundaries, catalogue, labels, loads, lookups, notes, requests, retrieval, routes, slots, trips  # noqa: F401
from placeweave.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)
