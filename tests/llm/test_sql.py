import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from fixtures import SF
from oracle import assert_same

from placeweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
