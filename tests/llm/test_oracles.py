import pytest

from rivulet.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)
