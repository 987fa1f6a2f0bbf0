import pytest

from rivulet.plans import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert_same(df, catalog.ORACLES[name], sf)
