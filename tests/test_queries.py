import pytest
from conftest import SF, duck, same

from waymark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, name):
    out = registry.QUERIES[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns)
    same(out, duck(), registry.ORACLES[name], 6)
