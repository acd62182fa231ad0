"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from lodestrand.plans import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert_same(df, registry.ORACLES[name], sf)
    else:
        assert df.count() >= 0
