"""Every registered query runs; those with SQL give DuckDB's rows."""

import pytest

from stepfold import plans  # noqa: F401
from stepfold.plans import registry
from tests.agree import assert_agree


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert_agree(df, duck, registry.ORACLES[name])
    else:
        assert df.columns and df.count() > 0
