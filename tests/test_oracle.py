"""Every market-analytics query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from marketgrid.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""
