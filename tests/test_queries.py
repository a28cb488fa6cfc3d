"""Every core query with SQL gives the rows of its SQL; the others run with stable columns."""

import pytest
from compare import DATA, differences

from sarraf.plans import registry

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, name, SMALL, registry.QUERIES, registry.SQL) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    frame = registry.QUERIES[name](spark, str(SMALL))
    assert frame.count() >= 0 and frame.columns


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
