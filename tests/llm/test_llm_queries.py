"""Queries of the llm problems against their SQL where there is one; the others run."""

import pytest
from compare import DATA, differences

from sarraf.llm import registry

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, name, SMALL, registry.QUERIES, registry.SQL) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    frame = registry.QUERIES[name](spark, str(SMALL))
    assert frame.count() > 0
