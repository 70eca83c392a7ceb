import pytest
from conftest_sql import compare

from millrace.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(catalog.QUERIES[name], catalog.ORACLES[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
