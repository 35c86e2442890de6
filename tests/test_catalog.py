import pytest

from lodestar.plans import catalog, more  # noqa: F401
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count()
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.SQL) <= set(e.oracle_sql())
