import pytest
from compare import duck_rows, spark_rows

from kumiki.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, data)) == duck_rows(duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
