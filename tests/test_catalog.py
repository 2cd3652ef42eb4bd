import pytest
from oracle import both

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, name):
    columns, ours, other, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert columns == other
    assert ours == theirs


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
