"""The queries of this subpackage that have SQL, against it."""

import pytest
from oracle import both

from tessella.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ours_columns, ours, columns, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
    assert ours_columns == columns and ours == theirs and ours
