import pytest

import __spark_entry__ as entry
from mnemoframe import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, small):
    same(queries.QUERIES[name], queries.ORACLES[name], spark, small)


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
