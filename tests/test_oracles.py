"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest

from oracle import differences, duck
from registry.oracles import ORACLES
from registry.queries import QUERIES


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, connection, name):
    assert differences(spark, small, QUERIES[name], ORACLES[name], connection) is None


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 10
