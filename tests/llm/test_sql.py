from __future__ import annotations

import pytest

from oracle import differences, duck
from tradeloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, medium, name):
    assert differences(spark, medium, QUERIES[name], ORACLES[name], duck(medium)) is None
