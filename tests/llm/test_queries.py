from __future__ import annotations

import pytest

from wavefold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(name, spark, sf, duck, same):
    same(queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name]))
