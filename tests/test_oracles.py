"""Every query with SQL gives DuckDB's rows; the others are compared with plain versions elsewhere."""

from __future__ import annotations

import pytest

from test_models import COVERED
from wavefold import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, duck, same):
    if name not in plans.ORACLES:
        assert name in COVERED, "neither SQL nor a plain version"
        return
    same(plans.QUERIES[name](spark, sf), duck.sql(plans.ORACLES[name]))


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
