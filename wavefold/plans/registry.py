"""Registry of queries: each has a name, a Spark callable (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 4):
    """``df`` with the columns rounded, so sums in another order give the same value."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})  # + 0.0: no negative zero
