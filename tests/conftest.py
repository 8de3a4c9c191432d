from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same():
    """Compares a Spark frame with a DuckDB relation as multisets of rows: whole numbers exactly, fractions at nine digits."""
    from decimal import Decimal

    from pyspark.sql.types import IntegralType

    def text(v, whole=False):
        if v is None or v != v:
            return "null"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(text(x) for x in v) + "]"
        if isinstance(v, dict):
            return text(list(v.values()))
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
            return str(v)
        if whole:
            assert v == int(v)
            return str(int(v))
        return f"{float(v) + 0.0:.9g}"

    def compare(df, rel):
        assert sorted(df.columns) == sorted(rel.columns)
        cols, whole = sorted(df.columns), {f.name for f in df.schema if isinstance(f.dataType, IntegralType)}

        def rows(names, values):
            at = [names.index(c) for c in cols]
            return sorted(tuple(text(r[i], c in whole) for i, c in zip(at, cols, strict=True)) for r in values)

        assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())

    return compare
