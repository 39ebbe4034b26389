"""The driver contract: entry() smoke, and every registered query against its
DuckDB oracle on the sf0.001 tables (the driver does the same at sf0.01)."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from possum import oracle, registry  # noqa: E402
from possum.sources.testdata import TABLES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["productID", "productName", "customers"]
    assert df.count() == 200


def test_every_query_has_an_oracle():
    assert set(oracle.SQL) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(E.queries()) and set(oracle.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
