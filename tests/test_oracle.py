"""Registered queries against their check SQL on the smallest tables."""

import math
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_value(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_matches_check_sql(spark, con, name):
    got = _rows(entry.queries()[name](spark, SF).toPandas())
    want = _rows(con.execute(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 35
