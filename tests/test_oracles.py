"""Every registered query with an oracle equals DuckDB on sf0.001
(row count, column names and values at 6 decimals)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodgelens.sources.tables import TABLES

SLOW = {"ngram_counts", "detect_language"}


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


KEYS = sorted(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    rel = con.sql(entry.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    s = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    dcols = rel.columns
    d = sorted(tuple(_norm(r[dcols.index(c)]) for c in cols) for r in rel.fetchall())
    assert s == d


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "borough"
    assert df.count() == 5
