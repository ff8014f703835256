"""Every registered query runs on sf0.001 and equals its DuckDB oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 2 ** 53 else round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "spearman" in df.columns


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    ref = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in got]) == _rows(cols, ref)
