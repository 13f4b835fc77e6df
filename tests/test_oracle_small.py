"""Every query with an oracle SQL matches DuckDB on the smallest data."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SQL = oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (round(v, 6) or 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET memory_limit = '4GB'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_every_query_registered_has_a_callable():
    qs = queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, con, key):
    df = queries()[key](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[key])
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want
