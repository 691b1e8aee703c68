"""Every query with SQL gives DuckDB's rows on the small tables."""

import datetime as dt
import math

import duckdb
import pytest

from tidemark.plans import derived, more, narrated, queries, stateful  # noqa: F401
from tidemark.plans.registered import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.sql(SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
