"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(names).collect())
    result = duck.execute(SQL[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(str(r[columns.index(n)]) for n in names) for r in result.fetchall())
    assert got == want


def test_every_query_is_named_once():
    assert set(SQL) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
