"""Every query against its DuckDB oracle on the smallest tables, value by value."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return str([plain(i) for i in x]) if isinstance(x, (list, tuple)) else x


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, "" if isinstance(x, (int, float)) else str(x), x if isinstance(x, (int, float)) else 0) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want


def test_oracles_have_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(k for k in set(QUERIES) - set(SQL) if not k.startswith("op") and k != "pipeline"))
def test_learned_queries_repeat(spark, name):
    rows = [sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
