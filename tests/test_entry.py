"""Every query with SQL gives the same rows as DuckDB on the smallest tables, and every other one runs."""

import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = __spark_entry__.oracle_sql()
CORE = sorted(n for n in __spark_entry__.queries() if not n.startswith("p") or n[1:2] in "145a" or n in SQL)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


def _norm(rows):
    def one(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5)
        return tuple(v) if isinstance(v, list) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    got = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = _norm(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall())
    assert _norm([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]) == want


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0
