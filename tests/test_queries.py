"""Every query that SQL can express, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from reprolens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


def same(df, con, sql):
    c = con.execute(sql)
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(n)]) for n in order) for r in c.fetchall())
    got = sorted(tuple(_plain(r[n]) for n in order) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
