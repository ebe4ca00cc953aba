"""Driver contract and the SQL oracle at the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from hookline.sources.tables import TABLES


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "url_length" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


ORACLE = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    a = sorted(repr(tuple(_canon(r[c]) for c in order)) for r in df.collect())
    idx = [ocols.index(c) for c in order]
    b = sorted(repr(tuple(_canon(r[i]) for i in idx)) for r in cur.fetchall())
    assert a == b
