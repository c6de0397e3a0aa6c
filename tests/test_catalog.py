"""Every ready-made query against its SQL counterpart."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TAMIS_TESTDATA", "/root/testdata/sf0.001"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in place)) for r in result.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
