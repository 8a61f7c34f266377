"""Every query with SQL against DuckDB on the smallest tables; those of the training-data subpackage only if it is there."""

from collections import Counter
from pathlib import Path

import pytest

from tools.parity import norm

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_parity(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cur = duck.execute(entry.oracle_sql()[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    key = lambda cols: [cols.index(c) for c in sorted(cols)]
    got = [tuple(r) for r in df.collect()]
    assert Counter(tuple(norm(r[i]) for i in key(df.columns)) for r in got) == Counter(tuple(norm(r[i]) for i in key(names)) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
