"""Every registered query with SQL, side by side with DuckDB on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()


def comparable(x):
    if isinstance(x, float):
        return float(f"{x:.12g}")
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert len({*got.columns}) == len(got.columns)
    got_rows = Counter(tuple(map(comparable, r)) for r in got.select(*columns).collect())
    want_rows = Counter(tuple(map(comparable, r)) for r in want.fetchall())
    assert got_rows == want_rows, (list((got_rows - want_rows).items())[:3], list((want_rows - got_rows).items())[:3])


def test_entry(spark):
    assert entry.entry(spark).count() == 4
