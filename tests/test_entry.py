"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if entry.queries()[n].__module__.startswith("quillspark.plans")]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    mine = entry.queries()[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    rows = [tuple(r[names.index(c)] for c in columns) for r in theirs.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in mine.collect()))) == sorted(map(repr, rows))


def test_entry(spark):
    assert entry.entry(spark).count() == 10
