"""Every registered query against its SQL equivalent in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paceline.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
# the corpus operators have tests of their own
QUERIES, SQL = {n: q for n, q in entry.queries().items() if n in catalog.QUERIES}, oracle.all_sql()
# none is left
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: [(v is None, str(v)) for v in r])


def test_coverage():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
