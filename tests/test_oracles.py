"""Every core query against its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.iterdir():
        where = p if p.is_file() else p / "*.parquet"
        c.sql(f"create view {p.stem} as select * from '{where}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    sql = duck.sql(registry.ORACLES[name])
    assert sorted(sql.columns) == columns
    want = sorted(tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.environ.get("NO_DATA") or not DATA.exists() or entry.entry(spark).columns
