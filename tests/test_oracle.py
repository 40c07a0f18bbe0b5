"""Every registered query of the engine with SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomwright.plans import queries
from tools.oracle import TABLES, normal


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, con, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns, sorted(columns)) == normal(cursor.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["query_id", "rank", "chunk_id"]
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
