from pathlib import Path

import duckdb
import pytest

from loomwright.llm import queries
from tools.oracle import TABLES, normal


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, con, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert normal([tuple(r) for r in df.collect()], df.columns, sorted(df.columns)) == normal(cursor.fetchall(), columns, sorted(columns))


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
