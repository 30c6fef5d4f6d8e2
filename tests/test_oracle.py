"""Every registered query with a SQL twin gives the twin's rows."""

import math
import os

import duckdb
import pytest

import paddock.plans  # noqa: F401
from paddock.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE_SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in found.description], found.fetchall())
