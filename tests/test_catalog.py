"""Every query with SQL gives the same rows in both engines on the smallest tables."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="session")
def duck(sf_tiny):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_tiny}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_tiny, name):
    got = entry.queries()[name](spark, sf_tiny)
    columns = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    where = [want.columns.index(c) for c in columns]
    assert ordered(got.select(*columns).collect()) == ordered([tuple(r[i] for i in where) for r in want.fetchall()])
