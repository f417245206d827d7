"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from quillon.plans.registry import ORACLE_SQL, QUERIES

TABLES = "events documents pages conversations embeddings labels benchmark".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    return str(round(float(value), 9)) if isinstance(value, int | float) or hasattr(value, "dtype") else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


def test_every_twin_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
