"""Every training-data query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from quillon.llm.queries import ORACLE_SQL, QUERIES


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 9)) if isinstance(value, int | float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())
