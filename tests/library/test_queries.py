"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from tessella import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float | Decimal):
        return round(float(value), 5)
    if isinstance(value, datetime | date):
        return value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    found = registry.QUERIES[name](spark, DATA)
    result = tables.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert not [n for n in registry.QUERIES if n.startswith("op")]
