"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from cairnfield.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    ran = duck.execute(ORACLES[name])
    columns = [c[0] for c in ran.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(columns, ran.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0
