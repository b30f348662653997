"""Corpus queries that have SQL against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

from cairnfield.llm import registry


def test_corpus_queries_agree_with_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf_dir)
        ran = con.execute(sql)
        columns = [c[0] for c in ran.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, ran.fetchall()))


def test_every_dealt_operator_and_the_pipeline_are_registered():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
