"""Sides of a join that grow with the input are neither broadcast nor made by one task, whatever their compressed size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import contracts as C
from cairnfield.operators import origins as O
from cairnfield.operators import panel as P
from cairnfield.operators import scores as S
from cairnfield.plans.catalog import QUERIES
from cairnfield.sources import work


def ran(df):
    """The plan of ``df`` as it was run, after Spark has seen the sizes."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture()
def panel(spark):
    grid = spark.range(1, 9).select(F.col("id").alias("unit"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"), F.lit(0).cast("long").alias("c_id"))
    facts = spark.range(1, 9).select(F.lit(2).alias("month_id"), F.col("id").alias("unit"), F.lit(1.0).alias("lr_sb")).groupBy("month_id", "unit").agg(F.max("lr_sb").alias("lr_sb"))
    return P.densify(facts, grid, 1, 4, ["lr_sb"])


def test_the_facts_of_a_panel_are_not_broadcast(panel):
    rows, plan = ran(panel)
    assert len(rows) == 32 and sum(r["lr_sb"] for r in rows) == 8
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_cells_are_dealt_out_before_their_months_are_made(panel):
    assert "REPARTITION_BY_NUM" in ran(panel)[1]


def test_the_truth_of_a_store_is_not_broadcast(spark, panel):
    truth = panel.select("month_id", "unit", F.lit("sb").alias("target"), F.col("lr_sb").alias("y"))
    store = truth.groupBy("month_id", "unit", "target").agg(F.lit(1.0).alias("x"))
    rows, plan = ran(O.with_truth(store, truth, "error"))
    assert len(rows) == 32
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["collapse_point", "compose_gates", "samples_roundtrip", "prediction_health"])
def test_queries_over_the_store_broadcast_their_origins_only(spark, sf_dir, name):
    _, plan = ran(QUERIES[name](spark, sf_dir))
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "SortMergeJoin" in line]
    assert sum("SortMergeJoin" in line for line in joins) >= 1
    assert sum("BroadcastHashJoin" in line for line in joins) <= 1  # the months of the origins


@pytest.mark.parametrize("name", ["fss_scales", "matched_threshold", "sharpness_of_draws"])
def test_cells_made_once_broadcast_their_origins_only(spark, sf_dir, name, monkeypatch):
    plans, made = [], work.table
    monkeypatch.setattr(work, "table", lambda df, *rest: plans.append(ran(df)[1]) or made(df, *rest))
    _, last = ran(QUERIES[name](spark, sf_dir))
    assert len(plans) == 1  # the cells; whatever follows reads their table
    assert plans[0].count("SortMergeJoin") >= 2 and plans[0].count("BroadcastHashJoin") <= 1
    if name == "fss_scales":  # the places of the cells and the sums of their boxes
        assert last.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in last


def test_repeated_keys_are_counted_in_all_partitions(spark):
    df = spark.range(100).select((F.col("id") % 97).alias("unit"), F.lit(1).alias("month_id"))
    rows, plan = ran(C.duplicate_examples(df, ["month_id", "unit"]))
    assert [(r["unit"], r["count"]) for r in rows] == [(0, 2), (1, 2), (2, 2)]
    assert "REPARTITION_BY_NUM" in plan


def test_rank_correlation_computes_its_cells_once(spark):
    cells = spark.range(40).select(F.lit("A").alias("arm"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("ey"))
    rows, plan = ran(S.spearman_positive(cells, ["arm"]))
    assert rows[0]["n"] == 34
    assert "Range (" not in plan
