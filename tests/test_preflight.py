"""Checks before a run, and the sinks and scans that a query does not reach."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnfield import schema
from cairnfield.functions.registry import EMITS, lookup
from cairnfield.operators import preflight as V
from cairnfield.operators import rollout
from cairnfield.operators.contracts import ContractError, complete_join
from cairnfield.sources import readers, sinks, work


def test_channels_of_an_empty_table_and_of_a_whole_one(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.0)], "month_id int, unit long, lr_sb double")
    found = lambda d, *a: {r["check_name"]: r["violations"] for r in V.channels(d, *a).collect()}
    assert found(df, ["lr_sb"], 2) == {"channels_lacking": 0, "channels_beyond": 0, "months_off": 0}
    assert found(df.limit(0), ["lr_ns"], 2) == {"channels_lacking": 1, "channels_beyond": 1, "months_off": 2}


def test_genome_of_repeated_and_null_settings(spark):
    rows = [("a", "seed", "1"), ("a", "seed", "1"), ("a", "loss_reg", "focal"), ("a", "gamma", None), ("b", None, None)]
    found = {r["run"]: r for r in V.genome(spark.createDataFrame(rows, "run string, key string, value string"), ["seed"], {"focal": ["alpha", "gamma"]}).collect()}
    assert (found["a"]["missing"], found["a"]["unset"], found["a"]["unknown_loss"]) == (["alpha"], ["gamma"], False)
    assert (found["b"]["missing"], found["b"]["unset"], found["b"]["unknown_loss"]) == (["seed"], [], True)


def test_counts_come_back_from_levels(spark):
    df = spark.createDataFrame([(1, 0.0), (2, math.log1p(5.0)), (3, -1e-8), (4, None)], "k int, x double")
    assert [r["c"] for r in df.orderBy("k").select(V.to_counts(F.col("x")).alias("c")).collect()] == [0.0, pytest.approx(5.0), 0.0, None]
    for bad in (float("nan"), float("inf"), -0.1):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "x double").select(V.to_counts(F.col("x"))).collect()


def test_unlike_widths_counts_null_arrays(spark):
    df = spark.createDataFrame([([1.0], [2.0]), ([1.0], []), (None, None), ([], [])], "a array<double>, b array<double>")
    assert V.unlike_widths(df, "a", "b").first().asDict() == {"n": 4, "unlike": 2}


def test_dispersions_heads_and_statics(spark):
    assert V.dispersions(0.5, ["sb", "ns"]) == {"sb": 0.5, "ns": 0.5}
    for given, targets in ((None, ["sb"]), ({"sb": 1.0}, ["sb", "ns"]), ({"sb": float("nan")}, ["sb"]), (1.0, [])):
        with pytest.raises(ContractError):
            V.dispersions(given, targets)
    assert V.heads(["a"], ["b"]) == 1
    for pair in ((["a", "a"], ["b", "c"]), ([], [])):
        with pytest.raises(ContractError):
            V.heads(*pair)
    assert V.static_sources(["r", "c"], ["r"], ["c"]) == {"r": "geometry", "c": "data"}
    with pytest.raises(ContractError):
        V.static_sources(["x"], ["r"], ["c"])


def test_predictions_are_stripped_and_types_restored(spark):
    like = spark.createDataFrame([(1, 1.0, 1)], "unit long, y double, by_y int")
    out = like.select("by_y", F.col("unit").cast("int").alias("unit"), F.lit(0.0).alias("pred_y"), "y", F.lit(1).alias("by_z"))
    assert V.without_predictions(out, like).dtypes == like.dtypes
    with pytest.raises(ContractError):
        V.without_predictions(out.withColumn("other", F.lit(1)), like)


def test_roles(spark):
    df = schema.with_roles(spark.createDataFrame([(1, 2.0, 3)], "unit long, x double, z int"), {"unit": "identity", "x": "feature"})
    assert schema.roles(df) == [(0, "unit", "identity"), (1, "x", "feature"), (2, "z", None)]
    assert schema.without_identities(df).columns == ["x", "z"] and schema.with_role(df, "feature", "identity") == ["unit", "x"]


def test_unknown_heads_and_families_are_errors(spark):
    with pytest.raises(KeyError):
        lookup(EMITS, "gumbel")
    with pytest.raises(ValueError):
        rollout.family_nll(spark.range(1), "gumbel")


def test_truncated_family_leaves_zeros_out(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0, 9.0), (1.0, 1.0, 1.0, 1.0)], "y double, mu double, theta double, w double")
    assert rollout.family_nll(df, "truncated", "w").first()["nll"] == pytest.approx(-math.log(0.25 / 0.5))


def test_latest_artifact_by_its_time_stamp(spark, tmp_path):
    for name, body in (("m_20260101_000000.pt", b"old"), ("m_20260201_000000.pt", b"new")):
        (tmp_path / name).write_bytes(body)
    found = readers.latest_artifact(spark, str(tmp_path)).collect()
    assert [r["stamp"] for r in found] == ["20260201_000000"] and found[0]["length"] == 3
    with pytest.raises(ContractError):
        readers.latest_artifact(spark, str(tmp_path), "0" * 64)


def test_run_paths_and_repeated_keys(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.run_path("/x", "training")
    path = readers.run_path(str(tmp_path), "validation")
    spark.createDataFrame([(1, 1, 0.0), (1, 1, 1.0)], "month_id int, priogrid_id long, sb double").write.parquet(path)
    with pytest.raises(ContractError):
        readers.truth(spark, path, ["sb"])
    assert readers.truth(spark, path, ["sb"], months=[]).count() == 0


def test_joins_that_lose_rows_and_small_reports(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k int, y double")
    with pytest.raises(ContractError):
        complete_join(df, "y")
    assert complete_join(df.where("k = 1"), "y").count() == 1
    assert sinks.markdown(df.orderBy("k")) == "| k | y |\n|---|---|\n| 1 | 1.0 |\n| 2 |  |"


def test_each_origin_in_order_and_tables_by_column(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (1, "b")], "origin int, x string")
    seen = []
    sinks.each_origin(df, lambda o, rows: seen.append((o, rows.columns, rows.count())))
    assert seen == [(1, ["origin", "x"], 2), (3, ["origin", "x"], 1)]
    assert work.table(df, "t", by=["origin"]).columns == ["origin", "x"]
    sinks.each_origin(df.limit(0), lambda *a: pytest.fail("no origin"))
