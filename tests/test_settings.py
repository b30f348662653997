"""The settings contract by hand, and files in order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import settings as S
from cairnfield.sources import readers, sinks

GOOD = {"int": "3", "number": "0.5", "flag": "true", "list": "[1, 2, 3]", "map": "{}", "text": "a"}


def run_of(spark, **changes):
    values = {r.field: r.choices[0] if r.choices else GOOD[r.kind] for r in S.rules()} | changes
    rows = [("r", k, v) for k, v in values.items() if v != "absent"]
    return {(r["field"], r["violation"]) for r in S.violations(spark.createDataFrame(rows, "run string, key string, value string"), S.rules()).collect()}


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({}, set()),
        ({"run_type": "absent", "loss_reg": None, "ss_k": None, "sweep": "absent"}, {("run_type", "missing"), ("loss_reg", "missing")}),
        ({"dropout_rate": "1.5", "learning_rate": "0", "qs99_tau": "1", "weight_decay": "0"}, {("dropout_rate", "range"), ("learning_rate", "range"), ("qs99_tau", "range")}),
        ({"height": "x", "sweep": "maybe", "steps": "1", "derivations": "[]"}, {("height", "kind"), ("sweep", "kind"), ("steps", "kind"), ("derivations", "kind"), ("time_steps", "count")}),
        ({"run_type": "train", "time_steps": "4", "typo": "1"}, {("run_type", "choice"), ("time_steps", "count"), ("typo", "unknown")}),
        ({"loss_reg": "tobit", "loss_reg_sigma": "absent"}, {("loss_reg_sigma", "missing")}),
        ({"forecast_composition": "threshold_gate", "gate_threshold": None}, {("gate_threshold", "missing")}),
    ],
)
def test_violations(spark, changes, want):
    assert len(S.rules()) == 89 and run_of(spark, **changes) == want


def test_files_follow_each_other_and_sorted_ones_are_not_dealt_again(spark, tmp_path):
    df = spark.range(1_000).select((F.col("id") % 37).cast("int").alias("month_id"), ((F.col("id") * 7919) % 1_000).alias("unit")).repartition(6)
    assert not sinks.ascending(df, ["month_id", "unit"])
    for name, rows in (("a", df), ("b", df.repartitionByRange(5, "month_id"))):
        if name == "b":
            assert sinks.ascending(rows, ["month_id", "unit"])
        sinks.write_ordered(rows, str(tmp_path / name), ["month_id", "unit"])
        got = readers.file_order(spark, str(tmp_path / name)).orderBy("position").collect()
        assert [r["position"] for r in got] == list(range(1_000)) and [(r["month_id"], r["unit"]) for r in got] == sorted((r["month_id"], r["unit"]) for r in got)
    sinks.write_ordered(df.limit(0), str(tmp_path / "none"), ["month_id"])
    assert readers.file_order(spark, str(tmp_path / "none")).count() == 0
