"""Guards: halting predictions, unequal runs, budgets, hold-out, losses with known answers."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnfield.operators import guards as G
from cairnfield.operators.contracts import ContractError
from cairnfield.sources import readers, sinks


def test_health_grades_magnitudes_and_halts_on_what_is_no_number(spark):
    rows = [("ok", 1.0), ("ok", -100.0), ("warn", -101.0), ("alarm", 501.0), ("halt", 1001.0), ("nan", float("nan")), ("inf", float("-inf")), ("null", None), ("mixed", 3.0), ("mixed", None)]
    found = {r["g"]: r for r in G.prediction_health(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"ok": "ok", "warn": "warn", "alarm": "alarm", "halt": "halt", "nan": "halt", "inf": "halt", "null": "halt", "mixed": "halt"}
    assert found["nan"]["top"] is None and found["mixed"]["top"] == 3.0 and found["ok"]["top"] == 100.0
    with pytest.raises(ContractError):
        G.enforce_health(G.prediction_health(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]))


def test_determinism_sees_moved_missing_and_doubled_keys(spark):
    schema = "g string, k int, v array<double>"
    a = spark.createDataFrame([("x", 1, [1.0]), ("x", 2, [2.0]), ("x", 3, [3.0]), ("y", 1, [1.0])], schema)
    b = spark.createDataFrame([("x", 1, [1.0]), ("x", 2, [2.5]), ("x", 4, [4.0]), ("y", 1, [1.0]), ("y", 1, [1.0])], schema)
    found = {r["g"]: r for r in G.determinism(a, b, ["g", "k"], "v", ["g"]).collect()}
    assert (found["x"]["only_a"], found["x"]["only_b"], found["x"]["differing"], found["x"]["equal"]) == (1, 1, 1, 1)
    assert found["y"]["differing"] == 1 and not found["y"]["same"]
    assert all(r["same"] for r in G.determinism(a, a, ["g", "k"], "v", ["g"]).collect())


def test_budget_of_planned_samples(spark):
    store = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0, 3.0])], "arm string, samples array<double>")
    planned = G.planned_bytes(store, ["arm"])
    assert planned.first()["bytes"] == 20
    G.fits(planned, 20)
    with pytest.raises(ContractError):
        G.fits(planned, 19)
    assert G.fits(planned.limit(0), 0).count() == 0


def test_holdout_drops_the_last_months(spark):
    df = spark.range(10).withColumnRenamed("id", "month_id")
    assert G.holdout(df, 3).agg(F.max("month_id")).first()[0] == 6
    assert G.holdout(df, 0).count() == 10 and G.holdout(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        G.holdout(df, -1)


def test_quantile_loss_of_a_known_vector_and_of_a_wrong_length(spark):
    df = spark.createDataFrame([(1, 2.0, [1.0, 2.0, 4.0])], "g int, y double, knots array<double>")
    assert G.quantile_loss(df, ["g"], [0.1, 0.5, 0.9]).first()["loss"] == pytest.approx((0.1 + 0.0 + 0.2) / 3)
    with pytest.raises(PySparkException):
        G.quantile_loss(df, ["g"], [0.5]).collect()


def test_latent_losses_without_positives_and_with_one(spark):
    soft = lambda x: math.log1p(math.exp(x))
    df = spark.createDataFrame([(0, 0.3, 0.0), (1, 0.3, math.log1p(1.0))], "g int, latent double, target_log double")
    found = {r["g"]: r for r in G.latent_losses(df, ["g"], 1.0).collect()}
    mu = soft(0.3)
    assert found[0]["dense"] == pytest.approx(math.log1p(mu)) and found[0]["truncated"] == 0.0
    p1, p0 = mu / (1 + mu) ** 2, 1 / (1 + mu)
    assert found[1]["dense"] == pytest.approx(-math.log(p1)) and found[1]["truncated"] == pytest.approx(-math.log(p1 / (1 - p0)))
    with pytest.raises(ValueError):
        G.latent_losses(df, ["g"], 0.0)


def test_biases_lead_back_to_their_priors(spark):
    for family in G.BIASES:
        for r in G.initial_bias(spark, family, {"theta": 0.8}).collect():
            back = 1 / (1 + math.exp(-r["raw"])) if r["parameter"] in ("w", "pi") else math.log1p(math.exp(r["raw"]))
            assert back == pytest.approx(r["prior"])
    with pytest.raises(KeyError):
        G.initial_bias(spark, "poisson")


def test_manifest_appends_and_needs_its_settings(spark, tmp_path):
    path = str(tmp_path / "manifest")
    sinks.write_manifest(spark, path, "m_20260101_000000", b"weights", {"steps": 12}, ["steps"])
    sinks.write_manifest(spark, path, "m_20260102_000000", b"others", {"steps": 12}, ["steps"])
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and all(len(r["sha256"]) == 64 for r in rows)
    with pytest.raises(ValueError):
        sinks.write_manifest(spark, path, "m", b"", {}, ["steps"])


def test_records_are_appended(spark, tmp_path):
    path = str(tmp_path / "records")
    one = spark.createDataFrame([(1, 0.5)], "lesson int, loss double")
    sinks.append_records(one, path)
    sinks.append_records(one.withColumn("lesson", F.lit(2)), path)
    assert readers.scoreboards(spark, path, "lesson int, loss double").count() == 2
