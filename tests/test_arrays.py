"""Sample-vector functions against numpy and hand-computed values."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.functions import arrays, scalars
from cairnfield.operators import scores


def crps(y, x):
    x = np.sort(np.asarray(x, float))
    m = len(x)
    return np.abs(x - y).mean() - sum((2 * j - m + 1) * v for j, v in enumerate(x)) / m**2


def test_hand_computed_board(spark):
    rows = [("A", "sb", 1, 1, 3.0, [2.0, 4.0]), ("A", "sb", 1, 2, 0.0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "arm string, target string, h int, unit long, y double, samples array<double>").withColumn("gate", F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    cells = scores.cell_scores(df, "gate")
    b = scores.board(cells, ["arm"]).first()
    assert b["crps_all"] == pytest.approx(0.375)
    assert b["mcr_all"] == pytest.approx(7 / 6)
    assert (b["mcr_none"], b["pos_mcr"], b["size_ratio"], b["brier"]) == (0.5, 1.0, 1.0, 0.0)
    assert scores.average_precision(cells, ["arm"]).first()["ap"] == 1.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 50), st.lists(st.floats(0, 50), min_size=2, max_size=9)), min_size=1, max_size=6))
def test_functions_match_numpy(spark, rows):
    df = spark.createDataFrame([(i, float(y), [float(v) for v in s]) for i, (y, s) in enumerate(rows)], "i int, y double, s array<double>")
    s = F.col("s")
    out = df.select("i", arrays.crps(s, F.col("y")).alias("c"), arrays.quantile(s, 0.9).alias("q"), arrays.median(s).alias("m"), arrays.mean(s).alias("a")).orderBy("i").collect()
    for r, (y, x) in zip(out, rows, strict=True):
        assert r["c"] == pytest.approx(crps(y, x), abs=1e-9)
        assert r["q"] == pytest.approx(np.percentile(x, 90), abs=1e-9)
        assert r["m"] == pytest.approx(np.median(x), abs=1e-9)
        assert r["a"] == pytest.approx(np.mean(x), abs=1e-9)


def test_quantile_inversion_and_monotone_quantiles(spark):
    df = spark.createDataFrame([([0.0, 2.0, 5.0, 9.0], [1.0, -1.0, 0.5])], "k array<double>, r array<double>")
    levels = [0.1, 0.4, 0.7, 0.95]
    got, mono = df.select(arrays.quantiles_to_samples(F.col("k"), levels, 8), arrays.monotone_quantiles(F.col("r"))).first()
    assert got == pytest.approx(np.interp(arrays.midpoints(8), levels, [0.0, 2.0, 5.0, 9.0]).tolist())
    soft = np.log1p(np.exp([-1.0, 0.5]))
    assert mono == pytest.approx([1.0, 1 + soft[0], 1 + soft.sum()])


def test_gates_and_links(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.4, 3.0)], "s array<double>, p double, x double")
    r = df.select(
        arrays.threshold_gate(F.col("s"), F.col("p"), 0.5).alias("off"),
        arrays.threshold_gate(F.col("s"), F.col("p"), None).alias("same"),
        scalars.inverse_softplus(scalars.softplus(F.col("x"))).alias("x"),
        scalars.sigmoid(scalars.logit(F.col("p"))).alias("p"),
        scalars.above(F.lit(float("nan")), 0.0).alias("nan"),
    ).first()
    assert r["off"] == [0.0, 0.0] and r["same"] == [1.0, 2.0] and r["nan"] is False
    assert r["x"] == pytest.approx(3.0) and r["p"] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        scalars.compose_mean(F.col("x"), F.col("p"), "soft_gate", 0.5)
    with pytest.raises(ValueError):
        scalars.activate("zinb", [F.col("x")])
