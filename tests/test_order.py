"""Running sums, ranks and quantiles against numpy, and the error function against the library's."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.functions.scalars import erfc, log_normal_cdf
from cairnfield.operators import inference as I
from cairnfield.operators import order
from cairnfield.operators import verdicts as V

VALUES = [0.0, -0.0, 1.0, 1.0 + 1e-12, 1.5, -1.5, 1e-300, -1e-300, 5e-324, 1e300, float("inf"), float("-inf"), 3.0, 3.0, 1e6 + 0.25, 1e6 + 0.5, 2.0, 1023.0, 1024.0]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [("odd", v) for v in VALUES]
    out += [("near", 1e6 + float(x) * 1e-7) for x in rng.random(300)] + [("ties", float(x)) for x in rng.integers(-3, 4, 400)] + [("wide", float(x)) for x in rng.lognormal(0, 6, 500)] + [("one", 7.0)]
    return out


def test_buckets_rise_with_the_numbers(spark):
    values = sorted({*VALUES, *np.random.default_rng(2).lognormal(0, 40, 500).tolist(), *(-np.random.default_rng(3).lognormal(0, 40, 500)).tolist()})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double").select("v", order.bucket(F.col("v")).alias("b")).orderBy("v").select("b").collect()]
    assert got == sorted(got) and got[0] < got[-1]
    assert spark.range(1).select(order.bucket(F.lit(None))).first()[0] < got[0]


def test_running_sums_and_ranks(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    ties = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for falling in (False, True):
        for r in order.before(ties, ["g"], "v", ["n"], falling).collect():
            mine = [v for g, v in rows if g == r["g"]]
            assert r["n_before"] == sum(v > r["v"] if falling else v < r["v"] for v in mine)
    for r in order.ranks(df, ["g"], "v").collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert r["rank"] == sum(v < r["v"] for v in mine) + (sum(v == r["v"] for v in mine) + 1) / 2


def test_quantiles_are_exact(spark, rows):
    df = spark.createDataFrame([*rows, ("none", None), ("ties", None)], "g string, v double").where("abs(v) < 1e301 or v is null")
    levels = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    asked = {k: (F.col("v"), q) for k, q in levels.items()} | {"half": (F.col("v") / 2, 0.5), "large": (F.when(F.col("v") > 1, F.col("v")), 0.25)}
    got = {r["g"]: r for r in order.with_quantiles(df.groupBy("g").count(), df, ["g"], asked).collect()}
    assert got["none"]["a"] is None and got["one"]["large"] == 7.0
    for g in ("odd", "near", "ties", "wide", "one"):
        mine = np.array([v for h, v in rows if h == g and abs(v) < 1e301])
        for k, q in levels.items():
            assert got[g][k] == pytest.approx(np.quantile(mine, q), rel=1e-12, abs=1e-300)
        assert got[g]["half"] == pytest.approx(np.median(mine) / 2, rel=1e-12)
        assert g == "one" or got[g]["large"] == pytest.approx(np.quantile(mine[mine > 1], 0.25), rel=1e-12)
    assert order.quantiles(df.limit(0), ["g"], asked).count() == 0


def test_no_window_over_a_whole_group_of_values(spark, rows):
    """Every sort of values is dealt by step; only counts by step are summed over a group."""
    df = spark.createDataFrame(rows, "g string, v double")
    for plan in (order.quantiles(df, ["g"], {"q": (F.col("v"), 0.5)}), order.before(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v", ["n"])):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        sorts = [w for w in re.findall(r"windowspecdefinition\(.*?\)", text) if re.search(r"\b_?v#\d+ (ASC|DESC)", w)]
        assert "percentile(" not in text and sorts and all("_step" in w for w in sorts)


def test_error_function(spark):
    x = [-8.0, -3.0, -1.0, -1e-9, 0.0, 1e-12, 0.3, 1.0, 2.5, 2.999999, 3.0, 4.5, 10.0, 26.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", erfc(F.col("x")).alias("e"), log_normal_cdf(F.col("x")).alias("l"), log_normal_cdf(-10 * F.col("x")).alias("t")).collect()
    for r in got:
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=2e-10, abs=1e-300)
        if r["x"] > -5:
            assert r["l"] == pytest.approx(math.log(math.erfc(-r["x"] / math.sqrt(2)) / 2), rel=1e-9, abs=1e-15)
    deep = {r["x"]: r["t"] for r in got}
    assert deep[26.0] == pytest.approx(-(260**2) / 2 - math.log(260 * math.sqrt(2 * math.pi)) + math.log1p(-1 / 260**2), rel=1e-9)
    assert spark.range(1).select(log_normal_cdf(F.lit(float("nan")))).first()[0] is None


def test_iid_replicates_are_weighted_sums_of_whole_groups(spark):
    rng = np.random.default_rng(4)
    d = [("x" if i % 3 else "y", i, float(rng.normal(0.1, 1))) for i in range(300)]
    df = spark.createDataFrame(d, "g string, unit long, d double")
    a = {r["g"]: r for r in I.iid_bootstrap(df, ["g"], key=["unit"], replicates=1_000, level=0.9, seed="s").collect()}
    b = {r["g"]: r for r in I.iid_bootstrap(df.repartition(9), ["g"], key=["unit"], replicates=1_000, level=0.9, seed="s").collect()}
    for g in ("x", "y"):
        mine = np.array([v for h, _, v in d if h == g])
        assert a[g]["low"] == pytest.approx(b[g]["low"], abs=1e-12) and a[g]["n"] == len(mine) and a[g]["mean"] == pytest.approx(mine.mean())
        half = 1.645 * mine.std() / math.sqrt(len(mine))
        assert (a[g]["high"] - a[g]["low"]) / 2 == pytest.approx(half, rel=0.15)
    counts = I.poisson_weights()
    assert counts.mean() == pytest.approx(1, abs=1e-4) and counts.var() == pytest.approx(1, abs=2e-3) and (counts == 0).mean() == pytest.approx(math.exp(-1), abs=1e-4)


def test_a_tail_without_a_fit_is_null(spark):
    one = V.pwm_fit(spark.createDataFrame([("t", 2.0)], "target string, v double"), ["target"]).first()
    flat = V.pwm_fit(spark.createDataFrame([("t", 1.0)] * 5 + [("t", 1.0 + 1e-15)], "target string, v double"), ["target"]).first()
    assert (one["m"], one["gamma"], one["sigma"]) == (1, None, None) and flat["m"] == 6
