"""Contracts, panels, origins, bootstraps and verdicts: normal, edge and must-fail cases."""

from __future__ import annotations

import math
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnfield.functions.registry import TRANSFORMS, lookup
from cairnfield.operators import contracts as C
from cairnfield.operators import inference as I
from cairnfield.operators import origins as O
from cairnfield.operators import panel as P
from cairnfield.operators import rollout as RO
from cairnfield.operators import scores as S
from cairnfield.operators import verdicts as V
from cairnfield.schema import RunConfig, unit_column
from cairnfield.sources import readers, sinks


def panel(spark, months=6, units=4):
    rows = [(100 + t, u, 87 + (u - 1) // 2, 310 + (u - 1) % 2, float((t * u) % 3)) for t in range(months) for u in range(1, units + 1)]
    return spark.createDataFrame(rows, "month_id int, unit long, row int, col int, lr_sb double")


def test_land_filter_drops_ocean_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, float("nan")), (1, None), (1, -2.0)], "month_id int, unit double")
    assert [r["unit"] for r in P.land_only(df).collect()] == [1.0]


def test_derivation_ignores_nan_and_uses_its_threshold(spark):
    df = spark.createDataFrame([(0.4,), (0.6,), (float("nan"),), (None,)], "src double")
    assert [r["dst"] for r in P.derive_binary(df, {"dst": ("src", 0.5)}).collect()] == [0.0, 1.0, 0.0, 0.0]
    with pytest.raises(C.ContractError):
        P.derive_binary(df, {"dst": ("gone", 0.5)})


def test_log1p_out_of_domain_raises(spark):
    df = spark.createDataFrame([(-1.0,)], "x double")
    with pytest.raises(PySparkException):
        P.scale(df, {"x": "log1p"}).collect()


def test_densify_fills_zero_and_keeps_facts(spark):
    p = panel(spark).where("not (month_id = 102 and unit = 3)")
    grid = panel(spark).select("unit", "row", "col").distinct()
    d = P.densify(p, grid, 100, 107, ["lr_sb"])
    assert d.count() == 8 * 4
    assert d.where("month_id = 102 and unit = 3").first()["lr_sb"] == 0.0
    assert d.where("month_id >= 106").agg(F.sum("lr_sb")).first()[0] == 0.0


def test_contracts_pass_and_fail(spark):
    good = panel(spark)
    C.enforce(C.violations(good, 180, 180, 87, 310))
    with pytest.raises(C.ContractError, match="key_unique"):
        C.enforce(C.violations(good.union(good.limit(1)), 180, 180, 87, 310))
    C.grid_bounds(good, 2, 2, 87, 310)
    with pytest.raises(C.ContractError, match="before the grid"):
        C.grid_bounds(good, 2, 2, 88, 310)
    with pytest.raises(C.ContractError):
        C.forecast_alignment(good, good)
    C.forecast_alignment(good, P.future_scaffold(good, 2))
    C.forecast_alignment(good, P.future_scaffold(good, 1))


def test_headline_and_probability_contracts(spark):
    with pytest.raises(PySparkException):
        C.headline(spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b"]).collect()
    with pytest.raises(C.ContractError):
        C.probability_range(spark.createDataFrame([(1.2,)], "p double"), "p")


def test_parity_within_tolerance(spark):
    a = panel(spark).select("month_id", "unit", "lr_sb")
    b = a.withColumn("lr_sb", F.col("lr_sb") + 1e-7)
    r = C.parity(a, b, ["month_id", "unit"]).first()
    assert (r["mismatches"], r["only_a"], r["only_b"]) == (0, 0, 0)


def test_unit_alias():
    assert unit_column(["month_id", "priogrid_gid"]) == "priogrid_gid"
    for names in (["month_id"], ["priogrid_gid", "priogrid_id"]):
        with pytest.raises(ValueError):
            unit_column(names)


def test_config():
    assert RunConfig().validate().windows == 25
    for bad in ({"train_end": 300}, {"transforms": {"lr_sb": "cube"}}, {"collapse": "geometric_mean"}, {"gate_threshold": 0.5}):
        with pytest.raises(ValueError):
            RunConfig(**bad).validate()
    with pytest.raises(KeyError):
        lookup(TRANSFORMS, "cube")


def test_rolling_origins_and_fan_out(spark):
    assert O.rolling_origins(10, 3, 2) == [5, 6]
    assert O.rolling_origins(3, 3, 2) == []
    table = O.origins_table(spark, [1, 2], 100)
    fan = O.fan_out(panel(spark), table, 3)
    assert fan.groupBy("origin").count().collect()[0]["count"] == 12
    assert {(r["month_id"] - r["m0"] + 1) == r["h"] for r in fan.collect()} == {True}


def test_reference_pools_never_look_ahead(spark):
    t = panel(spark).select("month_id", "unit", F.lit("sb").alias("target"), F.col("lr_sb").alias("y"))
    later = t.withColumn("y", F.when(F.col("month_id") >= 104, 99.0).otherwise(F.col("y")))
    origins = spark.createDataFrame([(104,)], "m0 int")
    draw = lambda truth: sorted(map(tuple, O.climatology(truth, origins, [1, 2], samples=4, seed="s", window=4).select("unit", "h", "samples").collect()), key=str)
    assert draw(t) == draw(later)
    assert {tuple(s) for _, h, s in draw(t) if h == 1} == {tuple(s) for _, h, s in draw(t) if h == 2}


def test_missing_truth_is_an_error_or_zero(spark):
    store = spark.createDataFrame([(1, 1, "sb", [1.0, 2.0])], "month_id int, unit long, target string, samples array<double>")
    none = spark.createDataFrame([], "month_id int, unit long, target string, y double")
    assert O.with_truth(store, none, "zero").first()["y"] == 0.0
    with pytest.raises(PySparkException):
        O.with_truth(store, none, "error").collect()


def test_supervision_dilates_asymmetrically(spark):
    df = spark.createDataFrame([(t, 1, float(t == 5)) for t in range(1, 10)], "month_id int, unit long, x double")
    got = {r["month_id"] for r in P.supervision(df, "x", onset_lead=1, cessation_lag=2).where("supervised = 1").collect()}
    assert got == {4, 5, 6, 7}


def test_anchor_weights_fall_back_to_uniform(spark):
    act = spark.createDataFrame([(1, 0), (2, 0)], "unit long, a long")
    assert [r["p"] for r in P.anchor_weights(act, "a", "power_law", 5).collect()] == [0.5, 0.5]


def test_average_precision_and_auc_group_ties(spark):
    rows = [("m", 1.0, 0.9), ("m", 0.0, 0.9), ("m", 1.0, 0.4), ("m", 0.0, 0.1)]
    df = spark.createDataFrame(rows, "arm string, y double, p double")
    assert S.average_precision(df, ["arm"]).first()["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert S.roc_auc(df, ["arm"]).first()["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    one = df.where("y > 0")
    assert S.average_precision(one, ["arm"]).first()["ap"] is None and S.roc_auc(one, ["arm"]).first()["auc"] is None


def test_spearman_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 1.0, 5.0)], "arm string, y double, ey double")
    got = {r["arm"]: r["rho"] for r in S.spearman_positive(df, ["arm"]).collect()}
    assert got == {"a": 0.0, "b": None}


def test_bootstraps_are_order_free_and_cover_zero_difference(spark):
    d = spark.createDataFrame([("sb", m, u, (-1.0) ** u) for m in range(6) for u in range(20)], "target string, m0 int, unit long, d double")
    kw = dict(block="m0", replicates=50, level=0.9, seed="s")
    a = I.block_bootstrap(d, ["target"], **kw).first()
    assert a == I.block_bootstrap(d.repartition(7).orderBy(F.desc("unit")), ["target"], **kw).first()
    assert (a["mean"], a["low"], a["high"], a["p"], a["blocks"]) == (0.0, 0.0, 0.0, 1.0, 6)
    i = I.iid_bootstrap(d, ["target"], key=["m0", "unit"], replicates=80, level=0.95, seed="s").first()
    assert i["low"] < 0 < i["high"]


def test_signed_ranks_match_by_hand(spark):
    d = spark.createDataFrame([("t", v) for v in (1.0, -2.0, 3.0, 4.0)], "target string, d double")
    r = I.signed_ranks(d, ["target"]).first()
    assert r["w_plus"] == 8.0 and r["z"] == pytest.approx((8 - 5) / np.sqrt(4 * 5 * 9 / 24))


def test_gap_identity_and_verdicts(spark):
    rows = [("A", "sb", 1, 10, 2, 0.3, 1.0, 0.125), ("B", "sb", 1, 10, 2, 0.4, 1.2, 0.2)]
    b = spark.createDataFrame(rows, "arm string, target string, h int, n long, n_event long, crps_all double, crps_events double, crps_none double")
    g = V.gap_decomposition(b, "B").first()
    assert g["gap"] == pytest.approx(-0.1) and g["residual"] == pytest.approx(0, abs=1e-12) and g["skill"] == pytest.approx(0.25)
    df = spark.createDataFrame([(0.9, -0.1, 0.2, True), (0.1, 0.1, 0.2, True), (0.1, 0.1, 0.2, False)], "z double, a double, s double, c boolean")
    assert [r[0] for r in df.select(V.verdict(F.col("z"), F.col("a"), F.col("s"), F.col("c"))).collect()] == ["ARTIFACT", "REAL", "UNDECIDABLE"]
    with pytest.raises(PySparkException):
        df.select(V.verdict(F.lit(float("nan")), F.col("a"), F.col("s"), F.col("c"))).collect()


def test_pwm_recovers_a_pareto_tail(spark):
    rng = np.random.default_rng(1)
    v = 2.0 * (rng.random(4000) ** -0.2 - 1) / 0.2
    r = V.pwm_fit(spark.createDataFrame([("t", float(x)) for x in v], "target string, v double"), ["target"]).first()
    assert r["gamma"] == pytest.approx(0.2, abs=0.08) and r["sigma"] == pytest.approx(2.0, abs=0.25)


def test_roll_out_is_reproducible_and_feeds_back(spark):
    origins = spark.createDataFrame([(104,)], "m0 int")
    kw = dict(steps=3, passes=2, history=4, seed=1)
    a = RO.roll_out(panel(spark), origins, "lr_sb", **kw).orderBy("pass_no", "h", "unit").collect()
    b = RO.roll_out(panel(spark).repartition(5), origins, "lr_sb", **kw).orderBy("pass_no", "h", "unit").collect()
    assert a == b and len(a) == 2 * 3 * 4
    capped = RO.roll_out(panel(spark), origins, "lr_sb", feedback="mean", cap=0.0, **kw).where("h = 3").agg(F.max("mean")).first()[0]
    free = RO.roll_out(panel(spark), origins, "lr_sb", feedback="mean", **kw).where("h = 3").agg(F.max("mean")).first()[0]
    assert capped < free
    with pytest.raises(ValueError):
        RO.roll_out(panel(spark), origins, "lr_sb", feedback="guess", **kw)


def test_family_draws_have_their_moments(spark):
    p = spark.createDataFrame([(i, 3.0, 2.0, 0.25) for i in range(20)], "key long, mu double, theta double, pi double")
    x = np.array([r["samples"] for r in RO.family_draws(p, "zinb", 400, 5).collect()])
    assert x.mean() == pytest.approx(0.75 * 3, abs=0.15)
    assert (np.array([r["samples"] for r in RO.family_draws(p, "truncated", 50, 5).collect()]) >= 1).all()
    # Little mass above zero: the draws keep the mean of the truncated law, they are not all 1.
    rare = spark.createDataFrame([(i, 2.0, 0.01) for i in range(40)], "key long, mu double, theta double")
    x = np.array([r["samples"] for r in RO.family_draws(rare, "truncated", 200, 5).collect()])
    want = 2.0 / -math.expm1(-0.01 * math.log1p(2.0 / 0.01))
    assert x.min() >= 1 and abs(x.mean() / want - 1) < 0.1


def test_store_round_trip(spark, tmp_path):
    rows = [(o, "sb", h, 100 + o + h, u, [1.0, 2.0]) for o in (0, 1) for h in (1, 2) for u in (1, 2)]
    df = spark.createDataFrame(rows, "origin int, target string, h int, month_id int, unit long, samples array<double>")
    sinks.write_predictions(df, str(tmp_path / "store"))
    back = readers.prediction_store(spark, str(tmp_path / "store"), "sb", [2])
    assert back.count() == 4 and readers.sample_width(back) == 2
    assert readers.with_horizon(df.drop("h")).select("h").distinct().count() == 2
    seen = []
    sinks.each_origin(df, lambda o, rows: seen.append((o, rows.count())))
    assert seen == [(0, 4), (1, 4)]


def test_stream_carries_the_last_value(spark, tmp_path):
    from cairnfield.streaming import metrics as M

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, None)], "k string, t long, v double").coalesce(1).write.parquet(src)
    stream = M.carry_forward(M.read_stream(spark, src, "k string, t long, v double"), "k", "t", "v")
    M.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["key"], r["at"]): r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 2.0, ("b", 1): 0.0}


def test_stream_windows_overlap_and_drop_late_rows(spark, tmp_path):
    from cairnfield.streaming import metrics as M

    src, schema = str(tmp_path / "in"), "k string, t timestamp"
    put = lambda *times: spark.createDataFrame([("a", t) for t in times], "k string, t string").selectExpr("k", "cast(t as timestamp) as t").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: M.windowed_counts(M.read_stream(spark, src, schema, 1), "t", "k", "10 minutes", "5 minutes", "5 minutes")
    seen = []
    keep = lambda rows, number: seen.extend((r["start"].strftime("%H:%M"), r["n"]) for r in rows.collect())
    put("2024-01-01 10:01:00", "2024-01-01 10:02:00")
    M.run_each_batch(stream(), keep, str(tmp_path / "cp"))
    assert sorted(seen) == [("09:55", 2), ("10:00", 2)]
    put("2024-01-01 12:00:00")
    M.run_each_batch(stream(), keep, str(tmp_path / "cp"))
    seen.clear()
    put("2024-01-01 10:03:00", "2024-01-01 12:01:00")
    M.run_each_batch(stream(), keep, str(tmp_path / "cp"))
    assert sorted(seen) == [("11:55", 2), ("12:00", 2)]


def test_anchor_windows_hold_their_anchors_on_a_larger_grid(spark, sf_dir, tmp_path):
    from cairnfield.plans import panel_queries as Q
    from cairnfield.plans.base import dense
    from cairnfield.sources import fixtures as X

    spark.range(90).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.withColumn("l_suppkey", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(90))).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = Q.anchor_windows(spark, str(tmp_path)).collect()
    act = P.activity(dense(spark, str(tmp_path)), ["lr_sb"])
    picked = {r["draw"]: r["unit"] for r in P.draw_anchors(P.anchor_weights(act, "lr_sb", "power_law", 1), 8, 5).collect()}
    place = {r["unit"]: (r["row"], r["col"]) for r in X.grid(spark, str(tmp_path)).collect()}
    assert len(picked) == 8 and max(place[u][0] for u in picked.values()) >= 87 + 4
    for draw, unit in picked.items():
        mine = [r for r in rows if r["draw"] == draw]
        assert unit in {r["unit"] for r in mine}
        assert {r["month_id"] for r in mine} == set(range(X.MONTHS[0], X.MONTHS[1] + 1))


def test_box_sums_on_a_large_grid_with_holes(spark):
    rng = np.random.default_rng(4)
    at = [(r, c) for r in range(20) for c in range(17) if (r * 17 + c) % 11]
    rows = [(r, c, float(rng.integers(0, 3))) for r, c in at]
    value = {(r, c): v for r, c, v in rows}
    for n in (1, 4, 5):
        low, high = -(n // 2), n - 1 - n // 2
        got = {(r["row"], r["col"]): r["box"] for r in P.neighbourhood_sum(spark.createDataFrame(rows, "row int, col int, v double"), {"box": F.col("v")}, n).collect()}
        # A cell is sent to the places from low to high around it, so a box reaches the other way round.
        want = {(r, c): sum(value.get((r - i, c - j), 0.0) for i in range(low, high + 1) for j in range(low, high + 1)) / n**2 for r, c in at}
        assert got == pytest.approx(want)


def test_roll_out_deals_units_in_blocks(spark):
    months = [(m, u, float((m * u) % 5)) for m in range(1, 13) for u in range(30)]
    df = spark.createDataFrame(months, "month_id int, unit long, lr_sb double")
    kw = {"steps": 3, "passes": 2, "history": 6, "seed": 1, "feedback": "mean"}
    one = spark.createDataFrame([(8,)], "m0 int")
    whole, parts = (RO.roll_out(df, one, "lr_sb", block_units=b, **kw).select("unit", "pass_no", "h", "mean").orderBy("unit", "pass_no", "h").collect() for b in (None, 7))
    assert whole == parts and len(whole) == 180


def test_passes_run_beside_each_other_give_the_posterior_of_the_roll_out(spark):
    origins = spark.createDataFrame([(103,), (104,)], "m0 int")
    kw = dict(steps=3, passes=3, history=4, seed=1, block_units=3)
    whole = RO.roll_out_samples(panel(spark), origins, "lr_sb", **kw)
    parts = RO.posterior(RO.roll_out(panel(spark), origins, "lr_sb", **kw))
    assert whole.columns == parts.columns
    assert whole.orderBy("m0", "h", "unit").collect() == parts.orderBy("m0", "h", "unit").collect()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "pass_no" not in plan  # one group for all passes, and none after it
