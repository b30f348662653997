"""Weighted draws of cells by running sums: frequencies, order and blocks."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnfield.functions.registry import ANCHORS
from cairnfield.operators import panel as P


def cells(spark):
    rows = [("a", u, u % 4) for u in range(1, 13)] + [("b", u, 0) for u in range(1, 6)]
    return spark.createDataFrame(rows, "target string, unit long, activity long")


@pytest.mark.parametrize("block", [10_000, 2])
@pytest.mark.parametrize("strategy", sorted(ANCHORS))
def test_cells_are_drawn_by_their_weight(spark, monkeypatch, strategy, block):
    monkeypatch.setattr(P, "BLOCK", block)
    plan = spark.createDataFrame([(0, "a", 2), (1, "b", 2)], "step int, target string, threshold int")
    params = {"alpha": 2.0} if strategy == "power_law" else {}
    got = P.lesson_anchors(cells(spark), plan, strategy, 2, 3_000, 4, **params).collect()
    assert len(got) == 6_000
    weight = {"threshold": {2: 1, 3: 1}, "power_law": {2: 4, 3: 9}, "boltzmann": {2: 2.718281828 ** (-0.25), 3: 1}, "sigmoid": {2: 0.5, 3: 1 / (1 + 2.718281828**-0.5)}}[strategy]
    total = 3 * sum(weight.values())
    seen = Counter(r["unit"] for r in got if r["step"] == 0)
    assert set(seen) <= {u for u in range(1, 13) if u % 4 >= 2}
    for u in seen:
        want = 3_000 * weight[u % 4] / total
        assert abs(seen[u] - want) < 5 * want**0.5
    # Without any weight every cell of the target is alike.
    flat = Counter(r["unit"] for r in got if r["step"] == 1)
    assert set(flat) == set(range(1, 6)) and max(flat.values()) - min(flat.values()) < 200


def test_draws_depend_on_keys_alone(spark):
    plan = spark.createDataFrame([(s, "a", 1) for s in range(5)], "step int, target string, threshold int")
    a = P.lesson_anchors(cells(spark), plan, "threshold", 1, 4, 9)
    b = P.lesson_anchors(cells(spark).repartition(7).orderBy(F.desc("unit")), plan, "threshold", 1, 4, 9)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 20
    assert P.lesson_anchors(cells(spark).limit(0), plan, "threshold", 1, 4, 9).count() == 0
