"""Sides of a join that grow with the texts are shuffled, whatever size Spark takes them for."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairnfield.llm import common, components, decontaminate, simhash


def plan(df):
    """The rows of ``df`` and its plan as it was run."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture()
def plans(monkeypatch):
    """The plans of the tables that the corpus operators write, by name."""
    found, write = {}, common.materialize

    def keep(df, name, *rest):
        found.setdefault(name, []).append(plan(df)[1])
        return write(df, name, *rest)

    for module in (decontaminate, simhash, components):
        monkeypatch.setattr(module, "materialize", keep)
    return found


def texts(spark, rng, words):
    made = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(made)] + [(100 + i, t + " end") for i, t in enumerate(made)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_starts_of_windows_are_not_broadcast(spark, plans):
    rng = random.Random(5)
    docs = texts(spark, rng, [f"w{i}" for i in range(400)])
    items = [(i, " ".join(t.split()[10:50])) for i, t in enumerate(r["text"] for r in docs.where("doc_id < 3").collect())]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).where("contaminated")
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1, 2, 100, 101, 102]
    assert "SortMergeJoin" in plans["probes"][0] and "BroadcastHashJoin" not in plans["probes"][0]


def test_sides_that_grow_with_the_texts_are_not_broadcast(spark, plans):
    groups = simhash.similar_groups(texts(spark, random.Random(6), [f"w{i}" for i in range(4_000)])).collect()
    assert len(groups) == 24 and len({r["group"] for r in groups}) == 12
    for name in ("wanted", "similar", "members"):
        assert "SortMergeJoin" in plans[name][0] and "BroadcastHashJoin" not in plans[name][0], name


def test_ends_of_many_links_are_not_broadcast(spark, plans, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 3)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["component"] for r in components.components(links, "a", "b").collect()} == {0}
    assert "SortMergeJoin" in plans["links"][1]


def test_a_table_over_its_bound_is_shuffled(spark):
    left, right = spark.range(40).withColumnRenamed("id", "k"), spark.range(9).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    for bound, join in ((8, "SortMergeJoin"), (9, "BroadcastHashJoin")):
        rows, ran = plan(left.join(common.small(right, bound), "k"))
        assert len(rows) == 9 and join in ran
    rows, ran = plan(common.skewed_join(left, right, "k", 40))
    assert len(rows) == 9 and "SortMergeJoin" in ran
