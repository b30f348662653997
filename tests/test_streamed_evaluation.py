"""Evaluation as a stream: a restart in the middle leaves the same store; streamed rankings equal batch ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import scores as S
from cairnfield.streaming import evaluation as E
from cairnfield.streaming import metrics as M


def test_a_restart_leaves_the_same_store(spark, tmp_path):
    origins = spark.createDataFrame([(m,) for m in (101, 102, 103, 104)], "m0 int")
    E.announce(origins, str(tmp_path / "origins"))
    made, fail = [], {103}

    def produce(m0):
        made.append(m0)
        rows = spark.range(5).select(F.lit(m0).alias("m0"), F.col("id").alias("unit"), (F.col("id") * m0).alias("x"))
        return rows.withColumn("x", F.raise_error(F.lit("lost")).cast("long")) if m0 in fail else rows

    args = (spark, str(tmp_path / "origins"), produce, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="lost|failed|terminated"):
        E.evaluate(*args)
    assert len(made) < 5 and len(set(made)) == len(made)
    done = set(made) - fail
    fail.clear()
    E.evaluate(*args)
    assert sorted(set(made)) == [101, 102, 103, 104] and all(made.count(m) == 1 for m in done) and made.count(103) == 2
    rows = E.read_store(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, rows.select("m0", "unit", "x", "origin").collect())) == [(m, u, m * u, m) for m in (101, 102, 103, 104) for u in range(5)]
    # Nothing new, nothing done; one more origin is done alone.
    before = len(made)
    E.evaluate(*args)
    E.announce(spark.createDataFrame([(105,)], "m0 int"), str(tmp_path / "origins"))
    E.evaluate(*args)
    assert made[before:] == [105]


def test_streamed_rankings_equal_batch_ones(spark, tmp_path):
    rows = [("k", i % 2, float(i * i % 17), i % 3 - 1) for i in range(200)] + [("one", 0, 1.0, 1)] * 3
    df = spark.createDataFrame(rows, "key string, lesson int, s double, y int")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = M.read_stream(spark, str(tmp_path / "in"), "key string, lesson int, s double, y int", 1)
    M.run_each_batch(M.score_counts(stream), lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / f"out/number={n}")), str(tmp_path / "check"))
    counts = spark.read.parquet(str(tmp_path / "out")).groupBy("key", "lesson", "s").agg(F.max_by("pos", "batch").alias("pos"), F.max_by("n", "batch").alias("n"))
    by = ["key", "lesson"]
    plain = lambda rows: sorted((r["key"], r["lesson"], r[2] and round(r[2], 12)) for r in rows.collect())
    assert plain(S.precision_of(counts, by)) == plain(S.average_precision(df, by, "s"))
    assert plain(S.auc_of(counts, by)) == plain(S.roc_auc(df, by, "s"))


def test_greedy_members_take_what_improves_the_pool(spark):
    good, same, bad = [0.0, 2.0], [1.0, 1.0], [50.0, 60.0]
    rows = [(a, "t", 1, 1, 1, u, s, 1.0) for a, s in (("a", good), ("b", bad), ("c", same), ("d", bad)) for u in range(4)]
    df = spark.createDataFrame(rows, "arm string, target string, m0 int, h int, month_id int, unit long, samples array<double>, y double")
    assert S.greedy_members(df, ["a", "b", "c", "d"]) == ["a", "c"] and S.greedy_members(df, ["c", "a", "b"]) == ["c"] and S.greedy_members(df, []) == []
