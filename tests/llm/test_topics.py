"""Topics are fitted to all rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cairnfield.llm import mixing


def corpus(spark, n):
    rng = random.Random(4)
    kinds = [[f"{x}{i}" for i in range(30)] for x in ("tree", "coin", "ship")]
    rows = [(i, " ".join(rng.choices(kinds[i % 3], k=40)), ("en", "de")[i % 2], "a", 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_topics_are_fitted_to_all_rows(spark):
    """The language means are those of every row, of rows without an id too; the old ones came from 2,000 rows."""
    df = corpus(spark, 4_500).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    fitted = mixing.fit_topics(df, "text")
    rows = df.collect()
    for lang in ("en", "de"):
        want = np.mean([mixing.vector(r["text"]) for r in rows if r["lang"] == lang], axis=0)
        assert np.allclose(fitted.means[lang], want, atol=1 / mixing.SCALE)


def test_topics_separate_kinds_and_do_not_depend_on_partitions(spark):
    df = corpus(spark, 900)
    one, two = (mixing.fit_topics(x, "text") for x in (df.coalesce(1), df.repartition(7)))
    assert one.centres.tolist() == two.centres.tolist()
    named = {(r["doc_id"] % 3, r["topic"]) for r in mixing.weigh(df).collect()}
    assert len({t for _, t in named}) == len(named)  # no topic holds two kinds


def test_one_reading_of_the_texts_and_a_second_one_name_the_same_topics(spark):
    df = corpus(spark, 300)
    fitted = mixing.fit_topics(df, "text")
    by_id = {r["doc_id"]: r["topic"] for r in mixing.weigh(df).collect()}
    assert all(by_id[r["doc_id"]] == r["t"] for r in mixing.with_topic(df, "text", fitted, "t").collect())
