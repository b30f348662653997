"""Quality and toxicity as queries on held-out rows, and the distributed fit against a plain one."""

from __future__ import annotations

import numpy as np
import pytest

from cairnfield.llm import quality, registry

SF = "/root/testdata/sf0.01"


def labelled(spark, name, label):
    rows = registry.queries()[name](spark, SF).toPandas()
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and rows.score.between(0, 1).all()
    return rows.merge(known[["doc_id", label]].dropna(), on="doc_id").query("held_out")


def test_quality_on_rows_that_it_never_learned_from(spark):
    held = labelled(spark, "op7_quality", "quality")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97 and ((held.score >= 0.5) == (held.predicted == 1)).all()


def test_toxicity_on_rows_that_it_never_learned_from(spark):
    held = labelled(spark, "op9_toxicity", "toxic")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) > 3 and toxic.predicted.mean() >= 0.5 and clean.predicted.mean() < 0.03 and ((held.score >= 0.7) == (held.predicted == 1)).all()


def test_summed_normal_equations_equal_a_plain_solution(spark, sf_dir):
    measured = quality.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    rows = quality.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    model = quality.train(measured, rows)
    both = measured.join(rows, "doc_id").toPandas()
    x, y = np.stack(both.x), both.y.to_numpy()
    assert np.allclose(model.features.mean, x.mean(0)) and np.allclose(model.features.scale, np.sqrt(np.maximum(x.var(0), 1e-8)), rtol=1e-6)
    z = model.features(x)
    assert np.allclose(z @ model.w, z @ np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y), atol=1e-6)
    # Features of two rows multiply to about the Gaussian kernel of their standardised statistics.
    s = np.clip((x - model.features.mean) / model.features.scale, -8, 8)
    random = z[:, 1 + x.shape[1] :]
    kernel = np.exp(-((s[:30, None] - s[None, :30]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(random[:30] @ random[:30].T - kernel).mean() < 0.1
    assert quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5), spark.createDataFrame([], "doc_id long, quality int")).agg({"score": "max"}).first()[0] == pytest.approx(0.5)
