"""Steps that failed on larger tables, held against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perceptra import catalog
from perceptra.operators import evaluate, learn, trees
from perceptra.plans import evaluation

from .oracle import SMALL, agree, connect


@pytest.fixture(scope="module")
def told_apart(spark):
    """Points whose labels kernels tell apart nearly without error."""
    x = np.random.default_rng(0).normal(0, 0.25, (30_000, 2))
    return spark.createDataFrame(pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "label": (x[:, 1] > 0.2 * np.sin(2 * np.pi * x[:, 0])).astype(int)}))


def test_relevance_vectors_of_labels_told_apart(told_apart):
    model = learn.fit_rvm(told_apart)
    assert 0 < len(model.weights) <= 40 and np.isfinite(model.weights).all()
    assert model.predict(told_apart).where("(p > 0.5) = (label = 1)").count() >= 0.995 * told_apart.count()


def test_weights_go_to_the_mode(told_apart):
    model, rows = learn.fit_rvm(told_apart, centres=10, rounds=1, prune=np.inf), told_apart.toPandas()
    d2 = (rows.x0.to_numpy()[:, None] - model.centres[:, 0]) ** 2 + (rows.x1.to_numpy()[:, None] - model.centres[:, 1]) ** 2
    phi = np.exp(-d2 / model.width)
    phi[phi <= 1e-3] = 0
    p = 1 / (1 + np.exp(-phi @ model.weights))
    assert len(model.weights) == 10
    assert np.abs(phi.T @ (rows.label - p) - model.weights).max() < 1e-2


@pytest.mark.parametrize("rows", [trees.MODEL_ROWS, 0])
def test_coloured_descent_writes_no_margins(spark, monkeypatch, rows):
    written, store = [], learn.stored
    monkeypatch.setattr(learn, "MODEL_ROWS", rows)
    monkeypatch.setattr(learn, "stored", lambda df: written.append(sorted(df.columns)) or store(df))
    found = catalog.QUERIES["kernel_map_coloured"](spark, SMALL)
    agree(found, connect(), catalog.ORACLES["kernel_map_coloured"])
    assert ("f" in sum(written, [])) == (rows == 0)


def test_coloured_descent_over_nothing(spark):
    rows = evaluation.free(spark, SMALL).where("false")
    assert learn.coloured_map(rows, ["scan_id", "hit_idx", "sample"], 2.0, 2.0).collect() == []


def test_a_small_table_is_paired_by_many_tasks(spark):
    d, g = (side(spark, SMALL).drop("kind").coalesce(1) for side in (evaluation.detections, evaluation.ground_truth))
    met = evaluate.pairs(d, g, ["frame"])
    assert "BroadcastHashJoin" in met._jdf.queryExecution().toString()
    tasks = [r.n for r in met.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 8 and max(tasks) < sum(tasks) / 2
