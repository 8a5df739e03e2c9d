"""Whole jobs on steps that were cut or failed on larger tables, held against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perceptra import catalog
from perceptra.operators import evaluate, learn, matching, raymodel
from perceptra.operators.histogram import Histogram

from .oracle import SMALL


def test_every_row_may_become_a_relevance_vector(spark):
    rng = np.random.default_rng(3)
    near, far = rng.normal(0, 0.2, (3000, 2)), rng.normal(0, 0.05, (40, 2)) + [3.0, 3.0]
    label = np.append(near[:, 1] > 0, np.ones(40)).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"x0": [*near[:, 0], *far[:, 0]], "x1": [*near[:, 1], *far[:, 1]], "label": label}))
    model = learn.fit_rvm(rows, centres=3, rounds=6)
    assert (model.centres > 2).all(1).any() and (model.centres < 2).all(1).any()
    assert set(map(tuple, model.centres)) <= {(r.x0, r.x1) for r in rows.collect()}


def test_the_best_of_all_rows_joins_first(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (700, 2)) * [1.0, 2.0]
    t = (x[:, 1] > np.sin(3 * x[:, 0])).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "label": t}))
    model = learn.fit_rvm(rows, centres=2, rounds=2, prune=np.inf)
    kernel = lambda at: np.exp(-((x[:, None] - at) ** 2).sum(2) / 0.25)
    phi, w = kernel(model.centres[:2]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-phi @ w))
        hess = np.eye(2) + (phi * (p * (1 - p))[:, None]).T @ phi
        w = w + np.linalg.solve(hess, phi.T @ (t - p) - w)
    p = 1 / (1 + np.exp(-phi @ w))
    every, b = kernel(x), p * (1 - p)
    q, beside = every.T @ (t - p), (every * b[:, None]).T @ phi
    s = (every**2).T @ b - (beside @ np.linalg.inv(hess) * beside).sum(1)
    known = (x[:, None] == model.centres[:2]).all(2).any(1)
    gain = np.where(~known & (q * q > s), (q * q / s - 1 - np.log(q * q / s)) / 2, -1)
    assert len(model.centres) > 2 and np.array_equal(model.centres[2], x[gain.argmax()])


def test_copies_of_many_boxes_are_not_broadcast(spark):
    rows = spark.range(40_000).selectExpr("id % 50 AS frame", "id AS box_id", "id * 1D AS x1", "0D AS y1", "id + 1D AS x2", "1D AS y2")
    plan = evaluate.pairs(rows, rows, ["frame"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    few = rows.where("box_id < 500")
    assert evaluate.pairs(few, few, ["frame"]).count() == 500


@pytest.mark.parametrize("places", [4, 10_000])
def test_overlaps_of_touching_boxes(spark, monkeypatch, places):
    rng = np.random.default_rng(5)
    place = np.column_stack([rng.uniform(0, 8, (places, 2)), rng.uniform(0, 4, (places, 2)), rng.uniform(-4, 4, places)])
    place[0, 2:4] = 0
    n, at = 400, rng.uniform(0, 5, (400, 2))
    rows = pd.DataFrame({"frame": rng.integers(0, 3, n), "box_id": range(n), "score": 0.5, "x1": at[:, 0], "y1": at[:, 1], "x2": at[:, 0] + 2, "y2": at[:, 1] + 2})
    rows[["x", "y", "l", "w", "heading"]] = place[rng.integers(0, places, n)]
    boxes = spark.createDataFrame(rows).withColumn("frame", F.when(F.col("box_id") > 2, F.col("frame"))).withColumn("x", F.when(F.col("box_id") != 9, F.col("x")))
    monkeypatch.setattr(evaluate, "AT_ONCE", 1000)
    key = lambda r: (r.frame, r.d_box_id, r.g_box_id)
    found = evaluate.touching_overlaps(boxes, boxes, "frame", 6).collect()
    wanted = evaluate.pairs(boxes, boxes, ["frame"]).withColumn("overlap", F.round(evaluate.ground_overlap("d_", "g_"), 6)).collect()
    assert {key(r): r.overlap for r in found} == {key(r): r.overlap for r in wanted} and len(found) == len(wanted) > 5000


def test_ground_overlaps_join_no_pairs(spark):
    plan = catalog.QUERIES["ground_overlaps"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("held", [0, 10**6])
@pytest.mark.parametrize("measure", ["image", "ground", "solid"])
def test_boxes_of_one_place_are_measured_once(monkeypatch, measure, held):
    rng = np.random.default_rng(6)
    columns = len(matching.PLACE[measure])
    boxes = rng.uniform(1, 3, (80, columns))
    if measure == "image":
        boxes[:, 2:] += boxes[:, :2]
    a, b, pairs, measured = boxes[np.append(rng.integers(0, 20, 600), 70)], boxes, [], matching.measured
    a[5] = np.nan
    want = list(matching.overlapping(a, b, measure, -1, 0.3))
    monkeypatch.setattr(matching, "HELD", held)
    monkeypatch.setattr(matching, "measured", lambda x, *more: pairs.append(len(x)) or measured(x, *more))
    found = list(matching.met_by_place(a, b, measure, 0.3))
    assert [x[0] for x in found] == list(range(601)) and sum(len(x[2]) for x in found) > 1000
    assert all(np.array_equal(r, x[2]) and np.array_equal(share, x[3]) for (_, r, share), x in zip(want, found, strict=True))
    assert held == 0 or sum(pairs) <= 22 * len(b)


def test_first_free_goes_on_to_what_is_left():
    rng = np.random.default_rng(7)
    free, order = rng.random((50, 3000)) < 0.01, rng.permutation(3000)[:2000]
    at = rng.integers(0, 2001, 50)
    want = [next((k for k in range(i, 2000) if free[row, order[k]]), 2000) for row, i in enumerate(at)]
    matching.first_free(free, order, at)
    assert at.tolist() == want


def test_chains_are_walked_over_narrow_rows(spark):
    rng, hist = np.random.default_rng(8), Histogram(-5.0, 5.0, 1.0)
    two = [("c" if rng.random() < 0.5 else "d", p, d, b, a, float(rng.integers(1, 5))) for p in range(3) for d in range(2) for b in (None, 2, 5, 9) for a in (2, 5, 9) if rng.random() < 0.5]
    draws = [(c, chain, step, int(rng.integers(0, 4)), int(rng.integers(0, 2)), float(rng.integers(1, 101)) / 100) for c in "cd" for chain in range(40) for step in range(int(rng.integers(1, 30)))]
    model = spark.createDataFrame(two, "cls string, k_phi int, k_dist int, prev int, bin int, w double")
    d = spark.createDataFrame(draws, "cls string, chain long, step int, k_phi int, k_dist int, u double").withColumn("chain", F.when(F.col("chain") > 0, F.col("chain")))
    walked = lambda most: raymodel.sample_chain(d, model, ["cls"], ["chain"], hist, most)
    want = walked(0)
    assert walked(50_000).dtypes == want.dtypes
    assert "moves" not in walked(50_000)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = walked(50_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, found)) == sorted(map(str, want.collect())) and len(found) == len(draws)
    assert raymodel.sample_chain(d, model.where("false"), ["cls"], ["chain"], hist).where("bin IS NOT NULL").count() == 0
