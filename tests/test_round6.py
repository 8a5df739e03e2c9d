"""Poses compared in one pass, held against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from perceptra.operators import detect, scoring


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def poses(spark):
    """Poses with gaps, ties and, at some places, two rows."""
    rng = random.Random(4)
    rows = [(g, x, y, c, float(rng.randint(-6, 6))) for g in range(6) for x in range(-4, 5) for y in range(-4, 5) for c in (0, 1) if rng.random() < 0.3]
    return rows, spark.createDataFrame(rows, "scan_id int, px int, py int, model_cls int, log_odds double").repartition("scan_id")


@pytest.mark.parametrize("window", [0, 1, 2])
@pytest.mark.parametrize("keys", [["scan_id"], ["scan_id", "model_cls"]])
def test_local_maxima_of_sparse_poses(poses, window, keys):
    rows, df = poses
    group = lambda r: (r[0], r[3])[: len(keys)]
    rank = lambda r: (-r[4], r[1], r[2])
    inside = lambda r: max(abs(r[1]), abs(r[2])) <= 4 - window
    beaten = lambda a: any(group(a) == group(b) and abs(a[1] - b[1]) <= window and abs(a[2] - b[2]) <= window and rank(b) < rank(a) for b in rows)
    want = sorted(a for a in rows if not beaten(a) and (inside(a) or a[4] >= 0))
    found = detect.local_maxima(df, keys, "log_odds", window, 4)
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == want and want


def test_poses_are_computed_once_and_stay_in_their_task(spark, poses):
    scores = poses[1].withColumn("log_odds", F.col("log_odds") + F.rand(1) * 0)
    found = plan(detect.window_maxima(scores, ["scan_id"], "log_odds", 2))
    assert "Join" not in found and found.count("Exchange hashpartitioning") == 1 and found.count("rand(1)") == 1


def test_log_odds_sort_a_group_once(spark, poses):
    found = plan(scoring.log_odds(poses[1], ["scan_id", "px", "py"], "log_odds"))
    assert found.count("Sort [") == 1 and found.count("Exchange hashpartitioning") == 1
