"""Poses summed by a function of a grid's cells, held against plain versions."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perceptra import catalog
from perceptra.operators import detect, scoring

from .oracle import SMALL

RNG = random.Random(12)
CELLS = [(g, i, j, k, RNG.choice([-1.0, 0.0, 2.0, None])) for g in range(7) for i in range(-6, 7) for j in range(-5, 6) for k in (-1, 0, 1, 5) if RNG.random() < 0.2 * g / 6]
#: A class without a name, one that has other cells than the rest, a cell held twice and minus infinity.
MODEL = [(c, i, j, k, -RNG.random(), -RNG.random()) for c in ("a", "b", None) for i in (-2, 0, 1) for j in (-1, 0, 3) for k in (-1, 0, 2)]
MODEL += [("c", 1, 1, 0, -0.5, -math.inf), ("c", 9, 0, 1, -0.5, -0.25), ("a", 0, 0, 0, -1.0, -3.0)]
SHAPE = "model_cls string, i int, j int, k int, log_free double, log_occ double"


def plain(cells, model, reach):
    found = {}
    for g, gi, gj, gk, odds in cells:
        for c, i, j, k, free, occ in model:
            if odds and gk == k and abs(gi - i) <= reach and abs(gj - j) <= reach:
                s, n = found.get((g, gi - i, gj - j, c), (0.0, 0))
                found[g, gi - i, gj - j, c] = s + (occ if odds > 0 else free), n + 1
    return {at: (round(s, 9), n) for at, (s, n) in found.items()}


def as_dict(rows):
    return {(r.scan_id, r.px, r.py, r.model_cls): (round(r.score, 9), r.n) for r in rows}


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(CELLS, "scan_id int, i int, j int, k int, log_odds double")


@pytest.mark.parametrize("reach", [0, 2, 4])
def test_pose_arrays_hold_every_score(spark, grid, reach):
    poses = detect.pose_arrays(grid, spark.createDataFrame(MODEL, SHAPE), ["scan_id"], reach)
    rows = poses.select("scan_id", "px", "py", F.inline("scores"))
    want = plain(CELLS, MODEL, reach)
    assert rows.dtypes == [("scan_id", "int"), ("px", "int"), ("py", "int"), ("model_cls", "string"), ("score", "double"), ("n", "bigint")]
    found = rows.collect()
    assert as_dict(found) == want and len(found) == len(want) > 5 and poses.count() == len({at[:3] for at in want})


def test_pose_arrays_without_a_model(spark, grid):
    assert detect.pose_arrays(grid, spark.createDataFrame([], SHAPE), ["scan_id"], 4).count() == 0


def test_pose_arrays_of_models_that_are_joined(spark, grid, monkeypatch):
    rows = lambda model: as_dict(detect.pose_arrays(grid, spark.createDataFrame(model, SHAPE), ["scan_id"], 4).select("scan_id", "px", "py", F.inline("scores")).collect())
    lacking = [("a", 0, 0, 0, None, -1.0), ("a", 1, 0, 0, -2.0, -1.0)]
    want = plain(CELLS, [(*r[:4], r[4] or 0.0, r[5]) for r in lacking], 4)
    scored = as_dict(detect.pose_scores(grid, spark.createDataFrame(lacking[1:], SHAPE), ["scan_id"], 4).collect())
    found = {(r.scan_id, r.px, r.py): (r.score, r.n) for r in detect.pose_arrays(grid, spark.createDataFrame(lacking, SHAPE), ["scan_id"], 4).select("scan_id", "px", "py", F.inline("scores")).collect()}
    assert scored and {at: n for at, (_, n) in found.items()} == {at[:3]: n for at, (_, n) in want.items()}
    assert any(s is None for s, _ in found.values())  # a pose that met nulls alone
    monkeypatch.setattr(detect, "PAIRS", 100)
    assert rows(MODEL) == plain(CELLS, MODEL, 4)


@pytest.mark.parametrize("most", [1, 50, 3000])
def test_batches_are_summed_in_bounded_parts(most):
    names = [f.split()[0] for f in SHAPE.split(", ")]
    model = pa.table({c: [r[n] for r in MODEL] for n, c in enumerate(names)})
    grids = [[{"gi": i, "gj": j, "k": k, "o": odds > 0} for g, i, j, k, odds in CELLS if g == own and odds] for own in range(7)]
    batch = pa.array([[], *grids], pa.list_(pa.struct({"gi": pa.int32(), "gj": pa.int32(), "k": pa.int32(), "o": pa.bool_()})))[1:]
    poses = detect.pose_sums(model, "model_cls", 4, most=most)(batch).to_pylist()
    assert len(poses) == 7
    found = {(g, p["px"], p["py"], r["model_cls"]): (round(r["score"], 9), r["n"]) for g, of in enumerate(poses) for p in of for r in p["scores"]}
    assert found == plain(CELLS, MODEL, 4)


@pytest.mark.parametrize("few", [None, 2])
def test_softmax_of_an_array_is_that_of_its_group(spark, few):
    rows = [(g, c, RNG.uniform(-900, 900) if g else None) for g in range(5) for c in range(4)] + [(1, 9, None)]
    df = spark.createDataFrame(rows, "g int, c int, score double")
    want = scoring.softmax(df, ["g"]).where(F.lit(True) if few is None else F.col("c") < few).groupBy("g").agg(F.sum("p").alias("p"))
    held = df.groupBy("g").agg(F.collect_list(F.struct("c", "score")).alias("rows"))
    found = held.select("g", scoring.softmax_of("rows", None if few is None else lambda r: r["c"] < few).alias("p"))
    key = lambda of: {r.g: r.p if r.p is None else round(r.p, 12) for r in of.collect()}
    assert key(found) == key(want)


@pytest.mark.parametrize("name", ["pose_scores", "pose_scores_whole", "class_marginal", "class_marginal_whole"])
def test_no_task_gathers_its_poses(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window|Sort \[|Join|Aggregate\(keys=\[[^]]*px#", plan) and plan.count("Exchange hashpartitioning") == 2
