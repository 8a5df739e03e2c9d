"""Running sums of ranges against sums row by row, and what rests on them."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from perceptra.operators import detect, evaluate, raymodel, running, sampling

SCHEMA = "g string, at double, id long, w long, _v int"


def hot_rows():
    """A group with two thirds of all rows, a null group, nulls and ties in the order."""
    r = random.Random(3)
    pick = lambda: r.choice(["hot"] * 4 + ["b", None])
    return [(pick(), r.choice([None, 5.0, r.uniform(0, 9)]), n, r.randrange(9), 7) for n in range(2000)]


@pytest.mark.parametrize("descending", [False, True])
def test_sums_of_ranges(spark, descending):
    rows = hot_rows()
    found = running.running_sums(spark.createDataFrame(rows, SCHEMA), ["g"], ["at", "id"], {"run": F.col("w"), "n": F.lit(1)}, descending)
    assert found.columns == ["g", "at", "id", "w", "_v", "run", "n", "run_total", "n_total"]
    got = {r.id: (r.run, r.n, r.run_total, r.n_total) for r in found.collect()}
    wanted = {}
    for g in {x[0] for x in rows}:
        group = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0.0, x[2]), reverse=descending)
        runs = list(accumulate(x[3] for x in group))
        wanted |= {x[2]: (run, n, runs[-1], len(group)) for n, (x, run) in enumerate(zip(group, runs, strict=True), 1)}
    assert got == wanted


def test_groups_joined_by_shuffle_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "BROADCAST_GROUPS", 0)
    rows = spark.createDataFrame(hot_rows(), SCHEMA)
    last = running.running_sums(rows, ["g"], ["at", "id"], {"run": F.col("w")}).where("run = run_total").groupBy("g").agg(F.max("run").alias("s"))
    assert sorted(map(str, last.collect())) == sorted(map(str, rows.groupBy("g").agg(F.sum("w").alias("s")).collect()))
    assert running.running_sums(rows.where("false"), ["g"], ["at"], {"run": F.col("w")}).count() == 0


def test_no_window_takes_a_whole_group(spark):
    rows = spark.createDataFrame(hot_rows(), SCHEMA)
    curve = evaluate.precision_recall(rows.selectExpr("g", "w > 4 AS t", "at AS score").withColumn("truth", F.col("t").cast("int")), ["g"])
    for df in (curve, sampling.systematic(rows, ["g"], "id", "w", 9), sampling.balanced(rows, "g", "id"), sampling.stride(rows, ["g"], ["at", "id"], 3)):
        p = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in p.splitlines() if "Window [" in line]
        assert windows and all("_range" in line or "_total" in line for line in windows)  # totals are of one row a range


def test_bearing_cells_lose_no_ray(spark):
    r = random.Random(5)
    hits = spark.createDataFrame([(n, r.uniform(-30, 30), r.uniform(-30, 30)) for n in range(400)], "hit_idx long, x double, y double")
    poses = spark.createDataFrame([(n, r.uniform(-20, 20) * (n % 4), r.uniform(-20, 20) * (n % 4), r.uniform(-7, 7)) for n in range(60)], "pose_id long, x double, y double, theta double")
    for most in (100, 10):
        seen = raymodel.seen_from(raymodel.observations(hits), poses, 3.0, most)
        got = {(x.pose_id, x.hit_idx) for x in seen.select("pose_id", "hit_idx").collect()}
        m = raymodel.object_frame("theta", "range", "px", "py", "pt", F.col("sin_t"), F.col("cos_t"))
        every = raymodel.observations(hits).crossJoin(poses.select("pose_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("theta").alias("pt")))
        every = every.withColumns(m).where((F.abs("dist_ray") <= 3.0) & F.col("in_front") & (F.col("dist_obs") >= -3.0))
        assert got == {(x.pose_id, x.hit_idx) for x in every.select("pose_id", "hit_idx").collect()} != set()


def test_points_in_boxes_of_any_size(spark):
    import math

    r = random.Random(6)
    points = [(0, n, r.uniform(-60, 60), r.uniform(-60, 60)) for n in range(300)]
    boxes = [(0, n, f"t{n}", r.uniform(-50, 50), r.uniform(-50, 50), *((40.0, 3.0) if n == 7 else (r.uniform(0, 4), r.uniform(0, 4))), r.uniform(-4, 4)) for n in range(30)]
    kinds = "s long, box_id long, type string, cx double, cy double, half_x double, half_y double, heading double"
    found = detect.in_labelled_box(spark.createDataFrame(points, "s long, point_id long, x double, y double"), spark.createDataFrame(boxes, kinds), ["s"], 0.5)

    def label(x, y):
        near = []
        for _, _, kind, cx, cy, hx, hy, t in boxes:
            u, v = abs(math.cos(t) * (x - cx) + math.sin(t) * (y - cy)), abs(math.cos(t) * (y - cy) - math.sin(t) * (x - cx))
            if u <= hx and v <= hy:
                return kind
            near.append(u <= hx + 0.5 and v <= hy + 0.5)
        return "Closeish" if any(near) else "Background"

    assert {x.point_id: x.label for x in found.collect()} == {n: label(x, y) for _, n, x, y in points}
