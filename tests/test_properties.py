"""Rays, trees, suppression, matching, learning and streams by property."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from perceptra.operators import detect, evaluate, learn, models, rays, simworld, trees
from perceptra.streaming import counts


def walk(end):
    """Cells of a ray from the origin, step by step."""
    d, n = [abs(x) for x in end], max(map(abs, end))
    cell, error, out = [0, 0, 0], [n] * 3, []
    for _ in range(n):
        out.append(tuple(cell))
        for c in range(3):
            error[c] += 2 * d[c]
            if error[c] >= 2 * n:
                error[c] -= 2 * n
                cell[c] += 1 if end[c] > 0 else -1
    return [*out, tuple(end)]


def test_closed_form_rays_equal_the_walk(spark):
    rng = random.Random(1)
    ends = [tuple(rng.randint(-30, 30) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), (5, 0, 0), (-4, 4, -4)]
    h = spark.createDataFrame([Row(ray=n, x=float(e[0]), y=float(e[1]), z=float(e[2])) for n, e in enumerate(ends)])
    got = {}
    for r in rays.trace(rays.ray_ends(h, 1.0), ["ray"]).collect():
        got.setdefault(r.ray, []).append((r.i, r.j, r.k))
    for n, e in enumerate(ends):
        assert sorted(got[n]) == sorted(walk(e))


def test_budget_keeps_the_hit(spark):
    h = spark.createDataFrame([Row(ray=0, x=9.0, y=0.0, z=0.0)])
    c = rays.trace(rays.ray_ends(h, 1.0), ["ray"], steps=4).collect()
    assert sum(r.free for r in c) == 3 and [(r.i, r.occ) for r in c if r.occ] == [(9, 1)]


def test_mutual_information_of_equal_bits(spark):
    d = spark.createDataFrame([Row(c00=5, c01=0, c10=0, c11=5), Row(c00=3, c01=3, c10=3, c11=3)])
    a, b = (r.mi for r in d.select(models.mutual_information().alias("mi")).collect())
    assert abs(a - math.log(2)) < 1e-12 and abs(b) < 1e-12


def test_spanning_forest_has_the_greatest_weight(spark):
    rng = random.Random(2)
    edges = [Row(g=g, a=a, b=b, mi=float(w)) for g in range(3) for (a, b), w in zip(itertools.combinations(range(12), 2), rng.sample(range(1000), 66), strict=True) if rng.random() < 0.6]
    got = trees.spanning_forest(spark.createDataFrame(edges), ["g"]).groupBy("g").agg(F.sum("mi").alias("w"), F.count("*").alias("n")).collect()
    for r in got:
        root, total, n = list(range(12)), 0, 0

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in sorted((e for e in edges if e.g == r.g), key=lambda e: -e.mi):
            a, b = top(e.a), top(e.b)
            if a != b:
                root[a] = b
                total, n = total + e.mi, n + 1
        assert (r.w, r.n) == (total, n)


def test_greedy_suppression_keeps_distance(spark):
    rng = random.Random(3)
    rows = [Row(scan_id=s, x=rng.uniform(0, 20), y=rng.uniform(0, 20), score=rng.random()) for s in range(4) for _ in range(60)]
    d = detect.greedy_radius(spark.createDataFrame(rows), ["scan_id"], "score", 3.0, "scan_id long, x double, y double, score double").collect()
    for a, b in itertools.combinations(d, 2):
        assert a.scan_id != b.scan_id or math.hypot(a.x - b.x, a.y - b.y) >= 3.0
    for s in range(4):
        assert max(r.score for r in rows if r.scan_id == s) in [r.score for r in d if r.scan_id == s]


def test_matching_is_one_to_one(spark):
    c = spark.createDataFrame([Row(frame=1, d_box_id=d, g_box_id=g, d_score=0.5, overlap=o) for d, g, o in ((1, 1, 0.9), (1, 2, 0.8), (2, 2, 0.6), (3, 2, 0.7), (4, 3, 0.4))])
    m = evaluate.greedy_match(c, ["frame"], 0.5, "frame long, d_box_id long, g_box_id long, d_score double, overlap double").collect()
    assert sorted((r.g_box_id, r.d_box_id) for r in m) == [(1, 1), (2, 3)]


def plain_common_area(a, b):
    """One pair of boxes, clipped corner by corner."""
    def corners(x, y, length, width, heading):
        c, s = math.cos(heading), math.sin(heading)
        return [(x + c * u * length / 2 - s * v * width / 2, y + s * u * length / 2 + c * v * width / 2) for u, v in ((1, 1), (-1, 1), (-1, -1), (1, -1))]

    out, by = corners(*a), corners(*b)
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1], strict=True):
        side, new = [(bx - ax) * (y - ay) - (by_ - ay) * (x - ax) for x, y in out], []
        for n, (p, s) in enumerate(zip(out, side, strict=True)):
            q, t = out[n - 1], side[n - 1]
            if (s >= 0) != (t >= 0):
                new.append((q[0] + t / (t - s) * (p[0] - q[0]), q[1] + t / (t - s) * (p[1] - q[1])))
            if s >= 0:
                new.append(p)
        out = new
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1], strict=True)) / 2


def test_rotated_overlap():
    rng = np.random.default_rng(8)
    a, b = (np.column_stack([rng.uniform(-3, 3, (400, 2)), rng.uniform(0.2, 5, (400, 2)), rng.uniform(-7, 7, 400)]) for _ in range(2))
    assert np.allclose(evaluate.common_area(a, b), [plain_common_area(x, y) for x, y in zip(a, b, strict=True)])
    square, turned, far, none = [0, 0, 2, 2, 0.3], [0, 0, 2, 2, 0.3 + math.pi / 4], [9, 9, 1, 1, 0], [0, 0, 2, np.nan, 0]
    found = evaluate.common_area(np.array([square] * 4, float), np.array([square, turned, far, none], float))
    assert np.allclose(found, [4, 8 * (math.sqrt(2) - 1), 0, np.nan], equal_nan=True)
    assert len(evaluate.common_area(np.empty((0, 5)), np.empty((0, 5)))) == 0


def test_ground_overlaps_query(spark):
    from perceptra import catalog
    from perceptra.plans.evaluation import overlaps

    from .oracle import SMALL

    box = lambda k: (k % 100 * 0.1, k % 37 * 0.1, 4.0, 1.6, k % 7 * 0.4)
    shares = lambda d, g: (lambda i: i / (12.8 - i))(plain_common_area(box(d), box(g)))
    found = {(r.frame, r.d_box_id, r.g_box_id): r.overlap for r in catalog.QUERIES["ground_overlaps"](spark, SMALL).collect()}
    rows = overlaps(spark, SMALL).collect()
    assert len(found) == len(rows) > 0
    assert all(abs(found[r.frame, r.d_box_id, r.g_box_id] - shares(r.d_box_id, r.g_box_id)) < 2e-6 for r in rows)


def test_linear_model_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    y = 1.5 + 2 * x + rng.normal(scale=0.1, size=500)
    d = spark.createDataFrame([Row(x=float(a), y=float(b)) for a, b in zip(x, y, strict=True)])
    m = learn.LinearModel(*learn.gram(d, [F.lit(1.0), F.col("x")], F.col("y")))
    assert np.allclose(m.least_squares(), np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0])
    best = m.maximise()
    assert abs(best.beta - 100) < 20 and best.evidence() > m.evidence()


def test_relevance_vectors_learn_a_boundary(spark):
    d = simworld.toy(spark, "circle", 400, 5)
    model = learn.fit_rvm(d, centres=20, rounds=5, width=0.1)
    right = model.predict(d).agg(F.avg((F.col("p").__gt__(0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.85


def test_worlds_keep_the_middle_empty_and_apart(spark):
    w = simworld.worlds(spark, 5, 8, 1)
    shapes = w.select("world", "shape", "x", "y").distinct().collect()
    for a, b in itertools.combinations(shapes, 2):
        assert a.world != b.world or math.hypot(a.x - b.x, a.y - b.y) >= 3.6
    assert all(max(abs(r.x), abs(r.y)) >= 10 for r in shapes)
    assert simworld.crossing(w).count() == 0
    assert simworld.scan(w).agg(F.min("range")).first()[0] > 5


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(n % 3, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-2, 2)) for n in range(200)]
    d = spark.createDataFrame(rows, "cls int, x double, y double, z double")
    d.repartition(5).write.parquet(str(tmp_path / "in"))
    s = counts.scan_stream(spark, str(tmp_path / "in"), d.schema)
    for _ in range(2):  # a second run finds nothing new and adds nothing
        counts.train(s, 1.0, ["cls"], str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("cls", "i", "j", "k", "n_free", "n_occ").collect()))
    assert key(counts.model(spark, str(tmp_path / "out"), ["cls"])) == key(counts.voxel_counts(d, 1.0, ["cls"]))


@pytest.mark.parametrize("name", ["mst_chow_liu", "nms_greedy_radius", "surface_normals", "ground_overlaps", "recall_thresholds", "bayesian_linear"])
def test_queries_beyond_sql_give_rows(spark, name):
    from perceptra import catalog

    from .oracle import SMALL

    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_pose_scores_do_not_depend_on_the_join(spark, monkeypatch):
    rng = random.Random(8)
    grid = spark.createDataFrame([(0, i, j, k, rng.choice([-1.0, 0.0, 2.0])) for i in range(-6, 7) for j in range(-6, 7) for k in (0, 1)], "scan_id int, i int, j int, k int, log_odds double")
    model = spark.createDataFrame([(c, i, j, k, -rng.random(), -rng.random()) for c in (1, 2) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (0, 1)], "model_cls int, i int, j int, k int, log_free double, log_occ double")
    key = lambda df: sorted((*r[:4], round(r.score, 9), r.n) for r in df.collect())
    one = key(detect.pose_scores(grid, model, ["scan_id"], 4))
    monkeypatch.setattr(detect, "MODEL_ROWS", 0)
    assert len(one) == 2 * 81 and key(detect.pose_scores(grid, model, ["scan_id"], 4)) == one
