"""Queries over every row of their input."""

import numpy as np
import pytest

from perceptra import catalog
from perceptra.operators import evaluate, learn, training
from perceptra.plans import evaluation, grids
from perceptra.sources.adapters import hits

from .oracle import SMALL


def test_kernel_map_trains_on_all_scans(spark):
    rows = evaluation.free(spark, SMALL).select("x", "y", "y_label").collect()
    x, y, label = np.array([tuple(map(float, r)) for r in rows]).T
    cells, near = {}, []
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            m, n = np.sign(x) * np.floor(abs(x / 2) + 0.5) + a, np.sign(y) * np.floor(abs(y / 2) + 0.5) + b
            q = np.hypot(x - 2 * m, y - 2 * n) / 2
            phi = np.where(q < 1, (2 + np.cos(2 * np.pi * q)) / 3 * (1 - q) + np.sin(2 * np.pi * q) / (2 * np.pi), 0)
            near.append((np.array([cells.setdefault(c, len(cells)) for c in zip(m, n)]), phi))
    w, want = np.zeros(len(cells)), []
    for _ in range(4):
        f = sum(w[c] * phi for c, phi in near)
        want.append(np.log1p(np.exp(-label * f)).mean())
        slope = -label / (1 + np.exp(label * f))
        w = w - 1e-3 * sum(np.bincount(c, slope * phi, len(w)) for c, phi in near)
    got = [r.loss for r in catalog.QUERIES["kernel_map_training"](spark, SMALL).orderBy("round").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_rvm_is_fitted_with_the_operators_defaults(spark, monkeypatch):
    seen, fit = [], learn.fit_rvm
    monkeypatch.setattr(learn, "fit_rvm", lambda rows, **given: seen.append(given) or fit(rows, centres=3, rounds=1))
    p = catalog.QUERIES["rvm_predict"](spark, SMALL)
    assert seen == [{}]
    assert p.count() == hits(spark, SMALL).where("scan_id % 2 = 1").count()


def test_hard_training_scores_every_scan_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "hard_rounds", lambda frames, model, store: seen.extend(frames) or model)
    catalog.QUERIES["hard_training"](spark, SMALL)
    scans = [r.scan_id for f in seen for r in f.select("scan_id").distinct().collect()]
    assert sorted(scans) == sorted(r.scan_id for r in hits(spark, SMALL).where("scan_id % 2 = 1").select("scan_id").distinct().collect())


def test_outer_poses_have_all_their_cells(spark):
    known = [(r.scan_id, r.i, r.j) for r in grids.grid(spark, SMALL).where("abs(k) <= 1 AND log_odds != 0 AND scan_id % 2 = 1").collect()]
    got = {(r.scan_id, r.px, r.py): r.n for r in catalog.QUERIES["pose_scores_whole"](spark, SMALL).where("model_cls = 0").collect()}
    want = {}
    for scan, i, j in known:
        for px in range(max(-4, i - 2), min(4, i + 2) + 1):
            for py in range(max(-4, j - 2), min(4, j + 2) + 1):
                want[scan, px, py] = want.get((scan, px, py), 0) + 1
    clipped = {(r.scan_id, r.px, r.py): r.n for r in catalog.QUERIES["pose_scores"](spark, SMALL).where("model_cls = 0").collect()}
    assert got == want != clipped


def test_thresholds_come_from_all_matches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluate, "recall_thresholds", lambda scores, by: seen.append(scores) or scores)
    catalog.QUERIES["recall_thresholds"](spark, SMALL)
    kinds = evaluation.ground_truth(spark, SMALL).select("kind").distinct()
    assert seen[0].count() == evaluation.detections(spark, SMALL).join(kinds, "kind", "left_semi").count()


def test_ray_histogram_counts_all_scans(spark):
    counted = lambda name: catalog.QUERIES[name](spark, SMALL).agg({"w": "sum"}).first()[0]
    assert counted("ray_histogram_1gram_whole") == catalog.QUERIES["ray_observation_projection"](spark, SMALL).count() > counted("ray_histogram_1gram")


def test_every_class_is_suppressed_and_blurred(spark):
    classes = {r.cls for r in hits(spark, SMALL).select("cls").distinct().collect()}
    for name, column in (("nms_greedy_radius", "model_cls"), ("bank_blur_whole", "cls")):
        assert {r[0] for r in catalog.QUERIES[name](spark, SMALL).select(column).distinct().collect()} == classes
