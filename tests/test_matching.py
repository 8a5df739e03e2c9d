"""Assignment in both modes and the evaluation, against plain loops over the boxes of a frame."""

import math
import random
import sys
from collections import defaultdict

import numpy as np
import pytest

from perceptra.operators import evaluate, matching
from perceptra.operators.evaluate import DIFFICULTY

from .test_properties import plain_common_area

FRAMES = 30
WANTED, LEAST = {"Car": "Van", "Cyclist": None}, 0.5
COLUMNS = "frame long, box_id long, kind string, alpha double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b, own=False):
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) if own else area(a) + area(b) - w * h)


def flag(r, wanted, level, truth):
    low, occlusion, truncation = DIFFICULTY[level]
    hard = r["y2"] - r["y1"] < low
    if truth:
        hard = hard or r["occlusion"] > occlusion or r["truncation"] > truncation
        return 0 if r["kind"] == wanted and not hard else 1 if r["kind"] == wanted or r["kind"] == WANTED[wanted] else -1
    return 1 if hard else 0 if r["kind"] == wanted else -1


def plain(boxes, found, care, wanted, level, threshold=None):
    """(scores of true positives, pairs, false positives, misses) of a frame."""
    used, pairs, missed = set(), [], 0
    for b in sorted(boxes, key=lambda r: r["box_id"]):
        kind = flag(b, wanted, level, True)
        if kind == -1:
            continue
        best = None
        for d in sorted(found, key=lambda r: r["box_id"]):
            own = flag(d, wanted, level, False)
            if own == -1 or d["box_id"] in used or iou(b, d) <= LEAST or threshold is not None and d["score"] < threshold:
                continue
            rank = (d["score"],) if threshold is None else (own == 0, iou(b, d) if own == 0 else 0)
            if best is None or rank > best[0]:
                best = (rank, d, own)
        if best is None:
            missed += kind == 0
        else:
            used.add(best[1]["box_id"])
            if kind == 0 and best[2] == 0:
                pairs.append((b, best[1]))
    wrong = [d for d in found if d["box_id"] not in used and flag(d, wanted, level, False) == 0 and (threshold is None or d["score"] >= threshold)]
    wrong = [d for d in wrong if not any(iou(d, c, True) > LEAST for c in care)]
    return pairs, len(wrong), missed


def scene(seed):
    rng = random.Random(seed)
    gt, det, care = [], [], []
    for frame in range(FRAMES):
        for n in range(rng.randint(0, 9)):
            x, y, w, h = rng.randint(0, 200), rng.randint(0, 200), rng.randint(25, 60), rng.randint(35, 70)
            box = {"frame": frame, "kind": rng.choice(["Car", "Van", "Cyclist"]), "alpha": rng.random(), "x1": float(x), "y1": float(y), "x2": float(x + w), "y2": float(y + h)}
            gt.append(box | {"box_id": n, "occlusion": rng.randint(0, 3), "truncation": rng.random() * 0.6})
            for c in range(rng.randint(0, 3)):
                move = {k: box[k] + rng.randint(-4, 4) for k in ("x1", "y1", "x2", "y2")}
                det.append(box | move | {"box_id": 10 * n + c, "score": rng.random(), "alpha": rng.random(), "kind": rng.choice([box["kind"], box["kind"], "Car"])})
        for c in range(3):
            x, y = rng.randint(0, 200), rng.randint(0, 200)
            det.append({"frame": frame, "box_id": 900 + c, "kind": "Car", "alpha": 0.0, "score": rng.random(), "x1": float(x), "y1": float(y), "x2": x + 30.0, "y2": y + 45.0})
        care.append({"frame": frame, "box_id": 0, "x1": 0.0, "y1": 0.0, "x2": 120.0, "y2": 150.0})
    return gt, det, care


def test_curve_and_average_precision(spark):
    gt, det, care = scene(3)
    make = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    g, d = make(gt, COLUMNS + ", occlusion long, truncation double"), make(det, COLUMNS + ", score double")
    c = make(care, "frame long, box_id long, x1 double, y1 double, x2 double, y2 double")
    curve = matching.evaluate_detections(g, d, c, WANTED, LEAST)
    got = defaultdict(dict)
    for r in curve.collect():
        got[r.wanted, r.level][r.step] = r
    by = lambda rows, frame: [r for r in rows if r["frame"] == frame]
    checked = 0
    for wanted in WANTED:
        for level in range(3):
            first = [plain(by(gt, f), by(det, f), by(care, f), wanted, level) for f in range(FRAMES)]
            scores = sorted((p[1]["score"] for pairs, _, _ in first for p in pairs), reverse=True)
            n = sum(flag(b, wanted, level, True) == 0 for b in gt)
            thresholds, reached = [], 0.0
            for i, s in enumerate(scores):
                left, right = (i + 1) / n, (i + 2) / n if i < len(scores) - 1 else (i + 1) / n
                if i < len(scores) - 1 and right - reached < reached - left:
                    continue
                thresholds.append(s)
                reached += 1 / 40
            rows = got[wanted, level]
            assert [rows[i].threshold for i in range(len(rows))] == thresholds
            for step, t in enumerate(thresholds):
                found = [plain(by(gt, f), by(det, f), by(care, f), wanted, level, t) for f in range(FRAMES)]
                tp, fp, fn = sum(len(p) for p, _, _ in found), sum(x for _, x, _ in found), sum(x for *_, x in found)
                r = rows[step]
                assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
                turn = sum((1 + math.cos(b["alpha"] - x["alpha"])) / 2 for p, _, _ in found for b, x in p)
                assert math.isclose(r.aos, turn / (tp + fp) if tp + fp else 0.0, abs_tol=1e-9)
                checked += 1
    assert checked > 20
    for r in matching.class_average_precision(curve).collect():
        rows = got[r.wanted, r.level]
        best = [max(rows[j].precision for j in range(i, len(rows))) if i < len(rows) else 0.0 for i in range(41)]
        assert math.isclose(r.ap, sum(best[::4]) / 11) and 0 <= r.orientation <= 1
    assert matching.evaluate_detections(g.limit(0), d.limit(0), c, WANTED, LEAST).count() == 0


def test_a_neutral_detection_is_taken_only_where_none_counts():
    overlap, score = np.array([[0.9, 0.6]]), np.array([0.2, 0.8])
    flags = np.array([0])
    hits, fp, fn = matching.assign(overlap, score, flags, np.array([1, 0]), np.zeros(2, bool), 0.5, 0.0)
    assert (hits.tolist(), fp, fn) == ([1], 0, 0)
    hits, fp, fn = matching.assign(overlap, score, flags, np.array([1, 1]), np.zeros(2, bool), 0.5, 0.0)
    assert (hits.tolist(), fp, fn) == ([-1], 0, 0)
    hits, fp, fn = matching.assign(overlap, score, flags, np.array([0, 0]), np.array([False, True]), 0.5)
    assert (hits.tolist(), fp, fn) == ([1], 1, 0)


def placed(rows):
    """Boxes on the ground and in space that follow from the image boxes."""
    for r in rows:
        n = r["box_id"] % 9
        r |= {"x": (r["x1"] + r["x2"]) / 20, "y": (r["y1"] + r["y2"]) / 20, "l": (r["x2"] - r["x1"]) / 10, "w": (r["y2"] - r["y1"]) / 12, "heading": 0.3 * n + 0.05 * r.get("score", 0), "z": 0.11 * n, "h": 1.5 + 0.13 * n}
    return rows


def space_overlap(solid):
    def overlap(a, b, own=False):
        inter = plain_common_area(*((r["x"], r["y"], r["l"], r["w"], r["heading"]) for r in (a, b)))
        size = {id(r): r["l"] * r["w"] for r in (a, b)}
        if solid:
            inter *= max(0.0, min(a["z"] + a["h"], b["z"] + b["h"]) - max(a["z"], b["z"]))
            size = {id(r): size[id(r)] * r["h"] for r in (a, b)}
        return inter / (size[id(a)] if own else size[id(a)] + size[id(b)] - inter)

    return overlap


@pytest.mark.parametrize("measure", ["ground", "solid"])
def test_curves_by_overlap_in_space(spark, monkeypatch, measure):
    monkeypatch.setattr(sys.modules[__name__], "iou", space_overlap(measure == "solid"))
    gt, det, care = map(placed, scene(5))
    place = ", x double, y double, l double, w double, heading double, z double, h double"
    make = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    g, d = make(gt, COLUMNS + place + ", occlusion long, truncation double"), make(det, COLUMNS + place + ", score double")
    c = make(care, "frame long, box_id long" + place)
    curve = matching.evaluate_detections(g, d, c, WANTED, LEAST, measure)
    rows = curve.collect()
    by = lambda rows, frame: [r for r in rows if r["frame"] == frame]
    assert len(rows) > 20
    for r in rows:
        found = [plain(by(gt, f), by(det, f), by(care, f), r.wanted, r.level, r.threshold) for f in range(FRAMES)]
        assert (r.tp, r.fp, r.fn) == (sum(len(p) for p, _, _ in found), sum(x for _, x, _ in found), sum(x for *_, x in found))
    for wanted in WANTED:
        for level in range(3):
            first = [plain(by(gt, f), by(det, f), by(care, f), wanted, level) for f in range(FRAMES)]
            scores = sorted((p[1]["score"] for pairs, _, _ in first for p in pairs), reverse=True)
            got = {r.step: r.threshold for r in rows if (r.wanted, r.level) == (wanted, level)}
            assert set(got.values()) <= set(scores) and (not scores or got[0] == scores[0])
    ap = {(r.wanted, r.level): r.ap for r in matching.class_average_precision(curve).collect()}
    for key in ap:
        steps = {r.step: r.precision for r in rows if (r.wanted, r.level) == key}
        best = [max((steps[j] for j in steps if j >= i), default=0.0) if i in steps else 0.0 for i in range(41)]
        assert math.isclose(ap[key], sum(best[::4]) / 11, abs_tol=1e-12)


def test_ground_pairs_lose_none_and_repeat_none(spark):
    rng = random.Random(9)
    box = lambda f, n: (f, n, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([0.5, 4.0, 40.0]), rng.uniform(0.2, 6), rng.uniform(-7, 7))
    a, b = ([box(f, n) for f in range(3) for n in range(60)] for _ in range(2))
    a.append((0, 99, None, 1.0, 2.0, 2.0, 0.0))
    schema = "frame long, box_id long, x double, y double, l double, w double, heading double"
    met = [(r.frame, r.d_box_id, r.g_box_id) for r in evaluate.ground_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["frame"]).collect()]
    assert len(set(met)) == len(met) < 3 * 60 * 60
    assert {(x[0], x[1], y[1]) for x in a if x[2] is not None for y in b if x[0] == y[0] and plain_common_area(x[2:], y[2:]) > 0} <= set(met)
