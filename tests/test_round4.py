"""Steps that must not grow with the pairs of a frame, held against plain versions."""

import numpy as np
import pytest

from perceptra.operators import evaluate, matching


@pytest.mark.parametrize("measure", ["image", "ground", "solid"])
@pytest.mark.parametrize("criterion", [-1, 0])
def test_pruned_pairs_are_all_that_overlap(measure, criterion, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(matching, "PAIRS", 500)

    def boxes(n):
        x, y, size = rng.uniform(0, 30, n), rng.uniform(0, 10, n), rng.uniform(0.5, 6, (3, n))
        if measure == "image":
            return np.column_stack([x, y, x + size[0], y + size[1]])
        return np.column_stack([x, y, size[0], size[1], rng.uniform(-4, 4, n), *([rng.uniform(0, 1, n), size[2]] if measure == "solid" else [])])

    a, b = boxes(120), boxes(150)
    b[:40] = a[:40] + rng.normal(0, 0.05, a[:40].shape)
    b[3, 0] = a[5, 1] = np.nan
    met = 0
    for least in (0.3, 0.5, 0.7):
        found = list(matching.overlapping(a, b, measure, criterion, least))
        assert [i for i, _, _ in found] == list(range(len(a)))
        for i, rows, share in found:
            one = np.repeat(a[i : i + 1], len(b), 0)
            if measure == "image":
                w, h = np.minimum(one[:, 2], b[:, 2]) - np.maximum(one[:, 0], b[:, 0]), np.minimum(one[:, 3], b[:, 3]) - np.maximum(one[:, 1], b[:, 1])
                inter, own, other = np.where((w > 0) & (h > 0), w * h, 0), (one[:, 2] - one[:, 0]) * (one[:, 3] - one[:, 1]), (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
            else:
                inter, own, other = evaluate.common_area(one[:, :5], b[:, :5]), one[:, 2] * one[:, 3], b[:, 2] * b[:, 3]
                if measure == "solid":
                    inter = inter * np.maximum(0, np.minimum(one[:, 5] + one[:, 6], b[:, 5] + b[:, 6]) - np.maximum(one[:, 5], b[:, 5]))
                    own, other = own * one[:, 6], other * b[:, 6]
            truth = inter / (own + other - inter if criterion else own)
            assert np.array_equal(rows, np.flatnonzero(truth > least)) and np.allclose(share, truth[rows])
            met += len(rows)
    assert met > 50


def test_best_and_greedy_matches_without_gathered_pairs(spark):
    rng = np.random.default_rng(8)
    rows = lambda n, start: [(int(f), start + i, float(i % 97) / 97, float(x), float(y), float(x + w), float(y + h)) for i, (f, x, y, w, h) in enumerate(zip(rng.integers(0, 3, n), *(rng.integers(0, 40, n).astype(float) for _ in "xy"), *(rng.integers(3, 25, n).astype(float) for _ in "wh"), strict=True))]
    schema = "frame long, box_id long, score double, x1 double, y1 double, x2 double, y2 double"
    gt, det = rows(150, 0), rows(200, 1000)
    gt.append((7, 900, 0.0, 0.0, 0.0, 5.0, 5.0))
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        return round(w * h / (area(a) + area(b) - w * h), 9) if w > 0 and h > 0 else 0.0

    best, greedy, used = {}, {}, set()
    for g in gt:
        met = sorted((-o, d[1]) for d in det if d[0] == g[0] and (o := iou(d, g)) > 0)
        if met:
            best[g[1]] = met[0][1], -met[0][0]
        left = [(o, d) for o, d in met if -o > 0.3 and d not in used]
        if left:
            greedy[g[1]] = left[0][1], -left[0][0]
            used.add(left[0][1])
    g, d = spark.createDataFrame(gt, schema), spark.createDataFrame(det, schema)
    assert {r.g_box_id: (r.d_box_id, r.overlap) for r in matching.best_matches(d, g).collect()} == best
    found = matching.match_frames(d, g, 0.3)
    assert {r.g_box_id: (r.d_box_id, r.overlap) for r in found.collect()} == greedy and len(greedy) > 40
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_frame_are_many_tasks(spark):
    schema = "frame long, box_id long, x1 double, y1 double, x2 double, y2 double"
    rows = spark.createDataFrame([(1, n, 0.0, 0.0, 1.0 + n, 1.0) for n in range(300)], schema)
    dealt = evaluate.pairs(rows, rows, ["frame"])
    assert dealt.count() == 300 * 300 and "_part" in dealt._jdf.queryExecution().executedPlan().toString()


def shuffles(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pairs_of_a_grid_are_not_shuffled(spark):
    from perceptra.operators import detect, trees

    grid = spark.range(60).selectExpr("id % 6 AS scan_id", "CAST(id DIV 6 AS INT) AS i", "0 AS j", "0 AS k", "CAST(id % 5 - 2 AS DOUBLE) AS log_odds")
    model = spark.range(9).selectExpr("CAST(id % 3 AS INT) AS model_cls", "CAST(id DIV 3 AS INT) AS i", "0 AS j", "0 AS k", "-1.0D AS log_free", "-2.0D AS log_occ")
    assert shuffles(detect.pose_scores(grid, model, ["scan_id"], 4)) == 1
    cells = spark.range(60).selectExpr("id % 6 AS scan_id", "id % 2 AS cls", "id DIV 6 AS cell", "id DIV 6 AS ord")
    edges = spark.range(100).selectExpr("id % 2 AS cls", "id DIV 10 AS a", "id % 10 AS b", "CAST(id AS DOUBLE) AS mi").where("a < b")
    parents = trees.greedy_parents(cells, edges, ["scan_id"], ["cls"])
    assert shuffles(parents) == 1
    held = {(r.cls, r.a, r.b): r.mi for r in edges.collect()}
    for span in (None, 3):
        want = {}
        for r in cells.collect():
            for a in range(max(0, r.cell - span) if span else 0, r.cell):
                if (r.cls, a, r.cell) in held:
                    want[r.scan_id, r.cell] = max(want.get((r.scan_id, r.cell), (-1.0, 0)), (held[r.cls, a, r.cell], -a))
        found = {(r.scan_id, r.child): (r.mi, -r.parent) for r in trees.greedy_parents(cells, edges, ["scan_id"], ["cls"], span).collect()}
        assert found == want


def test_greedy_radius_folds_arrays(spark):
    from perceptra.operators import detect

    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(y), float(s)) for g, x, y, s in zip(rng.integers(0, 4, 300), rng.integers(0, 20, 300), rng.integers(0, 20, 300), rng.integers(0, 50, 300), strict=True)]
    rows = [(int(g), x, y, s) for g, x, y, s in rows]
    want = set()
    for g in range(4):
        taken = []
        for _, x, y, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if all((x - a) ** 2 + (y - b) ** 2 >= 9 for a, b in taken):
                taken.append((x, y))
                want.add((g, x, y, s))
    found = detect.greedy_radius(spark.createDataFrame(rows, "g int, x double, y double, s double"), ["g"], "s", 3.0, "g int, x double, y double, s double")
    assert {tuple(r) for r in found.collect()} == want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_calibration_and_cameras_are_files_in_one_folder(spark, tmp_path):
    from perceptra.sources import files

    rows = spark.range(40).selectExpr("id * 50021 AS frame", "array(CAST(id AS DOUBLE)) AS p", "array(1.5D) AS r_rect", "array(-2.0D) AS t_cv")
    one, two = f"file://{tmp_path}/calibration", f"file://{tmp_path}/camera"
    files.write_calibration(rows, one)
    files.write_camera(rows.selectExpr("frame AS day", "p", "r_rect", "t_cv AS r", "t_cv AS t"), two)
    for folder in ("calibration", "camera"):
        made = list((tmp_path / folder).iterdir())
        assert len(made) == 40 and all(p.is_file() and p.suffix == ".txt" for p in made)
    assert {(r.frame, tuple(r.p)) for r in files.read_calibration(spark, one).collect()} == {(n * 50021, (float(n),)) for n in range(40)}
    assert {(r.day, tuple(r.p), tuple(r.t)) for r in files.read_camera(spark, two).collect()} == {(n * 50021, (float(n),), (-2.0,)) for n in range(40)}
