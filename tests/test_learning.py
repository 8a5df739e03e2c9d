"""Forests and their scores, training on streams, drawn poses, chains, directions and kernels against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from perceptra import catalog
from perceptra.functions.expr import least_direction, uniform
from perceptra.operators import evaluate, learn, raymodel, sampling, training, trees
from perceptra.operators.histogram import Histogram
from perceptra.plans import evaluation, grids
from perceptra.sources.adapters import hits
from perceptra.streaming import training as versions

from .oracle import SMALL

KEY = lambda df: sorted(map(tuple, df.collect()), key=str)


def plain_forest_score(cells, edges, conditional, marginal):
    """Of a grid (cell -> state): the best of all forests by trying every order of adding edges is Kruskal's; here each edge is kept if no path of heavier edges joins its ends."""
    inside = sorted(((mi, a, b) for (a, b), mi in edges.items() if a in cells and b in cells), key=lambda e: (-e[0], e[1], e[2]))
    beside = defaultdict(set)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for y in beside[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    for _, a, b in inside:
        if b not in reach(a):
            beside[a].add(b)
            beside[b].add(a)
    nodes, score, roots = {x for x in beside if beside[x]}, 0.0, 0
    while nodes:
        root = min(nodes)
        tree = reach(root)
        roots += 1
        score += marginal[root][cells[root]]
        for x in tree - {root}:
            parent = next(y for y in beside[x] if x not in reach_without(beside, root, y, x))
            score += max(conditional[parent, x].get((cells[parent], cells[x]), -math.inf), math.log(1e-99))
        nodes -= tree
    return score, len({x for x in beside if beside[x]}), roots


def reach_without(beside, root, y, x):
    """What the root reaches without the edge between y and x."""
    seen, todo = {root}, [root]
    while todo:
        a = todo.pop()
        for b in beside[a] - seen:
            if {a, b} != {x, y}:
                seen.add(b)
                todo.append(b)
    return seen if y in seen else {x}


def test_forest_scores(spark):
    rng = random.Random(12)
    edges = {(a, b): round(rng.random(), 1) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.4}
    grids_ = {s: {c: rng.randint(0, 1) for c in rng.sample(range(10), rng.randint(0, 10))} for s in range(40)}
    grids_[40], grids_[41] = {8: 1, 9: 0}, {0: 1}
    conditional = {(p, c): {(g, o): -rng.random() for g in (0, 1) for o in (0, 1) if rng.random() < 0.95} for e in edges for p, c in (e, e[::-1])}
    marginal = {c: (-rng.random(), -rng.random()) for c in range(10)}
    cells = spark.createDataFrame([(s, "k", c, o) for s, g in grids_.items() for c, o in g.items()], "s long, cls string, cell int, occ int")
    e = spark.createDataFrame([("k", a, b, mi) for (a, b), mi in edges.items()], "cls string, a int, b int, mi double")
    t = spark.createDataFrame([("k", p, c, g, o, v) for (p, c), x in conditional.items() for (g, o), v in x.items()], "cls string, a int, b int, given int, occ int, log_p double")
    m = spark.createDataFrame([("k", c, *v) for c, v in marginal.items()], "cls string, cell int, log_free double, log_occ double")
    got = {r.s: (r.score, r.nodes, r.roots) for r in trees.forest_scores(cells, e, t, m, ["s"], ["cls"]).collect()}
    assert set(got) == {s for s, g in grids_.items() if g}
    for s, found in got.items():
        want = plain_forest_score(grids_[s], edges, conditional, marginal)
        assert found[1:] == want[1:] and math.isclose(found[0], want[0], abs_tol=1e-9)
    assert got[40] == got[41] == (0.0, 0, 0)
    assert trees.forest_scores(cells.where("false"), e, t, m, ["s"], ["cls"]).count() == 0


def test_forest_scores_of_all_scans(spark):
    rows = catalog.QUERIES["forest_scores"](spark, SMALL).collect()
    known = grids.near(spark, SMALL).where("log_odds != 0").select("scan_id").distinct().count()
    assert len(rows) == known and any(r.nodes for r in rows) and all(r.score <= 0 and r.roots <= r.nodes for r in rows)


def test_a_killed_stream_goes_on_with_the_model_before_the_batch(spark, tmp_path):
    points = hits(spark, SMALL)
    frames = [points.where(f"scan_id % 10 = {n}") for n in (1, 3, 5, 7)]
    start = grids.marginal(spark, SMALL)
    versions.write_frames(frames, str(tmp_path / "in"), 2)
    step = lambda batch, model: training.hard_round(grids.near_of(batch), model)
    calls = []

    def dies(batch, model):
        calls.append(batch.select("scan_id").distinct().count())
        if len(calls) == 3:  # a half-written version is left behind
            model.limit(1).write.mode("overwrite").parquet(versions.version_path(str(tmp_path / "model"), 3))
            raise RuntimeError("killed")
        return step(batch, model)

    run = lambda f: versions.train_versions(versions.frame_stream(spark, str(tmp_path / "in"), points.schema, 2), start, f, str(tmp_path / "model"), str(tmp_path / "mark"))
    with pytest.raises(Exception, match="killed"):
        run(dies).awaitTermination()
    for _ in range(2):  # the second run finds nothing new
        run(step).awaitTermination()
    assert len(calls) == 3 and versions.latest_version(spark, str(tmp_path / "model")) == 4
    looped = training.hard_rounds([grids.near_of(f) for f in frames], start, trees.stored)
    columns = ["model_cls", "i", "j", "k", "c_free", "c_occ"]
    assert KEY(versions.model_version(spark, str(tmp_path / "model"), 4).select(columns)) == KEY(looped.select(columns)) != KEY(start.select(columns))


def plain_thresholds(scores, n):
    scores, reached, out = sorted(scores, reverse=True), 0.0, []
    for i, s in enumerate(scores):
        left = (i + 1) / n
        right = (i + 2) / n if i < len(scores) - 1 else left
        if right - reached < reached - left and i < len(scores) - 1:
            continue
        out.append(s)
        reached += 1 / 40
    return out


def test_thresholds_by_rank_equal_the_scan(spark):
    rng = random.Random(14)
    groups = {f"g{k}": (m, n) for k, (m, n) in enumerate((rng.randint(1, 400), rng.randint(1, 400)) for _ in range(150))}
    groups |= {f"t{n}": (m, n) for n in (1, 2, 20, 39, 40, 41, 60, 80, 100, 120, 140, 400, 1000) for m in (n,)} | {"hot": (6000, 7777), "few": (3, 5000), "many": (900, 7)}
    scores = {g: [round(rng.random(), 2 if g in ("g1", "hot") else 9) for _ in range(m)] for g, (m, _) in groups.items()}
    rows = [(g, s, groups[g][1]) for g, x in scores.items() for s in x] + [("g1", None, groups["g1"][1]), (None, 0.5, 3)]
    found = defaultdict(dict)
    for r in evaluate.recall_thresholds(spark.createDataFrame(rows, "g string, score double, n_truth long"), ["g"]).collect():
        found[r.g][r.step] = r.threshold
    for g, (_, n) in groups.items():
        want = plain_thresholds(scores[g], n)
        assert [found[g][k] for k in range(len(found[g]))] == want, (g, groups[g])
    assert found[None] == {0: 0.5}
    p = evaluate.recall_thresholds(spark.createDataFrame(rows, "g string, score double, n_truth long"), ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in p


def test_rays_in_space_meet_all_their_poses(spark):
    rng = random.Random(15)
    points = spark.createDataFrame([(n, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-9, 9)) for n in range(500)] + [(900, 0.0, 0.0, 5.0), (901, 0.0, 0.0, -5.0), (902, -20.0, 0.0, 0.0)], "hit_idx long, x double, y double, z double")
    poses = spark.createDataFrame([(n, rng.uniform(-20, 20) * (n % 4), rng.uniform(-20, 20) * (n % 4), rng.uniform(-7, 7)) for n in range(80)], "pose_id long, x double, y double, theta double")
    obs = raymodel.observations_3d(points)
    every = obs.crossJoin(poses.select("pose_id", F.col("x").alias("px"), F.col("y").alias("py"))).where(
        "abs(sin_t*px - cos_t*py) <= 3 AND abs(-sqrt(px*px + py*py)*sin_p) <= 2 AND (range_xy - cos_t*px - sin_t*py)/cos_p >= -3 AND (range_xy - cos_t*px - sin_t*py)/cos_p < range"
    )
    want = KEY(every.select("pose_id", "hit_idx"))
    for most in (10**6, 0):
        seen = raymodel.seen_from_3d(obs, poses, 3.0, 2.0, most)
        assert KEY(seen.select("pose_id", "hit_idx")) == want != []
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        flat = raymodel.seen_from(raymodel.observations(points), poses, 3.0, most)
        assert flat.count() > 0


def test_draws_do_not_depend_on_the_partitioning(spark):
    rows = [(n, n % 3, float(n), -float(n)) for n in range(200)]
    objects = spark.createDataFrame(rows, "a long, b long, x double, y double")
    one = training.jittered(objects, ["a", "b"], 4, 0.5, 3)
    assert KEY(one) == KEY(training.jittered(objects.repartition(7, "b"), ["a", "b"], 4, 0.5, 3)) != KEY(training.jittered(objects, ["a", "b"], 4, 0.5, 4))
    assert all(abs(r.x - r.a) <= 0.25 and abs(r.y + r.a) <= 0.25 for r in one.collect())
    u = [r.u for r in spark.range(5000).select(uniform("id", seed=1).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and len(set(u)) == 5000
    worlds = objects.select("b").distinct()
    free = training.negatives(worlds, objects, ["b"], 50, 20.0, 2.0, 5)
    assert KEY(free) == KEY(training.negatives(worlds.repartition(5), objects.repartition(3), ["b"], 50, 20.0, 2.0, 5))
    for r in free.collect():
        assert all(abs(r.x - x) >= 2 or abs(r.y - y) >= 2 for _, b, x, y in rows if b == r.b)


def test_chains_walk_the_model(spark):
    rng, hist = random.Random(16), Histogram(-5.0, 5.0, 1.0)
    two = [("c", p, d, b, a, float(rng.randint(1, 5))) for p in range(2) for d in range(2) for b in range(4) for a in range(4) if rng.random() < 0.6]
    draws = [("c", chain, step, rng.randint(0, 2), rng.randint(0, 1), rng.randint(1, 100) / 100) for chain in range(60) for step in range(12)]
    model = spark.createDataFrame(two, "cls string, k_phi int, k_dist int, prev int, bin int, w double")
    d = spark.createDataFrame(draws, "cls string, chain long, step int, k_phi int, k_dist int, u double")
    want = {}
    for chain in range(60):
        at = None
        for _, _, step, p, q, u in sorted((x for x in draws if x[1] == chain), key=lambda x: x[2]):
            own = [(b, w) for _, a, c, prev, b, w in two if (a, c) == (p, q) and prev == at]
            mine = own or [(b, w) for _, a, c, _, b, w in two if (a, c) == (p, q)]
            weight = defaultdict(float)
            for b, w in mine:
                weight[b] += w
            total, run, pick = sum(weight.values()), 0.0, None
            for b in sorted(weight):
                run += weight[b]
                if run >= u * total:
                    pick = b
                    break
            at = at if pick is None else pick
            want[chain, step] = pick
    for most in (50_000, 0):
        got = {(r.chain, r.step): (r.bin, r.value) for r in raymodel.sample_chain(d, model, ["cls"], ["chain"], hist, most).collect()}
        assert {k: v[0] for k, v in got.items()} == want
        assert all(v == (None if b is None else b - 6.0) for b, v in got.values())


def test_directions_of_least_variance(spark):
    rng = np.random.default_rng(17)
    m = [a @ a.T for a in rng.normal(size=(200, 3, 3)) * rng.choice([1e-3, 1, 1e3], (200, 1, 1))]
    m += [np.diag(d) for d in ([1.0, 2, 3], [3.0, 2, 1], [2.0, 1, 3], [1.0, 1, 5], [5.0, 1, 1], [1.0, 5, 1], [2.0, 2, 2], [0.0, 0, 0], [0.0, 0, 1], [0.0, 1, 1])]
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    m += [q @ np.diag(d) @ q.T for d in ([1.0, 1, 4], [1.0, 4, 4], [0.0, 0, 3])]
    rows = [(n, *map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2]))) for n, a in enumerate(m)]
    d = spark.createDataFrame(rows, "n int, xx double, xy double, xz double, yy double, yz double, zz double")
    found = d.select("n", least_direction(*map(F.col, ("xx", "xy", "xz", "yy", "yz", "zz"))).alias("d")).collect()
    for r in found:
        v = np.array([r.d.u, r.d.v, r.d.w])
        v /= np.linalg.norm(v)
        low = np.linalg.eigvalsh(m[r.n])
        assert np.linalg.norm(m[r.n] @ v - low[0] * v) <= 1e-6 * max(1e-30, low[2]), r.n
        assert v[np.abs(v).argmax()] > 0
    assert len(found) == len(m)


def test_coloured_descent_needs_fewer_passes(spark):
    keys, rows = ["scan_id", "hit_idx", "sample"], evaluation.free(spark, SMALL)
    w = {(r.m, r.n): r.w for r in learn.coloured_map(rows, keys, 2.0, 2.0, passes=2).collect()}
    phi = defaultdict(list)
    label = {}
    for r in learn.kernel_features(rows, keys, 2.0, 2.0).collect():
        phi[r.scan_id, r.hit_idx, r.sample].append(((r.m, r.n), r.phi))
        label[r.scan_id, r.hit_idx, r.sample] = r.y_label
    loss = lambda weights: np.mean([math.log1p(math.exp(-label[k] * sum(weights.get(c, 0.0) * v for c, v in x))) for k, x in phi.items()])
    full, losses = learn.kernel_map(rows, keys, 2.0, 2.0, trees.stored, rounds=8, rate=1e-3)
    assert loss(w) <= loss({(r.m, r.n): r.w for r in full.collect()}) + 1e-3 < losses[0]
    # a step in NumPy: one colour after another, all cells of a colour from the same margins
    cells, f, own = {c: 0.0 for x in phi.values() for c, _ in x}, dict.fromkeys(phi, 0.0), dict.fromkeys(phi)
    for _ in range(2):
        for colour in range(9):
            g, h = defaultdict(float), defaultdict(float)
            mine = {k: [(c, v) for c, v in x if c[0] % 3 * 3 + c[1] % 3 == colour] for k, x in phi.items()}
            assert max(map(len, mine.values())) <= 1
            for k, x in mine.items():
                for c, v in x:
                    p = 1 / (1 + math.exp(label[k] * f[k]))
                    g[c] -= label[k] * p * v
                    h[c] += p * (1 - p) * v * v
            step = {c: -(g[c] + cells[c]) / (h[c] + 1) for c in g}
            for k, x in mine.items():
                f[k] += sum(step[c] * v for c, v in x)
            for c, d in step.items():
                cells[c] += d
    assert set(cells) == set(w) and all(math.isclose(cells[c], w[c], abs_tol=1e-8) for c in w) and own


def test_kernel_and_weights_in_turn(spark):
    keys, rows = ["scan_id", "hit_idx", "sample"], evaluation.free(spark, SMALL)
    weights, kernel, losses = training.learn_kernel(rows, keys, F.col("scan_id") % 2, 2.0, 2.0, trees.stored, rounds=3)
    assert losses[-1] < losses[0]
    near = learn.cells_in_reach(rows, 2.0, 2.0).where("d < 2").collect()
    sample = {}
    for r in near:
        sample.setdefault((r.scan_id, r.hit_idx, r.sample), len(sample))
    cell = {c: n for n, c in enumerate(sorted({(r.m, r.n) for r in near}))}
    s, c = np.array([sample[r.scan_id, r.hit_idx, r.sample] for r in near]), np.array([cell[r.m, r.n] for r in near])
    slot = np.array([min(15, int(math.hypot(r.x - 2 * r.m, r.y - 2 * r.n) / 2 * 16)) for r in near])
    y, half = np.empty(len(sample)), np.empty(len(sample), int)
    for r in near:
        y[sample[r.scan_id, r.hit_idx, r.sample]], half[sample[r.scan_id, r.hit_idx, r.sample]] = r.y_label, r.scan_id % 2
    w, v, rate, steep, want = np.zeros(len(cell)), 1 - np.arange(16) / 16, 1e-3, 0.5, []
    slope = lambda f: -y / (1 + np.exp(y * f))
    for n in range(3):
        mine, other = half[s] == n % 2, half[s] != n % 2
        f = np.bincount(s, w[c] * v[slot], len(sample))
        want.append(np.log1p(np.exp(-y * f))[half != n % 2].mean())
        w = w - rate * np.bincount(c[mine], (slope(f)[s] * v[slot])[mine], len(cell))
        f = np.bincount(s, w[c] * v[slot], len(sample))
        count = np.bincount(slot[other], minlength=16)
        v = v - steep * np.bincount(slot[other], (slope(f)[s] * w[c])[other], 16) / np.maximum(count, 1)
        rate, steep = rate * 0.9999, steep * 0.9999
    assert losses == pytest.approx(want, abs=1e-9)
    assert {(r.m, r.n): r.w for r in weights.collect()} == pytest.approx({k: w[n] for k, n in cell.items()}, abs=1e-9)
    assert [r.v for r in kernel.orderBy("slot").collect()] == pytest.approx(v.tolist(), abs=1e-9)


def test_orders_of_rows(spark):
    grid = catalog.QUERIES["grid_in_order"](spark, SMALL).collect()
    columns = [c for c in grid[0].__fields__ if c in ("scan_id", "i", "j", "k")]
    at = [tuple(r[c] for c in columns) for r in grid]
    assert at == sorted(at) and len(set(at)) == len(at)
    rows = spark.createDataFrame([(n % 7, (n * 37) % 101, n) for n in range(500)], "b long, o long, n long")
    for part in sampling.bucketed(rows, ["b"], ["o", "n"]).rdd.glom().collect():
        assert [(r.b, r.o, r.n) for r in part] == sorted((r.b, r.o, r.n) for r in part)
    owner = [{r.b for r in part} for part in sampling.bucketed(rows, ["b"], ["o"]).rdd.glom().collect()]
    assert sum(map(len, owner)) == 7
    one = [r.n for r in sampling.shuffled(rows, 5).collect()]
    assert sorted(one) == list(range(500)) and one != list(range(500))
    assert one == [r.n for r in sampling.shuffled(rows.repartition(6), 5).collect()] != [r.n for r in sampling.shuffled(rows, 6).collect()]


def test_colours(spark):
    import colorsys

    from perceptra.functions.expr import hsv_to_rgb, rgb_to_hsv

    rng = random.Random(18)
    rows = [(rng.uniform(0, 360), rng.random(), rng.random()) for _ in range(300)] + [(0.0, 0.0, 0.5), (360.0, 1.0, 1.0), (60.0, 1.0, 0.0), (120.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "h double, s double, v double")
    for r in d.withColumns(hsv_to_rgb("h", "s", "v")).withColumns({f"_{k}": c for k, c in rgb_to_hsv("r", "g", "b").items()}).collect():
        assert (r.r, r.g, r.b) == pytest.approx(colorsys.hsv_to_rgb(r.h / 360 % 1, r.s, r.v), abs=1e-9)
        if r.s * r.v > 1e-3:
            assert math.isclose((r._h - r.h + 180) % 360, 180, abs_tol=1e-6) and math.isclose(r._s, r.s, abs_tol=1e-6)
