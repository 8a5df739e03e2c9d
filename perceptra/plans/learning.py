"""Queries over drawn poses, chains of ranges, and the detector's score with directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import detect, models, raymodel, scoring, training
from ..operators.rays import box_lattice
from ..registry import query
from ..sources.adapters import HITS_SQL, hits
from . import detection, grids

#: Copies of an object and the cell that they lie in; poses a world, half its extent and the distance they keep; the seed of both.
COPIES, RES, EACH, HALF, APART, SEED = 3, 0.5, 40, 25.0, 4.0, 11


def _uniform(*keys: str) -> str:
    text = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5({text} || '/{SEED}'), 1, 12))::BIGINT/281474976710656.0::DOUBLE)"


@query(f"""WITH {HITS_SQL}, j AS (SELECT scan_id, hit_idx, CAST(n AS INTEGER) AS jitter, x, y FROM hits, range({COPIES}) r(n))
SELECT scan_id, hit_idx, jitter, round(x + ({_uniform('scan_id', 'hit_idx', 'jitter', "'x'")} - 0.5)*{RES}::DOUBLE, 6) AS x, round(y + ({_uniform('scan_id', 'hit_idx', 'jitter', "'y'")} - 0.5)*{RES}::DOUBLE, 6) AS y FROM j""")
def jittered_poses(spark, sf_dir):
    objects = hits(spark, sf_dir).select("scan_id", "hit_idx", "x", "y")
    return training.jittered(objects, ["scan_id", "hit_idx"], COPIES, RES, SEED).withColumns({c: F.round(c, 6) for c in "xy"})


@query(f"""WITH {HITS_SQL}, w AS (SELECT scan_id, CAST(n AS INTEGER) AS n FROM (SELECT DISTINCT scan_id FROM hits), range({EACH}) r(n)),
p AS (SELECT scan_id, n, ({_uniform('scan_id', 'n', "'x'")}*2 - 1)*{HALF}::DOUBLE AS x, ({_uniform('scan_id', 'n', "'y'")}*2 - 1)*{HALF}::DOUBLE AS y FROM w)
SELECT scan_id, n, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.scan_id = p.scan_id AND abs(h.x - p.x) < {APART} AND abs(h.y - p.y) < {APART})""")
def negative_poses(spark, sf_dir):
    objects = hits(spark, sf_dir).select("scan_id", "x", "y")
    worlds = objects.select("scan_id").distinct()
    return training.negatives(worlds, objects, ["scan_id"], EACH, HALF, APART, SEED).select("scan_id", "n", *[F.round(c, 6).alias(c) for c in "xy"])


DRAWN = """draws AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id, pose_id ORDER BY hit_idx) AS s, ((hit_idx*37 + scan_id*11 + pose_id*5) % 101 + 1)/101.0::DOUBLE AS u FROM keyed)"""


def _draws(spark, sf_dir):
    u = ((F.col("hit_idx") * 37 + F.col("scan_id") * 11 + F.col("pose_id") * 5) % 101 + 1) / 101.0
    return detection.keyed(detection.seen(spark, sf_dir)).select("cls", "scan_id", "pose_id", F.col("hit_idx").alias("step"), "k_phi", "k_dist", u.alias("u"))


@query(f"""WITH RECURSIVE {detection.ALL_PREV}, {DRAWN},
own AS (SELECT *, sum(w) OVER (PARTITION BY cls, k_phi, k_dist, prev ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY cls, k_phi, k_dist, prev) AS total FROM two),
summed AS (SELECT cls, k_phi, k_dist, bin, sum(w) AS w FROM two GROUP BY ALL),
rest AS (SELECT *, sum(w) OVER (PARTITION BY cls, k_phi, k_dist ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY cls, k_phi, k_dist) AS total FROM summed),
moves AS MATERIALIZED (SELECT d.scan_id, d.pose_id, d.s, o.prev, min(o.bin) FILTER (WHERE o.upto >= d.u*o.total) AS bin FROM draws d JOIN own o ON o.cls = d.cls AND o.k_phi = d.k_phi AND o.k_dist = d.k_dist GROUP BY ALL),
falls AS MATERIALIZED (SELECT d.scan_id, d.pose_id, d.s, d.cls, d.hit_idx, min(o.bin) FILTER (WHERE o.upto >= d.u*o.total) AS bin FROM draws d LEFT JOIN rest o ON o.cls = d.cls AND o.k_phi = d.k_phi AND o.k_dist = d.k_dist GROUP BY ALL),
walk AS (
  SELECT DISTINCT scan_id, pose_id, CAST(0 AS BIGINT) AS s, CAST(NULL AS INTEGER) AS prev, CAST(NULL AS INTEGER) AS drawn FROM draws UNION ALL
  SELECT w.scan_id, w.pose_id, f.s, coalesce(m.bin, f.bin, w.prev), coalesce(m.bin, f.bin)
  FROM walk w JOIN falls f ON f.scan_id = w.scan_id AND f.pose_id = w.pose_id AND f.s = w.s + 1 LEFT JOIN moves m ON m.scan_id = w.scan_id AND m.pose_id = w.pose_id AND m.s = f.s AND m.prev = w.prev)
SELECT f.cls, f.scan_id, f.pose_id, f.hit_idx AS step, w.drawn AS bin, CAST(w.drawn - 6 AS DOUBLE) AS value FROM walk w JOIN falls f ON f.scan_id = w.scan_id AND f.pose_id = w.pose_id AND f.s = w.s""")
def chain_samples(spark, sf_dir):
    two = detection._two(detection.seen(spark, sf_dir))
    return raymodel.sample_chain(_draws(spark, sf_dir), two, ["cls"], ["scan_id", "pose_id"], detection.H)


@query(f"""WITH {detection.ALL_PREV}, {DRAWN},
run AS (SELECT *, sum(w) OVER (PARTITION BY cls, k_phi, k_dist ORDER BY bin)/sum(w) OVER (PARTITION BY cls, k_phi, k_dist) AS hi, w/sum(w) OVER (PARTITION BY cls, k_phi, k_dist) AS p FROM one)
SELECT d.cls, d.scan_id, d.pose_id, d.hit_idx AS step, round(least(5, greatest(-5, r.bin - 6 + (d.u - (r.hi - r.p))/r.p)), 6) AS value
FROM draws d JOIN run r ON r.cls = d.cls AND r.k_phi = d.k_phi AND r.k_dist = d.k_dist AND d.u > r.hi - r.p AND d.u <= r.hi""")
def range_samples(spark, sf_dir):
    one = detection._one(detection.seen(spark, sf_dir))
    drawn = raymodel.sample_ranges(_draws(spark, sf_dir), one, ["cls"], detection.H)
    return drawn.select("cls", "scan_id", "pose_id", "step", F.round("value", 6).alias("value"))


#: Cells in reach of a pose, and bins of directions.
REACH, BINS = 1, 961
AIMED = f"""aimed AS (
  SELECT scan_id, cls, i, j, k, arg_min(hit_idx, hit_idx) AS hit_idx, arg_min(atan2(y, x), hit_idx) AS theta, arg_min(atan2(z, sqrt(x*x+y*y)), hit_idx) AS phi
  FROM (SELECT *, CAST(round(x) AS INTEGER) AS i, CAST(round(y) AS INTEGER) AS j, CAST(round(z) AS INTEGER) AS k FROM hits) WHERE {grids.IN_SIZE} GROUP BY ALL)"""


def _bin_sql(theta: str) -> str:
    t = f"(CASE WHEN phi < 0 THEN {theta} + pi() ELSE {theta} END)"
    return f"CAST(CASE WHEN floor(abs(phi)/0.2) >= 30 THEN 960 ELSE floor(({t} - 2*pi()*floor({t}/(2*pi())))/0.2)*30 + floor(abs(phi)/0.2) END AS INTEGER)"


TURNED = "CASE turn WHEN 0 THEN i WHEN 1 THEN -j WHEN 2 THEN -i ELSE j END AS i, CASE turn WHEN 0 THEN j WHEN 1 THEN i WHEN 2 THEN -j ELSE -i END AS j"


def _aimed(spark, sf_dir):
    """Of each cell that a scan hits the direction of its first hit; every third hit's is not valid."""
    p = expr.polar("x", "y", "z")
    h = hits(spark, sf_dir).withColumns({c: expr.quantise(a, grids.COARSE) for c, a in zip("ijk", "xyz", strict=True)}).where(models.window(*grids.SIZE))
    first = h.groupBy("scan_id", "cls", "i", "j", "k").agg(F.min_by(F.struct("hit_idx", p["theta"].alias("theta"), p["phi"].alias("phi")), "hit_idx").alias("f"))
    return first.select("scan_id", "cls", "i", "j", "k", "f.theta", "f.phi", (F.col("f.hit_idx") % 3 != 0).alias("valid_normal"))


@query(f"""WITH {detection.FULL}, {AIMED},
bins AS (SELECT cls AS model_cls, i, j, k, {_bin_sql('theta')} AS bin, count(*) AS c FROM aimed WHERE scan_id % 2 = 0 AND hit_idx % 3 <> 0 AND abs(i) <= 2 AND abs(j) <= 2 GROUP BY ALL),
shares AS (SELECT *, ln(greatest(1e-4, least(1 - 1e-4, c/sum(c) OVER (PARTITION BY model_cls, i, j, k)))) AS log_n FROM bins),
turns AS (SELECT CAST(t AS INTEGER) AS turn FROM range(4) r(t)),
turned_cells AS (SELECT m.model_cls, turn, {TURNED}, m.k, log_free, log_occ, EXISTS (SELECT 1 FROM bins b WHERE b.model_cls = m.model_cls AND b.i = m.i AND b.j = m.j AND b.k = m.k) AS seen FROM full_model m, turns),
stencil AS (SELECT model_cls, turn, {TURNED}, k, bin, log_n FROM shares, turns),
met AS (
  SELECT g.scan_id, g.i - c.i AS px, g.j - c.j AS py, c.turn, c.model_cls, c.i AS ci, c.j AS cj, c.k AS ck, c.seen, CASE WHEN g.log_odds > 0 THEN log_occ ELSE log_free END AS term,
         CASE WHEN g.log_odds > 0 AND a.hit_idx % 3 <> 0 THEN {_bin_sql('(theta - turn*(pi()/2))')} END AS bin
  FROM grid g JOIN turned_cells c ON c.k = g.k AND abs(g.i - c.i) <= {REACH} AND abs(g.j - c.j) <= {REACH} LEFT JOIN aimed a ON a.scan_id = g.scan_id AND a.i = g.i AND a.j = g.j AND a.k = g.k
  WHERE g.log_odds <> 0 AND g.scan_id % 2 = 1)
SELECT scan_id, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, m.turn, m.model_cls, round(sum(term + CASE WHEN m.bin IS NULL THEN 0 WHEN NOT seen THEN ln(1/{BINS}.0::DOUBLE) ELSE coalesce(log_n, ln(1e-4)) END), 6) AS score, count(*) AS n, count(m.bin) AS n_directions
FROM met m LEFT JOIN stencil s ON s.model_cls = m.model_cls AND s.turn = m.turn AND s.i = m.ci AND s.j = m.cj AND s.k = m.ck AND s.bin = m.bin GROUP BY ALL""")
def pose_scores_normals(spark, sf_dir):
    """The score of each pose and quarter turn about the sensor, with the directions of the cells that were hit."""
    m, aimed = grids.marginal(spark, sf_dir), _aimed(spark, sf_dir)
    full = m.select("model_cls").distinct().join(F.broadcast(box_lattice(spark, 2, 2, 1))).join(m, ["model_cls", "i", "j", "k"], "left").na.fill(1, ["c_free", "c_occ"])
    n = F.col("c_free") + F.col("c_occ")
    model = full.select("model_cls", "i", "j", "k", F.ln(F.col("c_free") / n).alias("log_free"), F.ln(F.col("c_occ") / n).alias("log_occ"))
    seen = aimed.where("scan_id % 2 = 0 AND valid_normal").where(models.window(2, 2, 1)).withColumnRenamed("cls", "model_cls")
    normals = models.feature_counts(seen, ["model_cls", "i", "j", "k"])
    grid = scoring.with_features(grids.near(spark, sf_dir).where("scan_id % 2 = 1"), aimed, ["scan_id"])
    return detect.pose_scores_with_normals(grid, model, normals, ["scan_id"], REACH, BINS).withColumn("score", F.round("score", 6))


@query(f"""WITH {HITS_SQL}, c AS (SELECT *, x + a AS cx, y + b AS cy FROM hits, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) p(a), (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) q(b)),
s AS (SELECT scan_id, hit_idx, cx AS depth, (696*cx - 700*cy)/nullif(cx, 0) AS u, (256*cx - 700*z)/nullif(cx, 0) AS v FROM c)
SELECT scan_id, hit_idx FROM s GROUP BY ALL HAVING bool_and(coalesce(depth >= 0 AND u BETWEEN 0 AND 1392 AND v BETWEEN 0 AND 512, false))""")
def objects_in_view(spark, sf_dir):
    matrix = [[696.0, -700.0, 0.0, 0.0], [256.0, 0.0, -700.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    return detect.wholly_in_view(hits(spark, sf_dir), matrix).select("scan_id", "hit_idx")


@query(f"""WITH {HITS_SQL} SELECT scan_id, hit_idx, CASE WHEN abs(x - round(x)) <= 0.25 AND abs(y - round(y)) <= 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS inside FROM hits""")
def box_kernels(spark, sf_dir):
    h = hits(spark, sf_dir)
    return h.select("scan_id", "hit_idx", expr.box_kernel(F.col("x") - F.round("x"), F.col("y") - F.round("y"), 0.25).alias("inside"))
