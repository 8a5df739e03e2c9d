"""Queries over ray models, pose lattices and suppression."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import detect, raymodel, sampling, scoring
from ..operators.histogram import Histogram, blur_axis, upper_median
from ..operators.rays import box_lattice
from ..operators.trees import stored
from ..registry import query
from ..sources.adapters import HITS_SQL, hits, table
from . import grids

SIZE, GRAIN = 5.0, (0.5, 1.0)
H = Histogram(-5.0, 5.0, 1.0)
POSE_SQL = """poses AS (SELECT CAST(a*12 + b*4 + c AS INTEGER) AS pose_id, a*2.0 - 2.0 AS px, b*2.0 - 2.0 AS py, c*pi()/2 AS pt FROM range(3) x(a), range(3) y(b), range(4) z(c))"""
SEEN = f"""{HITS_SQL}, {POSE_SQL},
obs AS (SELECT scan_id, cls, hit_idx, sqrt(x*x+y*y) AS r, atan2(y, x) AS theta FROM hits),
m AS (SELECT scan_id, cls, hit_idx, pose_id, theta - pt - 2*pi()*floor((theta - pt)/(2*pi())) AS m_phi, sin(theta)*px - cos(theta)*py AS dist_ray, r - cos(theta)*px - sin(theta)*py AS dist_obs, r FROM obs, poses),
seen AS (SELECT * FROM m WHERE abs(dist_ray) <= 5 AND dist_obs < r AND dist_obs >= -5)"""
KEYED = f"""{SEEN},
keyed AS (
  SELECT *, CAST(round(m_phi/0.5) AS INTEGER) AS k_phi, CAST(round(greatest(-5.0, least(5.0, dist_ray))/1.0) AS INTEGER) AS k_dist,
    CAST(CASE WHEN dist_obs <= -5 THEN 0 WHEN dist_obs >= 5 THEN 12 ELSE floor(dist_obs + 5) + 1 END AS INTEGER) AS bin FROM seen)"""
PREV = f"""{KEYED},
linked AS (
  SELECT *, coalesce(lag(bin) OVER w, last_value(bin) OVER f) AS prev, coalesce(lag(k_phi) OVER w, last_value(k_phi) OVER f) AS p_phi, coalesce(lag(k_dist) OVER w, last_value(k_dist) OVER f) AS p_dist FROM keyed
  WINDOW w AS (PARTITION BY scan_id, pose_id ORDER BY hit_idx), f AS (PARTITION BY scan_id, pose_id ORDER BY hit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
two AS (
  SELECT cls, k_phi, k_dist, prev, bin, count(*)::DOUBLE AS w FROM (
    SELECT cls, scan_id, k_phi, k_dist, prev, bin FROM linked UNION ALL SELECT cls, scan_id, p_phi, p_dist, bin, prev FROM linked) WHERE scan_id % 2 = 0 GROUP BY ALL),
one AS (SELECT cls, k_phi, k_dist, bin, count(*)::DOUBLE AS w FROM keyed WHERE scan_id % 2 = 0 GROUP BY ALL)"""


def poses(spark):
    n = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k)))
    p = spark.range(1).select(n(2).alias("a")).select("a", n(2).alias("b")).select("a", "b", n(3).alias("c"))
    return p.select((F.col("a") * 12 + F.col("b") * 4 + F.col("c")).cast("int").alias("pose_id"), (F.col("a") * 2.0 - 2.0).alias("x"), (F.col("b") * 2.0 - 2.0).alias("y"), (F.col("c") * math.pi / 2).alias("theta"))


def seen(spark, sf_dir):
    obs = raymodel.observations(hits(spark, sf_dir)).select("scan_id", "cls", "hit_idx", "range", "theta", "sin_t", "cos_t")
    return raymodel.seen_from(obs, poses(spark), SIZE)


def keyed(s):
    return raymodel.gram_keys(s, GRAIN)


@query(f"WITH {SEEN} SELECT scan_id, hit_idx, pose_id, round(m_phi, 6) AS m_phi, round(dist_ray, 6) AS dist_ray, round(dist_obs, 6) AS dist_obs FROM seen")
def ray_observation_projection(spark, sf_dir):
    return seen(spark, sf_dir).select("scan_id", "hit_idx", "pose_id", *[F.round(c, 6).alias(c) for c in ("m_phi", "dist_ray", "dist_obs")])


@query(f"WITH {SEEN} SELECT scan_id, pose_id, count(*) AS n FROM seen WHERE abs(dist_ray) <= 2 AND dist_obs >= -2 GROUP BY ALL")
def ray_relevant_to_all(spark, sf_dir):
    return raymodel.relevant_to_all(seen(spark, sf_dir), ["scan_id", "pose_id"], [5.0, 2.0]).groupBy("scan_id", "pose_id").agg(F.count("*").alias("n"))


def _one(s):
    return raymodel.one_gram(s, ["cls"], H, GRAIN)


def _two(s):
    return raymodel.two_gram(s, ["cls"], ["scan_id", "pose_id"], H, GRAIN)


@query(f"WITH {PREV} SELECT * FROM one")
def ray_histogram_1gram(spark, sf_dir):
    return _one(seen(spark, sf_dir).where("scan_id % 2 = 0"))


@query(f"WITH {PREV} SELECT * FROM two")
def ray_histogram_2gram(spark, sf_dir):
    return _two(seen(spark, sf_dir).where("scan_id % 2 = 0"))


@query(f"""WITH {PREV},
n1 AS (SELECT cls, k_phi, k_dist, sum(w) AS n FROM one GROUP BY ALL HAVING sum(w) >= 10),
n2 AS (SELECT cls, k_phi, k_dist, prev, sum(w) AS n FROM two GROUP BY ALL HAVING sum(w) >= 10),
j AS (
  SELECT l.scan_id, l.pose_id, CASE WHEN n2.n IS NOT NULL THEN coalesce(two.w/n2.n, 0) ELSE coalesce(one.w/n1.n, 0) END AS lik
  FROM linked l LEFT JOIN n2 ON (n2.cls, n2.k_phi, n2.k_dist, n2.prev) = (l.cls, l.k_phi, l.k_dist, l.prev)
  LEFT JOIN two ON (two.cls, two.k_phi, two.k_dist, two.prev, two.bin) = (l.cls, l.k_phi, l.k_dist, l.prev, l.bin)
  LEFT JOIN n1 ON (n1.cls, n1.k_phi, n1.k_dist) = (l.cls, l.k_phi, l.k_dist)
  LEFT JOIN one ON (one.cls, one.k_phi, one.k_dist, one.bin) = (l.cls, l.k_phi, l.k_dist, l.bin) WHERE l.scan_id % 2 = 1)
SELECT scan_id, pose_id, round(sum(ln(greatest(lik, 1e-99))), 6) AS score, count(*) AS n FROM j GROUP BY ALL""")
def ray_score_fallback(spark, sf_dir):
    s = stored(seen(spark, sf_dir))
    train, test = s.where("scan_id % 2 = 0"), s.where("scan_id % 2 = 1")
    scored = raymodel.score(test, _one(train), _two(train), ["cls"], ["scan_id", "pose_id"], H, grain=GRAIN)
    return scored.select("scan_id", "pose_id", F.round("score", 6).alias("score"), "n")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, value FROM events)
SELECT user_id, ord, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ord), last_value(value) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev FROM s""")
def circular_previous(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("ord"))
    return raymodel.with_previous(e, ["user_id"], "ord", "value", "prev")


@query(f"WITH {HITS_SQL} SELECT scan_id, hit_idx, CAST((hit_idx - 8 + 16) % 16 AS INTEGER) AS turn FROM hits")
def half_turn_order(spark, sf_dir):
    return raymodel.half_turn_order(hits(spark, sf_dir), ["scan_id"], "hit_idx", 16).select("scan_id", "hit_idx", "turn")


REACH, WINDOW = 4, 2
FULL = f"""{grids.MARGINAL},
lattice AS (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CAST(c AS INTEGER) AS k FROM range(-2, 3) x(a), range(-2, 3) y(b), range(-1, 2) z(c)),
full_model AS (
  SELECT c.model_cls, l.i, l.j, l.k, ln(coalesce(c_free, 1)/(coalesce(c_free, 1)+coalesce(c_occ, 1))) AS log_free, ln(coalesce(c_occ, 1)/(coalesce(c_free, 1)+coalesce(c_occ, 1))) AS log_occ
  FROM (SELECT DISTINCT model_cls FROM marginal) c CROSS JOIN lattice l LEFT JOIN marginal m USING (model_cls, i, j, k)),
pose AS (
  SELECT scan_id, CAST(g.i - m.i AS INTEGER) AS px, CAST(g.j - m.j AS INTEGER) AS py, model_cls, sum(CASE WHEN log_odds > 0 THEN log_occ ELSE log_free END) AS score, count(*) AS n
  FROM grid g JOIN full_model m ON g.k = m.k WHERE log_odds <> 0 AND scan_id % 2 = 1 AND abs(g.i - m.i) <= {REACH} AND abs(g.j - m.j) <= {REACH} GROUP BY ALL),
soft AS (SELECT *, exp(score - max(score) OVER w)/sum(exp(score)) OVER w*exp(max(score) OVER w) AS p FROM pose WINDOW w AS (PARTITION BY scan_id, px, py)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id, px, py ORDER BY score DESC) AS rn, max(score) OVER (PARTITION BY scan_id, px, py) AS top FROM pose),
lo AS (
  SELECT *, score - CASE WHEN rn = 1 THEN max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY scan_id, px, py) ELSE top END AS lead,
    ln(greatest(exp(score - top), 1e-300)/greatest(sum(exp(score - top)) OVER (PARTITION BY scan_id, px, py) - exp(score - top), 1e-300)) AS exact FROM ranked),
logodds AS (SELECT scan_id, px, py, model_cls, round(CASE WHEN abs(lead) > 10 THEN lead ELSE exact END, 6) AS log_odds FROM lo),
of_class AS (SELECT scan_id, px, py, log_odds FROM logodds WHERE model_cls = 0)"""


def pose_scored(spark, sf_dir, cells=grids.near, scores=detect.pose_scores):
    m = grids.marginal(spark, sf_dir)
    full = m.select("model_cls").distinct().join(F.broadcast(box_lattice(spark, 2, 2, 1))).join(m, ["model_cls", "i", "j", "k"], "left").na.fill(1, ["c_free", "c_occ"])
    n = F.col("c_free") + F.col("c_occ")
    model = full.select("model_cls", "i", "j", "k", F.ln(F.col("c_free") / n).alias("log_free"), F.ln(F.col("c_occ") / n).alias("log_occ"))
    return scores(cells(spark, sf_dir).where("scan_id % 2 = 1"), model, ["scan_id"], REACH)


AT = ["scan_id", "px", "py"]


@query(f"WITH {FULL} SELECT scan_id, px, py, model_cls, round(score, 6) AS score, n FROM pose")
def pose_scores(spark, sf_dir):
    return pose_scored(spark, sf_dir, scores=detect.pose_arrays).select(*AT, F.inline("scores")).withColumn("score", F.round("score", 6))


@query(f"WITH {FULL} SELECT scan_id, px, py, model_cls, round(p, 6) AS p FROM soft")
def pose_softmax(spark, sf_dir):
    return scoring.softmax(pose_scored(spark, sf_dir), AT).select(*AT, "model_cls", F.round("p", 6).alias("p"))


def pose_lo(spark, sf_dir, cells=grids.near):
    return scoring.log_odds(pose_scored(spark, sf_dir, cells), AT).select(*AT, "model_cls", F.round("log_odds", 6).alias("log_odds"))


@query(f"WITH {FULL} SELECT * FROM logodds")
def pose_log_odds(spark, sf_dir):
    return pose_lo(spark, sf_dir)


@query(f"""WITH {FULL} SELECT a.* FROM of_class a WHERE NOT EXISTS (
  SELECT 1 FROM of_class b WHERE b.scan_id = a.scan_id AND abs(a.px-b.px) <= {WINDOW} AND abs(a.py-b.py) <= {WINDOW} AND (-b.log_odds, b.px, b.py) < (-a.log_odds, a.px, a.py))
  AND (greatest(abs(px), abs(py)) <= {REACH - WINDOW} OR log_odds >= 0)""")
def nms_local_max(spark, sf_dir):
    one = pose_lo(spark, sf_dir).where("model_cls = 0").drop("model_cls")
    return detect.local_maxima(one, ["scan_id"], "log_odds", WINDOW, REACH)


@query(f"""WITH {FULL}, best AS (SELECT * FROM logodds QUALIFY log_odds = max(log_odds) OVER (PARTITION BY scan_id, px, py)),
one AS (SELECT scan_id, px, py, model_cls, log_odds FROM best)
SELECT a.scan_id, a.px, a.py, a.model_cls, a.log_odds FROM one a WHERE NOT EXISTS (
  SELECT 1 FROM one b WHERE b.scan_id = a.scan_id AND abs(a.px-b.px) <= {WINDOW} AND abs(a.py-b.py) <= {WINDOW} AND (-b.log_odds, b.px, b.py) < (-a.log_odds, a.px, a.py))""")
def nms_over_classes(spark, sf_dir):
    return detect.window_maxima(pose_lo(spark, sf_dir), ["scan_id"], "log_odds", WINDOW)


@query(f"WITH {FULL} SELECT scan_id, px, py, model_cls, log_odds FROM logodds QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY log_odds DESC, px, py, model_cls) <= 5")
def top_detections(spark, sf_dir):
    return sampling.top(pose_lo(spark, sf_dir), ["scan_id"], [F.desc("log_odds"), "px", "py", "model_cls"], 5)


@query(f"WITH {FULL} SELECT scan_id, px, py, round(sum(p), 6) AS p FROM soft WHERE model_cls < 5 GROUP BY ALL")
def class_marginal(spark, sf_dir):
    few = lambda r: r["model_cls"] < 5
    poses = pose_scored(spark, sf_dir, scores=detect.pose_arrays).where(F.exists("scores", few))
    return poses.select(*AT, F.round(scoring.softmax_of("scores", few), 6).alias("p"))


#: The queries above see a grid only within the class models' window, as their SQL does; those below see all cells that any pose reaches.
REACHED = f"abs(i) <= {REACH + 2} AND abs(j) <= {REACH + 2} AND abs(k) <= 1"
WHOLE = FULL.replace(f"FROM cells WHERE {grids.IN_SIZE}", f"FROM cells WHERE {REACHED}").replace("FROM grid WHERE scan_id % 2 = 0", f"FROM grid WHERE {grids.IN_SIZE} AND scan_id % 2 = 0")


def reached(spark, sf_dir):
    return grids.grid(spark, sf_dir).where(REACHED)


@query(f"""WITH RECURSIVE {WHOLE},
turns AS (SELECT scan_id, model_cls, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, log_odds, row_number() OVER (PARTITION BY scan_id, model_cls ORDER BY log_odds DESC, px, py) AS turn FROM logodds),
taking AS (
  SELECT DISTINCT scan_id, model_cls, CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept, false AS takes, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS log_odds FROM turns UNION ALL
  SELECT scan_id, model_cls, turn, CASE WHEN takes THEN list_append(kept, {{'x': x, 'y': y}}) ELSE kept END, takes, x, y, log_odds FROM (
    SELECT n.*, t.kept, len(list_filter(t.kept, lambda k: (k.x - n.x)**2 + (k.y - n.y)**2 < 9)) = 0 AS takes FROM taking t JOIN turns n ON n.scan_id = t.scan_id AND n.model_cls = t.model_cls AND n.turn = t.turn + 1))
SELECT scan_id, model_cls, x, y, log_odds FROM taking WHERE takes""")
def nms_greedy_radius(spark, sf_dir):
    each = pose_lo(spark, sf_dir, reached).select("scan_id", "model_cls", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), "log_odds")
    return detect.greedy_radius(each, ["scan_id", "model_cls"], "log_odds", 3.0, each.schema.simpleString()[7:-1])


@query(f"WITH {WHOLE} SELECT scan_id, px, py, model_cls, round(score, 6) AS score, n FROM pose")
def pose_scores_whole(spark, sf_dir):
    return pose_scored(spark, sf_dir, reached, detect.pose_arrays).select(*AT, F.inline("scores")).withColumn("score", F.round("score", 6))


@query(f"WITH {WHOLE} SELECT scan_id, px, py, model_cls, round(p, 6) AS p FROM soft")
def pose_softmax_whole(spark, sf_dir):
    return scoring.softmax(pose_scored(spark, sf_dir, reached), AT).select(*AT, "model_cls", F.round("p", 6).alias("p"))


@query(f"WITH {WHOLE} SELECT * FROM logodds")
def pose_log_odds_whole(spark, sf_dir):
    return pose_lo(spark, sf_dir, reached)


@query(f"""WITH {WHOLE}, best AS (SELECT * FROM logodds QUALIFY log_odds = max(log_odds) OVER (PARTITION BY scan_id, px, py))
SELECT a.scan_id, a.px, a.py, a.model_cls, a.log_odds FROM best a WHERE NOT EXISTS (
  SELECT 1 FROM best b WHERE b.scan_id = a.scan_id AND abs(a.px-b.px) <= {WINDOW} AND abs(a.py-b.py) <= {WINDOW} AND (-b.log_odds, b.px, b.py) < (-a.log_odds, a.px, a.py))""")
def nms_over_classes_whole(spark, sf_dir):
    return detect.window_maxima(pose_lo(spark, sf_dir, reached), ["scan_id"], "log_odds", WINDOW)


@query(f"WITH {WHOLE} SELECT scan_id, px, py, model_cls, log_odds FROM logodds QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY log_odds DESC, px, py, model_cls) <= 5")
def top_detections_whole(spark, sf_dir):
    return sampling.top(pose_lo(spark, sf_dir, reached), ["scan_id"], [F.desc("log_odds"), "px", "py", "model_cls"], 5)


@query(f"""WITH {WHOLE} SELECT a.* FROM logodds a WHERE NOT EXISTS (
  SELECT 1 FROM logodds b WHERE b.scan_id = a.scan_id AND b.model_cls = a.model_cls AND abs(a.px-b.px) <= {WINDOW} AND abs(a.py-b.py) <= {WINDOW} AND (-b.log_odds, b.px, b.py) < (-a.log_odds, a.px, a.py))
  AND (greatest(abs(px), abs(py)) <= {REACH - WINDOW} OR log_odds >= 0)""")
def nms_local_max_whole(spark, sf_dir):
    return detect.local_maxima(pose_lo(spark, sf_dir, reached), ["scan_id", "model_cls"], "log_odds", WINDOW, REACH)


@query(f"WITH {WHOLE} SELECT scan_id, px, py, round(sum(p), 6) AS p FROM soft GROUP BY ALL")
def class_marginal_whole(spark, sf_dir):
    return pose_scored(spark, sf_dir, reached, detect.pose_arrays).select(*AT, F.round(scoring.softmax_of("scores"), 6).alias("p"))


@query(f"""WITH {KEYED}, h AS (SELECT cls, k_phi, k_dist, count(*)::DOUBLE AS w FROM keyed GROUP BY ALL),
a AS (SELECT cls, pmod, k_dist, sum(w) AS w FROM (SELECT cls, CAST(((k_phi + d) % 13 + 13) % 13 AS INTEGER) AS pmod, k_dist, w*exp(-(d*d)/2.0) AS w FROM h, range(-3, 4) r(d)) GROUP BY ALL)
SELECT cls, pmod AS k_phi, CAST(k_dist + d AS INTEGER) AS k_dist, round(sum(w*exp(-(d*d)/2.0)), 6) AS w FROM a, range(-3, 4) r(d) GROUP BY ALL""")
def bank_blur_whole(spark, sf_dir):
    keys = ["cls", "k_phi", "k_dist"]
    h = keyed(seen(spark, sf_dir)).groupBy(*keys).agg(F.count("*").cast("double").alias("w"))
    return blur_axis(blur_axis(h, keys, "k_phi", 1.0, wrap=13), keys, "k_dist", 1.0).withColumn("w", F.round("w", 6))


ALL_PREV = PREV.replace(" WHERE scan_id % 2 = 0 GROUP BY ALL", " GROUP BY ALL")


@query(f"WITH {ALL_PREV} SELECT * FROM one")
def ray_histogram_1gram_whole(spark, sf_dir):
    return _one(seen(spark, sf_dir))


@query(f"WITH {ALL_PREV} SELECT * FROM two")
def ray_histogram_2gram_whole(spark, sf_dir):
    return _two(seen(spark, sf_dir))


@query("""SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY""")
def interval_join_active(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate")
    return detect.active_at(o, li, "o_orderdate", 30, "l_shipdate", ["k"]).select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


NEAR = "p AS (SELECT scan_id, hit_idx, x, y FROM hits WHERE hit_idx >= 4), o AS (SELECT scan_id, x, y FROM hits WHERE hit_idx < 4)"


@query(f"WITH {HITS_SQL}, {NEAR} SELECT scan_id, hit_idx FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.scan_id = p.scan_id AND abs(o.x-p.x) < 1.0 AND abs(o.y-p.y) < 1.0)")
def anti_join_too_close(spark, sf_dir):
    h = hits(spark, sf_dir)
    return detect.not_too_close(h.where("hit_idx >= 4"), h.where("hit_idx < 4"), ["scan_id"], 1.0).select("scan_id", "hit_idx")


@query(f"""WITH {HITS_SQL}, p AS (SELECT scan_id, hit_idx, x, y FROM hits WHERE hit_idx >= 2),
b AS (SELECT scan_id, hit_idx AS box_id, 'type' || hit_idx AS type, x AS cx, y AS cy, 1.5 AS hx, 0.8 AS hy, scan_id % 6*0.5 AS t FROM hits WHERE hit_idx < 2),
m AS (SELECT p.scan_id, p.hit_idx, box_id, type, abs(cos(t)*(x-cx) + sin(t)*(y-cy)) AS u, abs(cos(t)*(y-cy) - sin(t)*(x-cx)) AS v, hx, hy FROM p JOIN b ON b.scan_id = p.scan_id)
SELECT scan_id, hit_idx AS point_id, coalesce(arg_min(type, CASE WHEN u <= hx AND v <= hy THEN box_id END), CASE WHEN bool_or(u <= hx + 0.5 AND v <= hy + 0.5) THEN 'Closeish' ELSE 'Background' END) AS label
FROM m GROUP BY scan_id, hit_idx""")
def point_in_box_label(spark, sf_dir):
    h = hits(spark, sf_dir)
    b = h.where("hit_idx < 2").select("scan_id", F.col("hit_idx").alias("box_id"), F.concat(F.lit("type"), F.col("hit_idx").cast("string")).alias("type"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(1.5).alias("half_x"), F.lit(0.8).alias("half_y"), (F.col("scan_id") % 6 * 0.5).alias("heading"))
    return detect.in_labelled_box(h.where("hit_idx >= 2").withColumnRenamed("hit_idx", "point_id"), b, ["scan_id"], 0.5)


CAMERA = [[700.0, 0.0, 696.0, 0.0], [0.0, 700.0, 256.0, 0.0], [0.0, 0.0, 1.0, 0.0]]


@query(f"""WITH {HITS_SQL}, c AS (SELECT scan_id, hit_idx, -y AS cx, -z AS cy, x AS cz FROM hits)
SELECT scan_id, hit_idx, round((700*cx + 696*cz)/cz, 4) AS u, round((700*cy + 256*cz)/cz, 4) AS v FROM c
WHERE cz > 0 AND (700*cx + 696*cz)/cz BETWEEN 0 AND 1392 AND (700*cy + 256*cz)/cz BETWEEN 0 AND 512""")
def camera_view(spark, sf_dir):
    c = hits(spark, sf_dir).select("scan_id", "hit_idx", (-F.col("y")).alias("x"), (-F.col("z")).alias("y"), F.col("x").alias("z"))
    return detect.camera_view(c, CAMERA).select("scan_id", "hit_idx", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query(f"""WITH {KEYED}, h AS (SELECT k_phi, k_dist, count(*)::DOUBLE AS w FROM keyed WHERE cls = 0 GROUP BY ALL),
a AS (SELECT pmod, k_dist, sum(w) AS w FROM (SELECT CAST(((k_phi + d) % 13 + 13) % 13 AS INTEGER) AS pmod, k_dist, w*exp(-(d*d)/2.0) AS w FROM h, range(-3, 4) r(d)) GROUP BY ALL)
SELECT pmod AS k_phi, CAST(k_dist + d AS INTEGER) AS k_dist, round(sum(w*exp(-(d*d)/2.0)), 6) AS w FROM a, range(-3, 4) r(d) GROUP BY ALL""")
def bank_blur(spark, sf_dir):
    h = keyed(seen(spark, sf_dir).where("cls = 0")).groupBy("k_phi", "k_dist").agg(F.count("*").cast("double").alias("w"))
    h = blur_axis(h, ["k_phi", "k_dist"], "k_phi", 1.0, wrap=13)
    return blur_axis(h, ["k_phi", "k_dist"], "k_dist", 1.0).withColumn("w", F.round("w", 6))


@query(f"""WITH {KEYED}, h AS (SELECT cls, k_phi, k_dist, count(*)::DOUBLE AS w FROM keyed GROUP BY ALL), s AS (SELECT cls, k_phi, list_sort(list(w)) AS l FROM h GROUP BY ALL)
SELECT cls, k_phi, len(l)/11.0::DOUBLE AS fill, l[len(l)//2 + 1] AS median_w FROM s""")
def bank_coverage(spark, sf_dir):
    h = keyed(seen(spark, sf_dir)).groupBy("cls", "k_phi", "k_dist").agg(F.count("*").cast("double").alias("w"))
    return h.groupBy("cls", "k_phi").agg((F.count("*") / 11.0).alias("fill"), upper_median(F.collect_list("w")).alias("median_w"))
