"""Queries over the ray model in space."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import raymodel
from ..operators.histogram import blur_bank
from ..operators.trees import stored
from ..registry import query
from ..sources.adapters import HITS_SQL, hits
from .detection import POSE_SQL, H, poses

#: Half an object's extent in the plane and in height; steps of angle and distance; deviations of the blur, angle and distance.
SIZE, HEIGHT, GRAIN, DEVIATIONS = 5.0, 2.5, (0.2, 0.2), (math.radians(10.0), 0.15)

#: The poses of the plane moved off the sensor, at which every ray would end exactly as far as the object.
POSES = POSE_SQL.replace("a*2.0 - 2.0", "a*2.0 - 2.5").replace("b*2.0 - 2.0", "b*2.0 - 2.25")

SEEN = f"""{HITS_SQL}, {POSES},
polar AS (SELECT scan_id, cls, hit_idx, sqrt(x*x+y*y) AS flat, sqrt(x*x+y*y+z*z) AS range, atan2(y, x) AS theta, atan2(z, sqrt(x*x+y*y)) AS phi FROM hits),
m AS (
  SELECT scan_id, cls, hit_idx, pose_id, range, theta - pt AS turn, phi AS m_phi, sin(theta)*px - cos(theta)*py AS dist_ray, (flat - cos(theta)*px - sin(theta)*py)/cos(phi) AS dist_obs,
         -sqrt(px*px+py*py)*sin(phi) AS dist_z FROM polar, poses),
seen AS (
  SELECT *, CASE WHEN turn BETWEEN -pi() AND pi() THEN turn ELSE turn - 2*pi()*ceil((turn-pi())/(2*pi())) END AS m_theta FROM m
  WHERE abs(dist_ray) <= 5 AND abs(dist_z) <= 2.5 AND dist_obs >= -5 AND dist_obs < range),
keyed AS (
  SELECT *, CAST(floor(m_theta/0.2) AS INTEGER) AS k_theta, CAST(floor(m_phi/0.2) AS INTEGER) AS k_phi, CAST(floor(dist_ray/0.2) AS INTEGER) AS k_ray, CAST(floor(dist_z/0.2) AS INTEGER) AS k_z,
         CAST(CASE WHEN dist_obs <= -5 THEN 0 WHEN dist_obs >= 5 THEN 12 ELSE floor(dist_obs + 5) + 1 END AS INTEGER) AS bin FROM seen)"""
K = "k_theta, k_phi, k_ray, k_z"


def seen(spark, sf_dir):
    obs = raymodel.observations_3d(hits(spark, sf_dir)).select("scan_id", "cls", "hit_idx", "range", "range_xy", "theta", "phi", "sin_t", "cos_t", "sin_p", "cos_p")
    moved = poses(spark).withColumns({"x": F.col("x") - 0.5, "y": F.col("y") - 0.25})
    return raymodel.seen_from_3d(obs, moved, SIZE, HEIGHT)


@query(f"WITH {SEEN} SELECT scan_id, hit_idx, pose_id, round(m_theta, 6) AS m_theta, round(m_phi, 6) AS m_phi, round(dist_ray, 6) AS dist_ray, round(dist_z, 6) AS dist_z, round(dist_obs, 6) AS dist_obs FROM seen")
def ray3d_observation_projection(spark, sf_dir):
    return seen(spark, sf_dir).select("scan_id", "hit_idx", "pose_id", *[F.round(c, 6).alias(c) for c in ("m_theta", "m_phi", "dist_ray", "dist_z", "dist_obs")])


@query(f"WITH {SEEN} SELECT cls, {K}, bin, count(*)::DOUBLE AS w FROM keyed GROUP BY ALL")
def ray3d_histogram(spark, sf_dir):
    return raymodel.one_gram_3d(seen(spark, sf_dir), ["cls"], H, GRAIN)


@query(f"""WITH {SEEN}, one AS (SELECT cls, {K}, bin, count(*)::DOUBLE AS w FROM keyed WHERE scan_id % 2 = 0 GROUP BY ALL), n AS (SELECT cls, {K}, sum(w) AS n FROM one GROUP BY ALL)
SELECT scan_id, pose_id, round(sum(CASE WHEN n.n IS NULL THEN 0 WHEN n.n < 10 OR one.w IS NULL THEN ln(1e-99) ELSE ln(greatest(one.w/n.n, 1e-99)) END), 6) AS score, count(*) AS n, count(n.n) AS n_known
FROM (SELECT * FROM keyed WHERE scan_id % 2 = 1) t LEFT JOIN n USING (cls, {K}) LEFT JOIN one USING (cls, {K}, bin) GROUP BY ALL""")
def ray3d_score(spark, sf_dir):
    s = stored(seen(spark, sf_dir))
    scored = raymodel.score_3d(s.where("scan_id % 2 = 1"), raymodel.one_gram_3d(s.where("scan_id % 2 = 0"), ["cls"], H, GRAIN), ["cls"], ["scan_id", "pose_id"], H, grain=GRAIN)
    return scored.withColumn("score", F.round("score", 6))


def _blurred(axis: str, before: str, deviation: float, step: float) -> str:
    reach, sigma = math.floor(3 * deviation / step), deviation / step
    columns = ", ".join(f"{c} + d AS {c}" if c == axis else c for c in K.split(", "))
    return f"b_{axis} AS (SELECT cls, bin, {columns}, sum(w*exp(-d*d/{2 * sigma * sigma!r}::DOUBLE)) AS w FROM {before}, (SELECT CAST(d AS INTEGER) AS d FROM range(-{reach}, {reach + 1}) r(d)) GROUP BY ALL)"


AXES = dict(zip(K.split(", "), (DEVIATIONS[0] / GRAIN[0], DEVIATIONS[0] / GRAIN[0], DEVIATIONS[1] / GRAIN[1], DEVIATIONS[1] / GRAIN[1]), strict=True))
BLUR = ", ".join(_blurred(a, b, DEVIATIONS[n // 2], GRAIN[n // 2]) for n, (a, b) in enumerate(zip(AXES, ["one", "b_k_theta", "b_k_phi", "b_k_ray"], strict=True)))


@query(f"""WITH {SEEN}, one AS (SELECT cls, {K}, bin, count(*)::DOUBLE AS w FROM keyed WHERE pose_id < 4 GROUP BY ALL), {BLUR}
SELECT cls, k_theta, k_phi, bin, round(sum(w), 4) AS w, count(*) AS n FROM b_k_z GROUP BY ALL""")
def bank_blur_4axis(spark, sf_dir):
    """The bank of the poses about one place, blurred along all axes and summed over distance."""
    one = raymodel.one_gram_3d(seen(spark, sf_dir).where("pose_id < 4"), ["cls"], H, GRAIN)
    b = blur_bank(one, AXES, ["cls", "bin", *AXES])
    return b.groupBy("cls", "k_theta", "k_phi", "bin").agg(F.round(F.sum("w"), 4).alias("w"), F.count("*").alias("n"))


@query(f"""WITH {SEEN}, one AS (SELECT cls, {K}, bin, count(*)::DOUBLE AS w FROM keyed GROUP BY ALL), {BLUR}
SELECT cls, k_theta, k_phi, bin, round(sum(w), 4) AS w, count(*) AS n FROM b_k_z GROUP BY ALL""")
def bank_blur_4axis_whole(spark, sf_dir):
    """The bank of all poses, blurred along all axes and summed over distance."""
    b = blur_bank(raymodel.one_gram_3d(seen(spark, sf_dir), ["cls"], H, GRAIN), AXES, ["cls", "bin", *AXES])
    return b.groupBy("cls", "k_theta", "k_phi", "bin").agg(F.round(F.sum("w"), 4).alias("w"), F.count("*").alias("n"))
