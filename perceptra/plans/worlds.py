"""Queries over synthetic worlds, streams and projections."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import expr
from ..operators import simworld
from ..registry import query
from ..sources.adapters import HITS_SQL, hits, table
from ..streaming import counts
from . import grids


@query()
def world_scan(spark, sf_dir):
    return simworld.scan(simworld.worlds(spark, 20, 12, 7)).select("world", "ray", "shape", "name", F.round("range", 6).alias("range"))


@query()
def world_visibility(spark, sf_dir):
    shapes = simworld.worlds(spark, 20, 12, 7)
    at = spark.range(20).select(F.col("id").alias("world"), F.explode(F.sequence(F.lit(0), F.lit(399))).alias("point_id")).select("world", "point_id", (F.col("point_id") % 20 * 2.0 - 19).alias("x"), (F.floor(F.col("point_id") / 20) * 2.0 - 19).alias("y"))
    return simworld.visible(simworld.inside(at, shapes), simworld.scan(shapes))


@query()
def toy_classes(spark, sf_dir):
    return simworld.toy(spark, "boundary", 1000, 3)


@query(f"""WITH {grids.grid_sql(1.0)} SELECT cls, i, j, k, CAST(sum(n_free) AS BIGINT) AS n_free, CAST(sum(n_occ) AS BIGINT) AS n_occ FROM grid GROUP BY ALL""", "trainer_additive_counts")
def trainer_additive_counts(spark, sf_dir):
    return counts.voxel_counts(hits(spark, sf_dir), 1.0, ["cls"])


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark, sf_dir):
    return counts.windowed(table(spark, sf_dir, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf_dir):
    return counts.sessions(table(spark, sf_dir, "events"), "6 hours")


@query(f"""WITH {HITS_SQL}, a AS (SELECT scan_id, hit_idx, atan2(y, x)*3 AS a FROM hits)
SELECT scan_id, hit_idx, round(CASE WHEN a BETWEEN -pi() AND pi() THEN a ELSE a - 2*pi()*ceil((a-pi())/(2*pi())) END, 9) AS wrapped FROM a""")
def wrapped_angles(spark, sf_dir):
    a = hits(spark, sf_dir).select("scan_id", "hit_idx", (F.atan2("y", "x") * 3).alias("a"))
    return a.select("scan_id", "hit_idx", F.round(expr.wrap_angle("a"), 9).alias("wrapped"))


@query(f"""WITH {HITS_SQL}, t AS (SELECT *, scan_id % 5*0.5 AS ox, scan_id % 3*0.5 AS oz, scan_id % 7*0.3 AS h FROM hits)
SELECT scan_id, hit_idx, round(cos(h)*(x-ox) - sin(h)*(z-oz), 6) AS u, round(y, 6) AS v, round(sin(h)*(x-ox) + cos(h)*(z-oz), 6) AS w FROM t""")
def object_frame(spark, sf_dir):
    s = F.col("scan_id")
    u, v, w = expr.into_object("x", "y", "z", s % 5 * 0.5, F.lit(0.0), s % 3 * 0.5, s % 7 * 0.3)
    return hits(spark, sf_dir).select("scan_id", "hit_idx", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(w, 6).alias("w"))


@query(f"""WITH {HITS_SQL}, c AS (SELECT scan_id, hit_idx, x, y, z, scan_id % 7*0.3 AS h FROM hits WHERE x > 4),
k AS (SELECT *, a*0.5*4.0 AS dx, b*0.5*1.6 AS dy, d*0.5*1.5 AS dz FROM c, (VALUES (-1), (1)) p(a), (VALUES (-1), (1)) q(b), (VALUES (-1), (1)) r(d)),
m AS (SELECT scan_id, hit_idx, x + cos(h)*dx - sin(h)*dy AS bx, y + sin(h)*dx + cos(h)*dy AS by_, z + dz AS bz FROM k),
i AS (SELECT scan_id, hit_idx, (-700*by_ + 696*bx)/bx AS u, (-700*bz + 256*bx)/bx AS v FROM m)
SELECT scan_id, hit_idx, round(least(2000, min(u)), 4) AS "left", round(least(2000, min(v)), 4) AS top, round(greatest(0, max(u)), 4) AS "right", round(greatest(0, max(v)), 4) AS bottom FROM i GROUP BY ALL""")
def box_extents(spark, sf_dir):
    matrix = [[696.0, -700.0, 0.0, 0.0], [256.0, 0.0, -700.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    e = expr.box_extent("x", "y", "z", F.col("scan_id") % 7 * 0.3, matrix)
    return hits(spark, sf_dir).where("x > 4").select("scan_id", "hit_idx", *[F.round(c, 4).alias(n) for n, c in e.items()])


@query(f"WITH {HITS_SQL} SELECT scan_id, hit_idx, CAST(CASE WHEN x >= -6 AND x < 6 THEN floor((x+6)/0.4) END AS INTEGER) AS ix, round(CASE WHEN x >= -6 AND x < 6 THEN floor((x+6)/0.4)*0.4 + 0.2 - 6 END, 6) AS centre, round(least(1, greatest(0, (z+2)/4)), 6) AS shade FROM hits")
def lattice_cells(spark, sf_dir):
    i = expr.lattice_index("x", -6.0, 6.0, 0.4)
    return hits(spark, sf_dir).select("scan_id", "hit_idx", i.alias("ix"), F.round(expr.lattice_centre(i, -6.0, 0.4), 6).alias("centre"), F.round(expr.ramp("z", -2.0, 2.0), 6).alias("shade"))


@query("""SELECT user_id, event_id, round(ln(least(1-1e-16, greatest(1e-16, value/500))/(1-least(1-1e-16, greatest(1e-16, value/500)))), 6) AS logit FROM events""")
def clamped_logit(spark, sf_dir):
    from ..operators.scoring import logit

    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(logit(F.col("value") / 500), 6).alias("logit"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda t: abs(t[1]-t[2])))/64, 9) AS l1, CAST(len(list_filter(list_zip(a, b), lambda t: abs(t[1]-t[2]) > 0.01)) AS INTEGER) AS mismatches FROM p""")
def completion_loss(spark, sf_dir):
    from ..operators.evaluate import completion_loss as loss

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return loss(p, "a", "b", ["vec_id"]).withColumn("l1", F.round("l1", 9))


@query("SELECT s.a AS steps, CAST(round(s.a*0.37 - 5) AS INTEGER) AS cell, round(CASE WHEN s.a/50.0 <= 1 THEN (2+cos(2*pi()*s.a/50.0))/3*(1-s.a/50.0)+sin(2*pi()*s.a/50.0)/(2*pi()) ELSE 0 END, 9) AS kernel, round(exp(0 - ((s.a/50.0)**2)/0.25), 9) AS rbf FROM range(100) s(a)")
def kernels(spark, sf_dir):
    d = spark.range(100).select(F.col("id").alias("steps"))
    q = F.col("steps") / 50.0
    return d.select("steps", expr.quantise(F.col("steps") * 0.37 - 5, 1.0).alias("cell"), F.round(expr.sparse_kernel(q), 9).alias("kernel"), F.round(expr.rbf_kernel(q**2), 9).alias("rbf"))


def _channel(turn: int) -> str:
    k = f"((h/60 + {turn}) - 6*floor((h/60 + {turn})/6))"
    return f"(0.9 - 0.9*s*greatest(0.0, least({k}, 4 - {k}, 1.0)))"


@query(f"""WITH {HITS_SQL}, a AS (SELECT scan_id, hit_idx, z, atan2(y, x) AS t, atan2(z, sqrt(x*x+y*y)) AS p FROM hits),
c AS (SELECT scan_id, hit_idx, least(1, greatest(0, (z+2)/4)) AS heat, 2*(CASE WHEN t < 0 THEN t + pi() ELSE t END)*180/pi() AS h, 1 - least(1.0, abs(p)/(pi()/4)) AS s FROM a)
SELECT scan_id, hit_idx, round({_channel(5)}, 6) AS r, round({_channel(3)}, 6) AS g, round({_channel(1)}, 6) AS b, round(heat, 6) AS height_r, round(1 - heat, 6) AS height_b, round(CASE WHEN 0.9*s < 1e-5 THEN 0 ELSE s END, 6) AS saturation FROM c""")
def direction_colours(spark, sf_dir):
    p = expr.polar("x", "y", "z")
    h = hits(spark, sf_dir).withColumns({"theta": p["theta"], "phi": p["phi"]})
    h = h.withColumns({**expr.direction_colour("theta", "phi"), **{f"height_{k}": c for k, c in expr.heat("z", -2.0, 2.0).items()}})
    h = h.withColumn("saturation", expr.rgb_to_hsv("r", "g", "b")["s"])
    return h.select("scan_id", "hit_idx", *[F.round(c, 6).alias(c) for c in ("r", "g", "b", "height_r", "height_b", "saturation")])
