"""Synthetic worlds of convex and star shapes, their scans, and visibility."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = "world long, shape int, name string, x double, y double, angle double, corner int, cx double, cy double"
HALF, EMPTY, ATTEMPTS = 20.0, 10.0, 1000


def outline(name: str, x: float, y: float, angle: float) -> np.ndarray:
    if name == "BOX":
        p = np.array([(1.5, 0.9), (-1.5, 0.9), (-1.5, -0.9), (1.5, -0.9)])
    else:
        t = np.arange(10) * math.pi / 5
        r = np.where(np.arange(10) % 2 == 0, 1.5, 0.7)
        p = np.column_stack([r * np.cos(t), r * np.sin(t)])
    c, s = math.cos(angle), math.sin(angle)
    return p @ np.array([[c, s], [-s, c]]) + (x, y)


def worlds(spark: SparkSession, n: int, shapes: int, seed: int) -> DataFrame:
    """Corner rows of worlds (S16): shapes are drawn one after the other, and again where they overlap or stand in the empty middle."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        world = int(pdf.world.iloc[0])
        rng, placed, rows = np.random.default_rng([seed, world]), [], []
        for _ in range(ATTEMPTS):
            if len(placed) == shapes:
                break
            x, y, a, name = rng.uniform(-HALF, HALF), rng.uniform(-HALF, HALF), rng.uniform(0, 2 * math.pi), ("BOX", "STAR")[rng.integers(2)]
            if abs(x) < EMPTY and abs(y) < EMPTY or any(math.hypot(x - p, y - q) < 3.6 for p, q in placed):
                continue
            rows += [(world, len(placed), name, x, y, a, k, *c) for k, c in enumerate(outline(name, x, y, a).tolist())]
            placed.append((x, y))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SHAPES.split(", ")])

    return spark.range(n).withColumnRenamed("id", "world").groupBy("world").applyInPandas(build, SHAPES)


def edges(shapes: DataFrame) -> DataFrame:
    """Edges of the outlines: each corner and the next, the last with the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("world", "shape").orderBy("corner")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return shapes.select("world", "shape", "name", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.coalesce(F.lead("cx").over(w), F.first("cx").over(first)).alias("bx"), F.coalesce(F.lead("cy").over(w), F.first("cy").over(first)).alias("by"))


def scan(shapes: DataFrame, rays: int = 629, far: float = 100.0) -> DataFrame:
    """Nearest hit of each ray from the origin (J20): a world's edges meet the few rays their arc spans, the least distance by ray."""
    e = edges(shapes)
    step = 2 * math.pi / rays
    ta, tb = F.atan2("ay", "ax"), F.atan2("by", "bx")
    turn = tb - ta - 2 * math.pi * F.round((tb - ta) / (2 * math.pi))
    lo, hi = F.least(ta, ta + turn), F.greatest(ta, ta + turn)
    ray = e.withColumn("_k", F.explode(F.sequence(F.ceil(lo / step), F.greatest(F.ceil(lo / step), F.floor(hi / step)))))
    ray = ray.withColumns({"ray": F.pmod(F.col("_k"), F.lit(rays)).cast("int"), "_t": F.col("_k") * step})
    dx, dy, ex, ey = F.cos("_t"), F.sin("_t"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    det = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    r, s = (F.col("ax") * ey - F.col("ay") * ex) / det, (F.col("ax") * dy - F.col("ay") * dx) / det
    hit = ray.withColumns({"range": r, "_s": s, "theta": F.col("_t")}).where((F.col("range") > 0) & (F.col("range") < far) & (F.col("_s") >= 0) & (F.col("_s") <= 1))
    return hit.groupBy("world", "ray").agg(F.min("range").alias("range"), F.min_by("name", "range").alias("name"), F.min_by("shape", "range").alias("shape"), F.first("theta").alias("theta"))


def inside(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points with the shape that holds them (F10), by the parity of crossed edges; points has world, point_id, x, y."""
    e = edges(shapes).select("world", "shape", "ax", "ay", "bx", "by")
    cross = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax"))
    met = points.join(e, "world").where(cross).groupBy("world", "point_id", "shape").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return points.join(met.groupBy("world", "point_id").agg(F.min("shape").alias("shape")), ["world", "point_id"], "left")


def visible(points: DataFrame, hits: DataFrame, rays: int = 629) -> DataFrame:
    """Whether each point lies no farther than the first hit of its ray."""
    p = points.withColumn("ray", F.pmod(F.round(F.atan2("y", "x") / (2 * math.pi / rays)), F.lit(rays)).cast("int"))
    seen = p.join(hits.select("world", "ray", F.col("range").alias("_r")), ["world", "ray"], "left")
    return seen.withColumn("visible", F.coalesce(F.col("_r") >= F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), F.lit(True))).drop("_r", "ray")


def crossing(a: DataFrame) -> DataFrame:
    """Pairs of shapes of a world whose edges cross."""
    e = edges(a)
    o = e.select("world", *[F.col(c).alias(f"o_{c}") for c in ("shape", "ax", "ay", "bx", "by")])
    side = lambda px, py, qx, qy, x, y: (F.col(qx) - F.col(px)) * (F.col(y) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(x) - F.col(px))
    one = side("ax", "ay", "bx", "by", "o_ax", "o_ay") * side("ax", "ay", "bx", "by", "o_bx", "o_by") < 0
    two = side("o_ax", "o_ay", "o_bx", "o_by", "ax", "ay") * side("o_ax", "o_ay", "o_bx", "o_by", "bx", "by") < 0
    return e.join(o, "world").where((F.col("shape") < F.col("o_shape")) & one & two).select("world", "shape", "o_shape").distinct()


def toy(spark: SparkSession, kind: str, n: int, seed: int) -> DataFrame:
    """Regression and classification data (S18): sin, sinc, boundary, circle."""
    d = spark.range(n).select(F.col("id"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"), F.randn(seed + 2).alias("e"))
    if kind == "sin":
        return d.select("id", (F.col("u") * 2 * math.pi).alias("x")).join(d.select("id", "e"), "id").select("id", "x", (F.sin("x") + 0.2 * F.col("e")).alias("y"))
    if kind == "sinc":
        x = F.col("u") * 20 - 10
        return d.select("id", x.alias("x"), (F.when(x == 0, 1.0).otherwise(F.sin(x) / x) + 0.2 * F.col("e")).alias("y"))
    label = F.col("v") > 0.2 * F.sin(2 * math.pi * F.col("u")) if kind == "boundary" else (F.col("u") - 0.5) ** 2 + (F.col("v") - 0.5) ** 2 < 0.33**2
    return d.select("id", F.col("u").alias("x0"), F.col("v").alias("x1"), label.cast("int").alias("label"))
