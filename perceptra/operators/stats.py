"""Mergeable moments of the hits in a voxel, their blur over neighbours, and surface normals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import least_direction

AXES = ("x", "y", "z")


def moment_sums(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products by voxel (G2, G3): plain sums merge by addition."""
    pairs = [(a, b) for n, a in enumerate(AXES) for b in AXES[n:]]
    sums = [F.sum(a).alias(f"s_{a}") for a in (*AXES, "intensity")] + [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in pairs]
    return hits.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def blur27(sums: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Sums over each voxel's 27 neighbours, for voxels with more than least hits (J5, F12): each voxel is sent to its
    neighbours and added up there; only voxels with hits of their own are kept."""
    step = lambda: F.explode(F.sequence(F.lit(-1), F.lit(1)))
    sent = sums.withColumn("_di", step()).withColumn("_dj", step()).withColumn("_dk", step()).withColumn("_own", ((F.col("_di") == 0) & (F.col("_dj") == 0) & (F.col("_dk") == 0)).cast("int"))
    moved = sent.withColumns({c: F.col(c) + F.col(f"_d{c}") for c in "ijk"})
    total = [F.sum(c).alias(c) for c in sums.columns if c == "n" or c.startswith("s_")]
    return moved.groupBy(*keys).agg(*total, F.max("_own").alias("_own")).where((F.col("_own") == 1) & (F.col("n") > least)).drop("_own")


def moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Means, population variances and covariances from the sums."""
    mean = {a: F.col(f"s_{a}") / F.col("n") for a in (*AXES, "intensity")}
    out = {f"mean_{a}": m for a, m in mean.items()}
    for n, a in enumerate(AXES):
        for b in AXES[n:]:
            out[f"cov_{a}{b}"] = F.col(f"s_{a}{b}") / F.col("n") - mean[a] * mean[b]
    return sums.select(*keys, "n", *[c.alias(k) for k, c in out.items()])


def normals(moment: DataFrame) -> DataFrame:
    """Adds theta, phi and valid_normal: the direction of least variance (X20), its largest component made positive. Null or infinite moments have no valid direction."""
    names = [F.col(c) for c in ("cov_xx", "cov_xy", "cov_xz", "cov_yy", "cov_yz", "cov_zz")]
    ok = F.lit(True)
    for c in names:
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    d = moment.withColumn("valid_normal", ok).withColumn("_d", least_direction(*[F.when(F.col("valid_normal"), c).otherwise(0.0) for c in names]))
    flat = F.sqrt(F.col("_d.u") * F.col("_d.u") + F.col("_d.v") * F.col("_d.v"))
    return d.withColumns({"theta": F.atan2("_d.v", "_d.u"), "phi": F.atan2(F.col("_d.w"), flat)}).drop("_d")
