"""Deterministic and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums


def systematic(rows: DataFrame, by: list[str], order: str, weight: str, draws: int, least: int = 10) -> DataFrame:
    """Rows at which the running weight passes another 1 / draws of its group's total (W8); small groups whole. Integer weights keep it exact."""
    r = running_sums(rows, by, [order], {"_run": F.col(weight), "_n": F.lit(1)})
    step = lambda c: F.floor(c * draws / F.col("_run_total"))
    taken = r.where((F.col("_n_total") < least) | (step(F.col("_run")) > step(F.col("_run") - F.col(weight))))
    return taken.select(*rows.columns)


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Random order (T5): that of a hash of the row and the seed, so other partitions and tasks that run again give the same; equal rows lie side by side."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)


def class_counts(rows: DataFrame, by: list[str], enough: int = 100_000) -> DataFrame:
    """Samples by class and whether there are enough."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= enough)


def bucketed(rows: DataFrame, bucket: list[str], order: list[str]) -> DataFrame:
    """Rows of a bucket together and in order."""
    return rows.repartition(*bucket).sortWithinPartitions(*bucket, *order)


def balanced(rows: DataFrame, by: str, order: str) -> DataFrame:
    """As many rows of each class as the smallest has (T6), in the given order."""
    least = rows.groupBy(by).count().agg(F.min("count").alias("_m"))
    numbered = running_sums(rows, [by], [order], {"_n": F.lit(1)})
    return numbered.join(F.broadcast(least)).where("_n <= _m").select(*rows.columns)


def stride(rows: DataFrame, by: list[str], order: list[str], step: int) -> DataFrame:
    """Every step-th row of a group."""
    return running_sums(rows, by, order, {"_n": F.lit(1)}).where((F.col("_n") - 1) % step == 0).select(*rows.columns)


def top(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, the order complete."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
