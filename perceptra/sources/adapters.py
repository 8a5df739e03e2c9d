"""Perception relations derived from the driver's tables, as Spark plans and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS_SQL = """hits AS (
  SELECT vec_id AS scan_id, label AS cls, CAST(b AS INTEGER) AS hit_idx,
         CAST(embedding[4*b+1] AS DOUBLE)*20.0 AS x, CAST(embedding[4*b+2] AS DOUBLE)*20.0 AS y,
         CAST(embedding[4*b+3] AS DOUBLE)*8.0 AS z, abs(CAST(embedding[4*b+4] AS DOUBLE)) AS intensity
  FROM embeddings, range(16) t(b))"""

SAMPLES_SQL = "samples AS (SELECT event_type AS key, value, 1.0::DOUBLE AS weight FROM events)"

BOXES_SQL = """gt AS (
  SELECT p_partkey % 50 AS frame, p_partkey AS box_id, p_brand AS kind, p_retailprice % 100 AS x1, CAST(p_size AS DOUBLE) AS y1,
         p_retailprice % 100 + p_size + 5 AS x2, p_size * 2.0 + 5 AS y2 FROM part),
det AS (
  SELECT frame, box_id, kind, x1 + (box_id % 7 - 3) AS x1, y1 + (box_id % 5 - 2) AS y1, x2 + (box_id % 7 - 3) AS x2, y2 + (box_id % 5 - 2) AS y2,
         (box_id * 37 % 1009) / 1009.0 AS score FROM gt)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of 16 hits from the 64 numbers of an embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("hit_idx"))
    at = lambda k: F.element_at("embedding", F.col("hit_idx") * 4 + k).cast("double")
    return e.select(
        F.col("vec_id").alias("scan_id"), F.col("label").alias("cls"), "hit_idx", (at(1) * 20.0).alias("x"), (at(2) * 20.0).alias("y"), (at(3) * 8.0).alias("z"), F.abs(at(4)).alias("intensity")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value", F.lit(1.0).alias("weight"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    x = F.col("p_retailprice") % 100
    return p.select((F.col("p_partkey") % 50).alias("frame"), F.col("p_partkey").alias("box_id"), F.col("p_brand").alias("kind"), x.alias("x1"), size.cast("double").alias("y1"), (x + size + 5).alias("x2"), (size * 2.0 + 5).alias("y2"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, dx, dy = ground_truth(spark, sf_dir), F.col("box_id") % 7 - 3, F.col("box_id") % 5 - 2
    return g.select("frame", "box_id", "kind", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"), (F.col("box_id") * 37 % 1009 / 1009.0).alias("score"))
