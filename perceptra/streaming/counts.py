"""Streams of scans and events: additive model counts, windows, checkpoints by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scan_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of scan files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def voxel_counts(hits: DataFrame, res: float, by: list[str]) -> DataFrame:
    """Counts of cells by class, on a stream or a batch alike."""
    from ..operators.rays import ray_ends, trace

    cells = trace(ray_ends(hits, res), by)
    return cells.groupBy(*by, "i", "j", "k").agg(F.sum("free").alias("n_free"), F.sum("occ").alias("n_occ"))


def train(stream: DataFrame, res: float, by: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Additive counts of each batch as its own snapshot (K8, M7): a batch that runs again overwrites its folder, so counts are never added twice."""

    def add(batch: DataFrame, batch_id: int) -> None:
        voxel_counts(batch, res, by).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def model(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """The counts of all batches (Q25: a resumed run adds to them)."""
    return spark.read.parquet(folder).groupBy(*by, "i", "j", "k").agg(F.sum("n_free").alias("n_free"), F.sum("n_occ").alias("n_occ"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window of time, with a watermark: an extension."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a user: an extension."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
