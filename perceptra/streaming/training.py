"""Training on a stream: every micro-batch reads the model as it was before it and writes the next version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def write_frames(frames: list[DataFrame], path: str, files: int) -> None:
    """Appends each frame to a folder as so many files, one frame after the other (S17): frame_stream() takes one frame a batch.

    Rows are dealt evenly, so a frame of at least so many rows fills all its files.
    """
    for frame in frames:
        frame.repartition(files).write.mode("append").parquet(path)


def frame_stream(spark: SparkSession, path: str, schema, files: int) -> DataFrame:
    """The frames of a folder as a stream, in the order in which they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)


def version_path(folder: str, number: int) -> str:
    return f"{folder}/version={number:09d}"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a whole table."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def train_versions(stream: DataFrame, start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Starts training (M7, K8): version n + 1 of the model is step(batch n, version n); version 0 is start. Ends when the stream has no more data.

    A batch that runs again after a failure has the same number, so it reads the version before it, not its own half-written
    one, and overwrites what it had written: each batch counts once. A query started again with the same folder and checkpoint goes on where the last one stopped.
    """
    spark = start.sparkSession
    if not written(spark, version_path(folder, 0)):
        start.write.mode("overwrite").parquet(version_path(folder, 0))

    def learn(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(start.schema).parquet(version_path(folder, number))
        step(batch, before).select(*start.columns).write.mode("overwrite").parquet(version_path(folder, number + 1))

    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, folder: str, known: int = 0) -> int:
    """The number of the newest whole version, from a known one on."""
    while written(spark, version_path(folder, known + 1)):
        known += 1
    return known


def model_version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(version_path(folder, number))
