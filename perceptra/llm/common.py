"""What the operators of this package share: shared storage, skew-proof grouping, bounded filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"
#: How many tasks share the rows of one key.
SALTS = 32
#: Bits of a filter for each of its keys; the largest filter that is broadcast, 262,144 rows.
BITS_PER_KEY, MAX_BITS = 16, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the storage that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a local master takes a temporary folder; a cluster raises, since its machines share none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='perceptra-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() returned, once all that was made of it is written."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        discard(df.sparkSession, path)


def slices(batches: Iterator[pa.RecordBatch], mb: int = 4) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice's texts, binaries and lists take about mb megabytes, or one row.

    Spark hands over at most spark.sql.execution.arrow.maxBytesPerBatch (64 MB) at once; what becomes Python objects is bounded here,
    without a session setting that other plans would run under.
    """
    for batch in batches:
        if batch.nbytes <= mb << 20:
            yield batch
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(column.type):
                size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        end, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            upto = int(np.searchsorted(end, (end[begin - 1] if begin else 0) + (mb << 20), "right"))
            upto = max(upto, begin + 1)
            yield batch.slice(begin, upto - begin)
            begin = upto


def spread(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column]], salt_on: list[str], having: str = "true") -> DataFrame:
    """Adds aggregates over each group of keys to the group's rows, without gathering a group in one task; having drops groups.

    aggs maps a new column to (min, max, sum or count; its argument). Partial aggregation leaves few rows of a
    key to shuffle. The result returns once for each salt, a hash of salt_on, that the group's rows have, and the rows meet it by key and
    salt, so a key's rows lie in up to SALTS tasks. keys must not be null. df is read twice, so pass a table that is cheap
    to read again.
    """
    fn = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    salts = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_salt"))).alias("_salts")
    whole = salted.groupBy(*keys).agg(*[fn[f](c).alias(n) for n, (f, c) in aggs.items()], salts).where(having)
    each = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("_salts", s) == 1)
    return salted.join(whole.withColumn("_salt", F.explode(each)).drop("_salts"), [*keys, "_salt"]).drop("_salt")


def flagged(df: DataFrame, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds boolean name: whether key, a 64-bit hash, may be among keys (its column _h, materialized); never a false no.

    Up to MAX_BITS / BITS_PER_KEY keys are a filter of one hash that grows with their number: its words, at most MAX_BITS / 64 rows, are broadcast.
    More keys are joined by shuffle, exactly, each copied to SALTS tasks so that the rows of a hot key need not meet in one.
    """
    n = keys.count()
    bits = 1 << max(16, (BITS_PER_KEY * n - 1).bit_length())
    if bits > MAX_BITS:
        known = keys.select("_h").distinct().select("_h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias(name))
        salted = df.withColumns({"_h": key, "_salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
        return salted.join(known, ["_h", "_salt"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_h", "_salt")
    slot = F.pmod(key, F.lit(bits))
    one = keys.select(F.pmod("_h", F.lit(bits)).alias("s")).select(
        F.shiftright("s", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int")).alias("m")
    )
    words = materialize(one.groupBy("word").agg(F.bit_or("m").alias("mask")), "filter")
    marked = df.withColumn("_slot", slot).withColumn("word", F.shiftright("_slot", 6))
    hit = F.coalesce(F.getbit(F.col("mask"), (F.col("_slot") % 64).cast("int")) == 1, F.lit(False))
    return marked.join(F.broadcast(words), "word", "left").withColumn(name, hit).drop("word", "_slot", "mask")


def by_group(rows: DataFrame, judge: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """Applies judge to the rows of each group (_group, the first column), streaming through sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            edges = np.flatnonzero(group[1:] != group[:-1]) + 1
            if held and group[0] != held[-1].column(0)[-1].as_py():
                edges = np.insert(edges, 0, 0)
            begin = 0
            for edge in edges.tolist():
                held.append(batch.slice(begin, edge - begin))
                yield from judge(pa.Table.from_batches(held))
                held, begin = [], edge
            held.append(batch.slice(begin))
        if held:
            yield from judge(pa.Table.from_batches(held))

    dealt = rows.repartition(parts, "_group") if parts else rows.repartition("_group")
    return dealt.sortWithinPartitions("_group").mapInArrow(run, schema)
