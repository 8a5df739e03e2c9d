"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, spread


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of an edge, component being the smallest node reachable.

    Alternates large-star (each node hands its larger neighbours to its smallest one) and small-star (each
    node hands its smaller neighbours and itself to the smallest) until the edges stand still. The
    rows of a hub are dealt over many tasks; each round is written to the shared folder. Edges with a
    null end and loops link nothing. An empty edge list gives an empty result.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("proper"))
    e = materialize(ends.where("proper").select("u", "v").distinct(), "cc")
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spread(both, ["u"], {"m": ("min", F.col("v"))}, ["v"]).withColumn("m", F.least("m", "u"))
        large = materialize(low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc")
        drop_table(e)
        low = spread(large, ["u"], {"m": ("min", F.col("v"))}, ["v"])
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = materialize(small.select("x.u", "x.v").where("u != v").distinct(), "cc")
        drop_table(large)
        if (now := _state(e)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
