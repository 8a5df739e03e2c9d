"""Training loops over frames and simulated worlds: mistakes are sampled and counted again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import uniform
from .detect import not_too_close
from .learn import cells_in_reach
from .models import marginal_model
from .sampling import systematic
from .scoring import argmax, naive_bayes
from .trees import MODEL_ROWS


def jittered(objects: DataFrame, keys: list[str], copies: int, res: float, seed: int) -> DataFrame:
    """Poses about each object within half a cell on either axis (M8), numbered by jitter.

    Each draw is a hash of the object's keys, the copy's number, the axis and the seed, so other partitions and tasks that run again draw the same points.
    """
    j = objects.withColumn("jitter", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    moved = {c: F.col(c) + (uniform(*keys, "jitter", F.lit(c), seed=seed) - 0.5) * res for c in ("x", "y")}
    return j.withColumns(moved)


def negatives(worlds: DataFrame, objects: DataFrame, by: list[str], each: int, half: float, distance: float, seed: int) -> DataFrame:
    """Of each drawn poses a world, numbered by n, those that are near no object (M8, F9, Q13); drawn as jittered() does, from the world's keys."""
    p = worlds.select(*by, F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("n"))
    p = p.withColumns({c: (uniform(*by, "n", F.lit(c), seed=seed) * 2 - 1) * half for c in ("x", "y")})
    return not_too_close(p, objects, by, distance)


def hard_round(frame: DataFrame, model: DataFrame, draws: int = 10) -> DataFrame:
    """One step of importance training (M7): grids that the model decides wrongly are drawn by how wrong they are, and their counts are added.

    frame has scan_id, cls, i, j, k, log_odds; model is a marginal model with model_cls. A frame without wrong grids leaves the model as it is.
    """
    scores = naive_bayes(frame, model, ["scan_id", "cls"])
    wrong = argmax(scores, ["scan_id", "cls"]).where("predicted != cls").select("scan_id", "cls")
    lead = scores.join(wrong, ["scan_id", "cls"]).groupBy("scan_id", "cls").agg((F.max("score") - F.max(F.when(F.col("model_cls") == F.col("cls"), F.col("score")))).alias("lead"))
    drawn = systematic(lead.withColumn("w", F.ceil(F.round("lead", 6) * 1000).cast("long") + 1), ["cls"], "scan_id", "w", draws)
    more = marginal_model(frame.join(drawn.select("scan_id"), "scan_id", "left_semi").withColumnRenamed("cls", "model_cls"), ["model_cls"], prior=0)
    both = model.unionByName(more).groupBy("model_cls", "i", "j", "k").agg(F.sum("c_free").alias("c_free"), F.sum("c_occ").alias("c_occ"))
    return both.withColumns({c: F.greatest(F.lit(1).cast("long"), F.col(c)) for c in ("c_free", "c_occ")})


def hard_rounds(frames: list[DataFrame], model: DataFrame, store: Callable[[DataFrame], DataFrame], draws: int = 10) -> DataFrame:
    """The steps of importance training over frames at hand (M7); streaming.training takes them from a stream."""
    for frame in frames:
        model = store(hard_round(frame, model, draws))
    return model


def _table_margins(near: DataFrame, weights: DataFrame, kernel: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, y_label, f): the sum over the cells in reach of weight times kernel, both looked up."""
    met = near.join(weights, ["m", "n"]).join(F.broadcast(kernel), "slot")
    return met.groupBy(*keys, "y_label").agg(F.sum(F.col("w") * F.col("v")).alias("f"))


def _slope() -> Column:
    return -F.col("y_label") / (1 + F.exp(F.col("y_label") * F.col("f")))


def learn_kernel(samples: DataFrame, keys: list[str], half: Column, spacing: float, support: float, store: Callable[[DataFrame], DataFrame], slots: int = 16, rounds: int = 4, rate: float = 1e-3, kernel_rate: float = 0.5, decay: float = 0.9999) -> tuple[DataFrame, DataFrame, list[float]]:
    """Weights by cell (m, n, w) and a kernel by distance slot (slot, v), learnt in turn on the halves of the samples (M4), and the loss before each round on the half that its weights do not see.

    In each round one half moves the weights under the kernel so far, then the other moves the kernel under the new weights; the next round swaps the
    halves. half is 0 or 1. Both are logistic gradients by one aggregation each: of weights by cell, of the kernel by slot. The kernel has slots rows and starts as a cone;
    weights start at 0, and are broadcast behind their count. A round writes margins and both tables, and reads the features four times.
    """
    near = cells_in_reach(samples.withColumn("_half", half.cast("int")), spacing, support).where(F.col("d") < support)
    near = store(near.select(*keys, "y_label", "m", "n", "_half", F.least(F.lit(slots - 1), F.floor(F.col("d") / support * slots)).cast("int").alias("slot")))
    weights = store(near.select("m", "n").distinct().withColumn("w", F.lit(0.0)))
    kernel = store(near.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), (1.0 - F.col("id") / slots).alias("v")))
    small = F.broadcast if weights.count() <= MODEL_ROWS else (lambda table: table)
    losses = []
    for r in range(rounds):
        own, other = (near.where(F.col("_half") == h) for h in (r % 2, 1 - r % 2))
        held = _table_margins(other, small(weights), kernel, keys)
        losses.append(held.agg(F.avg(F.log1p(F.exp(-F.col("y_label") * F.col("f"))))).first()[0])
        f = store(_table_margins(own, small(weights), kernel, keys))
        steep = own.join(f, [*keys, "y_label"]).join(F.broadcast(kernel), "slot").groupBy("m", "n").agg(F.sum(_slope() * F.col("v")).alias("_g"))
        weights = store(weights.join(steep, ["m", "n"], "left").select("m", "n", (F.col("w") - rate * F.coalesce("_g", F.lit(0.0))).alias("w")))
        f = store(_table_margins(other, small(weights), kernel, keys))
        steep = other.join(f, [*keys, "y_label"]).join(small(weights), ["m", "n"]).groupBy("slot").agg((F.sum(_slope() * F.col("w")) / F.count("*")).alias("_g"))
        kernel = store(kernel.join(F.broadcast(steep), "slot", "left").select("slot", (F.col("v") - kernel_rate * F.coalesce("_g", F.lit(0.0))).alias("v")))
        rate, kernel_rate = rate * decay, kernel_rate * decay
    return weights, kernel, losses
