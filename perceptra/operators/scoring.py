"""Scores of grids under class models, posteriors, decisions and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import MODEL_ROWS, stored


def naive_bayes(grid: DataFrame, model: DataFrame, keys: list[str], cls: str = "model_cls", prior: int = 1) -> DataFrame:
    """Sum over known cells of the log share of the cell's state in each class's model.

    model holds a row for each class and seen cell; a cell that a class has not seen has equal counts. The grid
    meets the model by cell; what the missing cells contribute follows from counts, so no lattice is made. The model is stored and counted: up to
    MODEL_ROWS rows are broadcast, so that the cells about the sensor, which every grid has, make no hot keys; with a larger one AQE splits them.
    """
    model = stored(model)
    beside = F.broadcast(model) if model.count() <= MODEL_ROWS else model
    known = grid.where("log_odds != 0").select(*keys, "i", "j", "k", (F.col("log_odds") > 0).alias("o"))
    classes = model.select(cls).distinct()
    hit = F.ln(F.when(F.col("o"), F.col("c_occ")).otherwise(F.col("c_free")) / (F.col("c_occ") + F.col("c_free")))
    seen = known.join(beside, ["i", "j", "k"]).groupBy(*keys, cls).agg(F.sum(hit).alias("s"), F.count("*").alias("m"))
    n = known.groupBy(*keys).agg(F.count("*").alias("n")).join(F.broadcast(classes))
    missing = (F.col("n") - F.coalesce("m", F.lit(0))) * F.lit(-0.6931471805599453) if prior else F.lit(0.0)
    return n.join(seen, [*keys, cls], "left").select(*keys, cls, (F.coalesce("s", F.lit(0.0)) + missing).alias("score"))


def argmax(scores: DataFrame, keys: list[str], cls: str = "model_cls", score: str = "score", digits: int = 9) -> DataFrame:
    """Class with the highest score, the first in order of name among equals."""
    return scores.groupBy(*keys).agg(F.min_by(cls, F.struct(-F.round(score, digits), cls)).alias("predicted"))


def confusion(decided: DataFrame, truth: str = "cls") -> DataFrame:
    """Counts of true and predicted class and the row's percentage (G21), in long form."""
    c = decided.groupBy(truth, "predicted").agg(F.count("*").alias("n"))
    return c.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def confusion_wide(decided: DataFrame, classes: list, truth: str = "cls") -> DataFrame:
    """The matrix with a column for each of the given classes."""
    return decided.groupBy(truth).pivot("predicted", classes).count().na.fill(0)


def softmax(scores: DataFrame, by: list[str], score: str = "score", name: str = "p") -> DataFrame:
    """Share of each row's exponential in its group, shifted by the group's maximum."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_of(rows: str, of=None, score: str = "score") -> Column:
    """The softmax() of a group that is held as an array of rows, summed over those rows that fulfil of: no group is sorted or gathered."""
    top = F.array_max(F.col(f"{rows}.{score}"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, r: t + F.coalesce(F.exp(r[score] - top), F.lit(0.0)))
    return total(F.filter(rows, of) if of else F.col(rows)) / F.nullif(total(F.col(rows)), F.lit(0.0))  # null where no row has a score


def log_odds(scores: DataFrame, by: list[str], score: str = "score", limit: float = 10.0, name: str = "log_odds") -> DataFrame:
    """Log-odds of each row against the others of its group (G19); where they pass the limit, the lead over the best other row."""
    w = Window.partitionBy(*by)
    top = F.max(score).over(w)
    s = scores.withColumn("_order", F.row_number().over(w.orderBy(F.desc(score))))  # first, so that its order serves the windows below too
    s = s.withColumn("_top", top).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    second = F.max(F.when(F.col("_order") == 2, F.col(score))).over(w)
    s = s.withColumn("_other", F.when(F.col("_order") == 1, second).otherwise(F.col("_top"))).withColumn("_sum", F.sum("_e").over(w))
    exact = F.ln(F.greatest(F.col("_e"), F.lit(1e-300)) / F.greatest(F.col("_sum") - F.col("_e"), F.lit(1e-300)))
    lead = F.col(score) - F.col("_other")
    value = F.when(F.abs(lead) > limit, lead).otherwise(exact)
    return s.withColumn(name, value).drop("_top", "_e", "_order", "_other", "_sum")


def logit(p: Column, least: float = 1e-16) -> Column:
    """Log-odds of a clamped probability (K5)."""
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    return F.ln(q / (1 - q))


def marginal_tree_score(grid: DataFrame, log_probs: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Sum of marginal log probabilities over known cells (G15); a cell counts as occupied above one half."""
    known = grid.where("log_odds != 0").withColumn("_o", F.col("log_odds") > 0)
    return known.join(log_probs, [*by, "i", "j", "k"]).groupBy(*keys).agg(F.sum(F.when(F.col("_o"), F.col("log_occ")).otherwise(F.col("log_free"))).alias("score"))


def with_features(grid: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with their directions, null where there is none."""
    return grid.join(features.select(*keys, "i", "j", "k", "theta", "phi", "valid_normal"), [*keys, "i", "j", "k"], "left")
