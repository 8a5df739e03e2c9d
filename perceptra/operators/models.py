"""Class models from grids: marginal, joint, feature and log-probability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import angular_bin, safe_log

OBSERVED = 100


def window(i: int, j: int, k: int) -> Column:
    """Cells within plus and minus the sizes."""
    return F.col("i").between(-i, i) & F.col("j").between(-j, j) & F.col("k").between(-k, k)


def marginal_model(grid: DataFrame, by: list[str], prior: int = 1) -> DataFrame:
    """Counts of free and occupied by class and cell (G4); every count starts at prior. Unknown cells are no rows."""
    return grid.where("log_odds != 0").groupBy(*by, "i", "j", "k").agg(
        (F.count_if(F.col("log_odds") < 0) + prior).alias("c_free"), (F.count_if(F.col("log_odds") > 0) + prior).alias("c_occ")
    )


def joint_model(grid: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Counts of the four states of cell pairs of the same grid (J4, G5), pairs in order of cell.

    Each grid's cells meet as one array, so a grid's pairs are made where its cells are; a row holds the later
    partners of a cell, and counts are combined before the shuffle. The array is bounded by the model's window.
    """
    occ = F.struct("i", "j", "k", (F.col("log_odds") > 0).cast("int").alias("o"))
    cells = grid.where("log_odds != 0").groupBy(*keys, *[b for b in by if b not in keys]).agg(F.sort_array(F.collect_list(occ)).alias("cells"))
    one = cells.select(*by, F.posexplode("cells").alias("n", "a"), "cells")
    pairs = one.select(*by, "a", F.explode(F.slice("cells", F.col("n") + 2, F.size("cells"))).alias("b"))
    state = F.col("a.o") + 2 * F.col("b.o")
    names = [F.col(f"{s}.{c}").alias(f"{c}{n}") for s, n in (("a", 1), ("b", 2)) for c in "ijk"]
    counts = [F.count_if(F.col("state") == s).alias(n) for s, n in ((0, "c00"), (1, "c10"), (2, "c01"), (3, "c11"))]
    return pairs.select(*by, *names, state.alias("state")).groupBy(*by, *[f"{c}{n}" for n in (1, 2) for c in "ijk"]).agg(*counts)


def mutual_information() -> Column:
    """Of the counts c00, c01, c10, c11, in nats; terms under 1e-10 count nothing."""
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    total = F.lit(0.0)
    for a in "01":
        for b in "01":
            p = F.col(f"c{a}{b}") / n
            pa = (F.col(f"c{a}0") + F.col(f"c{a}1")) / n
            pb = (F.col(f"c0{b}") + F.col(f"c1{b}")) / n
            total = total + F.when(p >= 1e-10, p * F.ln(p / (pa * pb))).otherwise(0.0)
    return total


def marginal_log_probs(model: DataFrame) -> DataFrame:
    """log_free and log_occ of a marginal model (G13), minus infinity without a count."""
    n = F.col("c_free") + F.col("c_occ")
    return model.withColumns({"log_free": safe_log(F.col("c_free") / n), "log_occ": safe_log(F.col("c_occ") / n)})


def conditional_table(joint: DataFrame, by: list[str]) -> DataFrame:
    """log P(second cell's state given the first's), unsmoothed; null where the first never has the state."""
    cells = [f"{c}{n}" for n in (1, 2) for c in "ijk"]
    states = [
        F.struct(F.lit(a).alias("given"), F.lit(b).alias("occ"), F.when(F.col(f"c{a}0") + F.col(f"c{a}1") > 0, safe_log(F.col(f"c{a}{b}") / F.nullif(F.col(f"c{a}0") + F.col(f"c{a}1"), F.lit(0)))).alias("log_p"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    return joint.select(*by, *cells, F.explode(F.array(*states)).alias("s")).select(*by, *cells, "s.*")


def both_ways(joint: DataFrame, by: list[str]) -> DataFrame:
    """Counts of cell pairs, each pair once in either order."""
    states = {"c00": "c00", "c01": "c10", "c10": "c01", "c11": "c11"}
    turned = joint.select(*by, *[F.col(f"{c}{3 - n}").alias(f"{c}{n}") for n in (1, 2) for c in "ijk"], *[F.col(old).alias(new) for new, old in states.items()])
    return joint.select(*turned.columns).unionAll(turned)


def feature_counts(features: DataFrame, by: list[str], res: float = 0.2) -> DataFrame:
    """Directions by cell and angular bin; directions that are no numbers are left out."""
    finite = ~(F.isnan("theta") | F.isnan("phi") | (F.abs("theta") == float("inf")) | (F.abs("phi") == float("inf")))
    return features.where(finite).groupBy(*by, angular_bin("theta", "phi", res).alias("bin")).agg(F.count("*").alias("n"))


def bin_mode(counts: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent bin, the first of several."""
    return counts.groupBy(*by).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode"), F.sum("n").alias("total"))


def feature_log_probs(counts: DataFrame, by: list[str], n_bins: int, integer_division: bool = False, least: float = 1e-4) -> DataFrame:
    """log of the share of each bin, clamped; cells without data have 1 / n_bins (G16). integer_division repeats a known defect on request."""
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    p = F.floor(p) if integer_division else p
    share = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    return counts.join(total, by).withColumn("log_p", F.ln(F.when(F.col("total") > 0, share).otherwise(1.0 / n_bins)))


def occupancy_log_probs(model: DataFrame, least: float = 1e-4) -> DataFrame:
    """Clamped logarithms; one half without data."""
    n = F.col("c_free") + F.col("c_occ")
    p = F.when(n > 0, F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col("c_occ") / F.nullif(n, F.lit(0))))).otherwise(0.5)
    return model.withColumns({"log_occ": F.ln(p), "log_free": F.ln(1 - p)})


def fill_in(keys_: DataFrame, by: list[str], parts: list[str], size: int) -> DataFrame:
    """Share of the possible keys that occur."""
    return keys_.groupBy(*by).agg((F.count_distinct(*parts) / float(size)).alias("fill"))


def largest(models: DataFrame, size: str = "size") -> DataFrame:
    """Largest size over the models."""
    return models.agg(F.max(size).alias(size))
