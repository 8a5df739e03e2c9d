"""Sparse histograms in long form: rows (keys, bin, w). Bins run from 0 (below) to the overflow bin."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_index, bin_value


@dataclass(frozen=True)
class Histogram:
    """Range and resolution, and the queries over counts of that shape."""

    lo: float
    hi: float
    res: float

    @property
    def overflow(self) -> int:
        return math.ceil((self.hi - self.lo) / self.res) + 2

    def count(self, samples: DataFrame, keys: list[str], value: str = "value", weight: str | None = "weight") -> DataFrame:
        """Weight by bin."""
        w = F.col(weight) if weight else F.lit(1.0)
        return samples.groupBy(*keys, bin_index(value, self.lo, self.hi, self.res).alias("bin")).agg(F.sum(w).alias("w"))

    def merge(self, parts: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
        """Bin-wise weighted sum of several."""
        rows = [p.select(*keys, "bin", (F.col("w") * k).alias("w")) for p, k in parts]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.groupBy(*keys, "bin").agg(F.sum("w").alias("w"))

    def ranges(self, samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
        """Smallest and largest value seen (Q2: null if none)."""
        return samples.groupBy(*keys).agg(F.min(value).alias("seen_min"), F.max(value).alias("seen_max"))

    def probability(self, hist: DataFrame, keys: list[str]) -> DataFrame:
        """Share of each bin."""
        return hist.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(*keys)))

    def likelihood(self, hist: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
        """Share over width (G7); the outer bins are as wide as what was seen. Above the range the divisor is lo - seen_min, as in the reference's results (Q1)."""
        width = F.when(F.col("bin").isin(0, self.overflow), F.lit(self.lo) - F.col("seen_min")).otherwise(self.res)
        p = self.probability(hist, keys).join(ranges, keys)
        return p.withColumn("likelihood", F.col("p") / F.nullif(width, F.lit(0.0)))

    def cdf(self, hist: DataFrame, keys: list[str]) -> DataFrame:
        """Running share up to and with each bin."""
        w = Window.partitionBy(*keys)
        return hist.withColumn("cdf", F.sum("w").over(w.orderBy("bin")) / F.sum("w").over(w))

    def percentile(self, hist: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
        """Value below which each share lies, linear inside the bin that reaches it (G7); at or past 0 and 1 the range's ends."""
        w = Window.partitionBy(*keys)
        run = hist.withColumns({"_run": F.sum("w").over(w.orderBy("bin")), "_all": F.sum("w").over(w)})
        asked = run.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where(F.col("_run") >= F.col("share") * F.col("_all"))
        hit = asked.groupBy(*keys, "share").agg(F.min_by(F.struct("bin", "w", "_run", "_all"), "bin").alias("x")).select(*keys, "share", "x.*")
        inside = bin_value("bin", self.lo, self.res) + self.res * (F.col("share") * F.col("_all") - (F.col("_run") - F.col("w"))) / F.col("w")
        value = F.when((F.col("share") <= 0) | (F.col("bin") == 0), self.lo).when((F.col("share") >= 1) | (F.col("bin") >= self.overflow - 1), self.hi)
        return hit.select(*keys, "share", value.otherwise(F.least(F.lit(self.hi), inside)).alias("value"))

    def sample(self, hist: DataFrame, draws: DataFrame, keys: list[str], u: str = "u") -> DataFrame:
        """Inverse-CDF value for each draw u in (0, 1) (G7, M9): draws meet bins by key and interval."""
        w = Window.partitionBy(*keys)
        run = hist.withColumns({"_hi": F.sum("w").over(w.orderBy("bin")) / F.sum("w").over(w), "_p": F.col("w") / F.sum("w").over(w)}).withColumn("_lo", F.col("_hi") - F.col("_p"))
        value = F.least(F.lit(self.hi), F.greatest(F.lit(self.lo), bin_value("bin", self.lo, self.res) + self.res * (F.col(u) - F.col("_lo")) / F.col("_p")))
        return draws.join(run, keys).where((F.col(u) > F.col("_lo")) & (F.col(u) <= F.col("_hi"))).withColumn("value", value).drop("_hi", "_lo", "_p", "bin", "w")

    def blur(self, hist: DataFrame, keys: list[str], sigma: float) -> DataFrame:
        """Gaussian blur over plus and minus three sigma within the range (G8); the outer bins stay, weights are not normalised."""
        reach = math.ceil(3 * sigma / self.res)
        offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
        outer = hist.where(F.col("bin").isin(0, self.overflow))
        spread = hist.where((F.col("bin") > 0) & (F.col("bin") < self.overflow)).withColumn("_d", offset)
        d = F.col("_d") * self.res
        gauss = F.exp(-d * d / (2 * sigma * sigma)) / math.sqrt(2 * math.pi * sigma * sigma)
        moved = spread.select(*keys, (F.col("bin") + F.col("_d")).alias("bin"), (F.col("w") * gauss).alias("w")).where((F.col("bin") > 0) & (F.col("bin") < self.overflow))
        return moved.unionByName(outer.select(*keys, "bin", "w")).groupBy(*keys, "bin").agg(F.sum("w").alias("w"))


def blur_axis(hist: DataFrame, keys: list[str], axis: str, sigma: float, value: str = "w", wrap: int | None = None, reach: int | None = None) -> DataFrame:
    """One pass of a separable blur over an integer key (G9): weights by Gaussian of the key's distance, unnormalised; wrap closes a circle of so many."""
    reach = math.ceil(3 * sigma) if reach is None else reach
    moved = hist.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    to = F.col(axis) + F.col("_d")
    to = F.pmod(to, F.lit(wrap)) if wrap else to
    moved = moved.withColumn(value, F.col(value) * F.exp(-F.col("_d") * F.col("_d") / (2.0 * sigma * sigma))).withColumn(axis, to.cast("int"))
    return moved.groupBy(*keys).agg(F.sum(value).alias(value))


def blur_bank(hist: DataFrame, axes: dict[str, float], keys: list[str]) -> DataFrame:
    """All axes of a bank of histograms, one after the other (G9), each over the whole steps within three deviations."""
    for axis, sigma in axes.items():
        hist = blur_axis(hist, keys, axis, sigma, reach=math.floor(3 * sigma))
    return hist


def upper_median(values: Column) -> Column:
    """The element at half the count of the sorted values; of an even count the upper one; 0 if there are none."""
    sorted_ = F.sort_array(values)
    return F.coalesce(F.try_element_at(sorted_, (F.size(sorted_) / 2).cast("int") + 1), F.lit(0.0))
