"""The properties of histograms: bounds, own bins, CDF and percentile as inverses, likelihood of uniform data, blur."""

import math

import pytest
from pyspark.sql import functions as F

from perceptra.operators.histogram import Histogram


def ramp(spark, lo, step, n):
    return spark.range(n).select((F.lit(lo) + F.col("id") * step).alias("value"), F.lit(1.0).alias("weight"))


def test_every_value_counts_in_its_own_bin(spark):
    h = Histogram(-1.231, 91.231, 0.231)
    v = ramp(spark, h.lo - 10 * h.res, h.res / 10, 4200)
    c = {r.bin: r.w for r in h.count(v, []).collect()}
    assert sum(c.values()) == 4200
    assert min(c) == 0 and max(c) == h.overflow
    assert all(8 <= w <= 12 for b, w in c.items() if 1 < b < h.overflow - 2)


def test_cdf_and_percentile_are_inverse(spark):
    h = Histogram(0.0, 100.0, 1.0)
    hist = h.count(ramp(spark, 0.0, 0.01, 10001), [])
    for r in h.cdf(hist, []).where("bin between 1 and 100").collect():
        assert abs(r.bin / 100 - r.cdf) < 0.011
    for r in h.percentile(hist, [], [0.1, 0.25, 0.5, 0.9]).collect():
        assert abs(r.value - 100 * r.share) < 1.0


def test_likelihood_of_uniform_values(spark):
    h = Histogram(0.0, 100.0, 0.1)
    v = ramp(spark, 0.1, 0.001, 99800)
    v = v.withColumn("k", F.lit(1))
    out = h.likelihood(h.count(v, ["k"]), h.ranges(v, ["k"]), ["k"])
    mid = [r.likelihood for r in out.where("bin between 10 and 990").collect()]
    assert all(abs(x - 0.01) < 0.0003 for x in mid)


def test_blur_spreads_one_sigma_but_not_ten(spark):
    h = Histogram(-1.231, 91.231, 0.231)
    x = h.lo + 0.121 * (h.hi - h.lo)
    hist = h.blur(h.count(ramp(spark, x, 0.0, 1), []), [], 3.0)
    w = {r.bin: r.w for r in hist.collect()}
    at = lambda v: math.floor((v - h.lo) / h.res) + 1
    assert w[at(x)] > 0 and w[at(x + 3)] > 0 and at(x + 30) not in w
    assert sum(w.values()) > 0


@pytest.mark.parametrize("weight", [0.5, 2.0])
def test_merge_adds_weighted_bins(spark, weight):
    h = Histogram(0.0, 10.0, 1.0)
    a = h.count(ramp(spark, 0.5, 1.0, 10), [])
    m = {r.bin: r.w for r in h.merge([(a, 1.0), (a, weight)], []).collect()}
    assert set(m.values()) == {1.0 + weight}
