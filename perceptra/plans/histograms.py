"""Queries over histograms and voxel moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import models, stats
from ..operators.histogram import Histogram, upper_median
from ..registry import query
from ..sources.adapters import HITS_SQL, SAMPLES_SQL, hits, samples, table

H = Histogram(0.0, 100.0, 1.0)
BIN = "CAST(CASE WHEN value <= 0 THEN 0 WHEN value >= 100 THEN 102 ELSE floor(value) + 1 END AS INTEGER)"
HIST = f"{SAMPLES_SQL}, hist AS (SELECT key, {BIN} AS bin, sum(weight) AS w FROM samples GROUP BY ALL)"


def hist(spark, sf_dir):
    return H.count(samples(spark, sf_dir), ["key"])


@query(f"WITH {HIST} SELECT * FROM hist")
def histogram_counts(spark, sf_dir):
    return hist(spark, sf_dir)


@query(f"WITH {HIST} SELECT key, bin, round(w/sum(w) OVER (PARTITION BY key), 9) AS p FROM hist")
def histogram_probability(spark, sf_dir):
    return H.probability(hist(spark, sf_dir), ["key"]).select("key", "bin", F.round("p", 9).alias("p"))


@query(f"WITH {HIST} SELECT key, bin, round(sum(w) OVER (PARTITION BY key ORDER BY bin)/sum(w) OVER (PARTITION BY key), 9) AS cdf FROM hist")
def histogram_cdf(spark, sf_dir):
    return H.cdf(hist(spark, sf_dir), ["key"]).select("key", "bin", F.round("cdf", 9).alias("cdf"))


SHARES = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
RUN = f"{HIST}, run AS (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY bin) AS run, sum(w) OVER (PARTITION BY key) AS total FROM hist)"


@query(f"""WITH {RUN}, asked AS (SELECT * FROM run, unnest([0.0::DOUBLE, 0.05, 0.25, 0.5, 0.9, 1.0]) s(share) WHERE run >= share*total
  QUALIFY row_number() OVER (PARTITION BY key, share ORDER BY bin) = 1)
SELECT key, share, round(CASE WHEN share <= 0 OR bin = 0 THEN 0.0 WHEN share >= 1 OR bin >= 101 THEN 100.0 ELSE least(100.0, (bin-1) + (share*total-(run-w))/w) END, 6) AS value FROM asked""")
def histogram_percentile(spark, sf_dir):
    return H.percentile(hist(spark, sf_dir), ["key"], SHARES).withColumn("value", F.round("value", 6))


@query(f"""WITH {HIST}, seen AS (SELECT key, min(value) AS lo FROM samples GROUP BY key)
SELECT key, bin, round(w/sum(w) OVER (PARTITION BY key)/nullif(CASE WHEN bin IN (0, 102) THEN 0.0 - lo ELSE 1.0 END, 0), 9) AS likelihood FROM hist JOIN seen USING (key)""")
def histogram_likelihood(spark, sf_dir):
    s = samples(spark, sf_dir)
    return H.likelihood(H.count(s, ["key"]), H.ranges(s, ["key"]), ["key"]).select("key", "bin", F.round("likelihood", 9).alias("likelihood"))


@query(f"""WITH {HIST}, moved AS (
  SELECT key, bin + d AS bin, w*exp(-(d*d)/(2*2.0*2.0))/sqrt(2*pi()*2.0*2.0) AS w FROM hist, range(-6, 7) r(d) WHERE bin > 0 AND bin < 102 AND bin + d > 0 AND bin + d < 102
  UNION ALL SELECT key, bin, w FROM hist WHERE bin IN (0, 102))
SELECT key, CAST(bin AS INTEGER) AS bin, round(sum(w), 6) AS w FROM moved GROUP BY ALL""")
def histogram_blur(spark, sf_dir):
    return H.blur(hist(spark, sf_dir), ["key"], 2.0).withColumn("w", F.round("w", 6))


@query(f"""WITH {HIST}, other AS (SELECT l_returnflag AS key, {BIN.replace('value', 'l_quantity')} AS bin, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL),
both_ AS (SELECT bin, w FROM hist UNION ALL SELECT bin, 0.5*w FROM other)
SELECT bin, round(sum(w), 6) AS w FROM both_ GROUP BY bin""")
def histogram_merge(spark, sf_dir):
    other = H.count(table(spark, sf_dir, "lineitem").select("l_quantity"), [], "l_quantity", None)
    return H.merge([(H.count(samples(spark, sf_dir), []), 1.0), (other, 0.5)], []).withColumn("w", F.round("w", 6))


@query(f"""WITH {HIST}, run AS (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY bin)/sum(w) OVER (PARTITION BY key) AS hi, w/sum(w) OVER (PARTITION BY key) AS p FROM hist),
draws AS (SELECT key, (n + 0.5)/200 AS u FROM (SELECT DISTINCT key FROM samples), range(200) r(n))
SELECT draws.key, u, round(least(100.0, greatest(0.0, (bin - 1) + (u - (hi - p))/p)), 6) AS value FROM draws JOIN run ON run.key = draws.key AND u > hi - p AND u <= hi""")
def histogram_sample(spark, sf_dir):
    h = hist(spark, sf_dir)
    draws = h.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("n")).select("key", ((F.col("n") + 0.5) / 200).alias("u"))
    return H.sample(h, draws, ["key"]).select("key", "u", F.round("value", 6).alias("value"))


@query("""WITH h AS (SELECT l_returnflag AS key, l_linenumber AS bin, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL),
s AS (SELECT key, list_sort(list(w)) AS l FROM h GROUP BY key) SELECT key, l[len(l)//2 + 1] AS median_w FROM s""")
def upper_median_weight(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("key"), "l_linenumber").agg(F.count("*").cast("double").alias("w"))
    return h.groupBy("key").agg(upper_median(F.collect_list("w")).alias("median_w"))


VOXELS = f"{HITS_SQL}, v AS (SELECT *, CAST(round(x) AS INTEGER) AS i, CAST(round(y) AS INTEGER) AS j, CAST(round(z) AS INTEGER) AS k FROM hits)"
PAIRS = [(a, b) for n, a in enumerate("xyz") for b in "xyz"[n:]]
MOMENTS = ", ".join(f"round(s_{a}/n, 6) + 0 AS mean_{a}" for a in ("x", "y", "z", "intensity")) + ", " + ", ".join(f"round(s_{a}{b}/n - (s_{a}/n)*(s_{b}/n), 6) + 0 AS cov_{a}{b}" for a, b in PAIRS)
SUMS = "count(*) AS n, " + ", ".join(f"sum({a}) AS s_{a}" for a in ("x", "y", "z", "intensity")) + ", " + ", ".join(f"sum({a}*{b}) AS s_{a}{b}" for a, b in PAIRS)
KEYS = ["cls", "i", "j", "k"]


def voxel_sums(spark, sf_dir):
    h = hits(spark, sf_dir).withColumns({c: expr.quantise(a, 1.0) for c, a in zip("ijk", "xyz", strict=True)})
    return stats.moment_sums(h, KEYS)


def rounded(df, keys):
    return df.select(*keys, "n", *[(F.round(c, 6) + 0).alias(c) for c in df.columns if c.startswith(("mean", "cov"))])


@query(f"WITH {VOXELS}, s AS (SELECT cls, i, j, k, {SUMS} FROM v GROUP BY cls, i, j, k) SELECT cls, i, j, k, n, {MOMENTS} FROM s")
def voxel_moments(spark, sf_dir):
    return rounded(stats.moments(voxel_sums(spark, sf_dir), KEYS), KEYS)


BLURRED = f"""{VOXELS}, own AS (SELECT DISTINCT cls, i, j, k FROM v),
s AS (SELECT o.cls, o.i, o.j, o.k, {SUMS.replace('count(*)', 'count(v.x)')} FROM own o JOIN v ON v.cls = o.cls AND abs(v.i-o.i) <= 1 AND abs(v.j-o.j) <= 1 AND abs(v.k-o.k) <= 1 GROUP BY ALL)"""


@query(f"WITH {BLURRED} SELECT cls, i, j, k, n, {MOMENTS} FROM s WHERE n > 3")
def voxel_moments_blur27(spark, sf_dir):
    return rounded(stats.moments(stats.blur27(voxel_sums(spark, sf_dir), KEYS), KEYS), KEYS)


def _covariance(a: str, b: str) -> str:
    return f"(s_{a}{b}/n - (s_{a}/n)*(s_{b}/n))"


#: The closed form of the direction of least variance.
NORMALS = f"""WITH {BLURRED}, c AS (SELECT cls, i, j, k, {', '.join(f"{_covariance(a, b)} AS {a}{b}" for a, b in PAIRS)} FROM s WHERE n > 3),
q AS (SELECT *, (xx + yy + zz)/3 AS q FROM c),
p AS (SELECT *, xx - q AS a, yy - q AS b, zz - q AS d, sqrt(((xx - q)*(xx - q) + (yy - q)*(yy - q) + (zz - q)*(zz - q) + 2*(xy*xy + xz*xz + yz*yz))/6) AS p FROM q),
r AS (SELECT *, greatest(-1.0, least(1.0, coalesce((a*(b*d - yz*yz) - xy*(xy*d - yz*xz) + xz*(xy*yz - b*xz))/nullif(2*p*p*p, 0), 0.0))) AS r FROM p),
l AS (SELECT *, q + 2*p*cos(acos(r)/3 + 2*pi()/3) AS low, xx*xx + yy*yy + zz*zz + 2*(xy*xy + xz*xz + yz*yz) AS scale FROM r),
rows AS (SELECT *, [xx - low, xy, xz] AS r1, [xy, yy - low, yz] AS r2, [xz, yz, zz - low] AS r3 FROM l),
crossed AS (
  SELECT *, list_transform([[r1, r2], [r1, r3], [r2, r3]], lambda t: [t[1][2]*t[2][3] - t[1][3]*t[2][2], t[1][3]*t[2][1] - t[1][1]*t[2][3], t[1][1]*t[2][2] - t[1][2]*t[2][1]]) AS cs FROM rows),
best AS (
  SELECT *, list_sort(list_transform(cs, lambda t: list_concat([t[1]*t[1] + t[2]*t[2] + t[3]*t[3]], t)), 'DESC')[1] AS best,
         list_sort(list_transform([r1, r2, r3], lambda t: list_concat([t[1]*t[1] + t[2]*t[2] + t[3]*t[3]], t)), 'DESC')[1] AS own FROM crossed),
picked AS (
  SELECT cls, i, j, k, CASE WHEN best[1] > 1e-20*scale*scale THEN best[2:4] WHEN own[1] <= 1e-20*scale THEN [1.0, 0.0, 0.0] WHEN abs(own[2]) > abs(own[4]) THEN [0 - own[3], own[2], 0.0] ELSE [0.0, 0 - own[4], own[3]] END AS v FROM best),
signed AS (
  SELECT cls, i, j, k, list_transform(v, lambda t: t*CASE WHEN CASE WHEN abs(v[1]) >= abs(v[2]) AND abs(v[1]) >= abs(v[3]) THEN v[1] WHEN abs(v[2]) >= abs(v[3]) THEN v[2] ELSE v[3] END < 0 THEN -1.0 ELSE 1.0 END) AS v FROM picked)
SELECT cls, i, j, k, round(atan2(v[2], v[1]), 6) AS theta, round(atan2(v[3], sqrt(v[1]*v[1] + v[2]*v[2])), 6) AS phi, true AS valid_normal FROM signed"""


@query(NORMALS)
def surface_normals(spark, sf_dir):
    m = stats.normals(stats.moments(stats.blur27(voxel_sums(spark, sf_dir), KEYS), KEYS))
    return m.select(*KEYS, F.round("theta", 6).alias("theta"), F.round("phi", 6).alias("phi"), "valid_normal")


N_PHI, N_THETA = 30, 32
DIRECTION = f"{HITS_SQL}, d AS (SELECT scan_id, cls, hit_idx, atan2(y, x) AS theta, atan2(z, sqrt(x*x+y*y)) AS phi FROM hits)"
ANGLE = """f AS (SELECT *, CASE WHEN phi < 0 THEN theta + pi() ELSE theta END AS t0 FROM d),
g AS (SELECT *, t0 - 2*pi()*floor(t0/(2*pi())) AS t FROM f),
b AS (SELECT *, CAST(CASE WHEN floor(abs(phi)/0.2) >= 30 THEN 960 ELSE floor(t/0.2)*30 + floor(abs(phi)/0.2) END AS INTEGER) AS bin FROM g)"""


def directions(spark, sf_dir):
    p = expr.polar("x", "y", "z")
    return hits(spark, sf_dir).select("scan_id", "cls", "hit_idx", p["theta"].alias("theta"), p["phi"].alias("phi"))


@query(f"WITH {DIRECTION}, {ANGLE} SELECT cls, bin, count(*) AS n FROM b GROUP BY ALL")
def angular_bins(spark, sf_dir):
    return models.feature_counts(directions(spark, sf_dir), ["cls"])


@query(f"WITH {DIRECTION}, {ANGLE}, c AS (SELECT cls, bin, count(*) AS n FROM b GROUP BY ALL) SELECT cls, arg_min(bin, (-n, bin)) AS mode, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY cls")
def bin_mode(spark, sf_dir):
    return models.bin_mode(models.feature_counts(directions(spark, sf_dir), ["cls"]), ["cls"])


@query(f"""WITH {DIRECTION}, {ANGLE}, c AS (SELECT cls, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT cls, bin, round(ln(greatest(1e-4, least(1-1e-4, n/sum(n) OVER (PARTITION BY cls)))), 9) AS log_p FROM c""")
def feature_log_prob(spark, sf_dir):
    c = models.feature_counts(directions(spark, sf_dir), ["cls"])
    return models.feature_log_probs(c, ["cls"], N_PHI * N_THETA + 1).select("cls", "bin", F.round("log_p", 9).alias("log_p"))


@query(f"""WITH {DIRECTION}, {ANGLE}, c AS (SELECT cls, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT cls, bin, round(ln(greatest(1e-4, least(1-1e-4, floor(n/sum(n) OVER (PARTITION BY cls))))), 9) AS log_p FROM c""")
def feature_log_prob_compat(spark, sf_dir):
    c = models.feature_counts(directions(spark, sf_dir), ["cls"])
    return models.feature_log_probs(c, ["cls"], N_PHI * N_THETA + 1, integer_division=True).select("cls", "bin", F.round("log_p", 9).alias("log_p"))


@query("""SELECT b AS bin, round(CASE WHEN b = 960 THEN 0 ELSE (b//30 + 0.5::DOUBLE)*0.2::DOUBLE END, 9) AS theta, round(CASE WHEN b = 960 THEN pi()/2 ELSE (b%30 + 0.5::DOUBLE)*0.2::DOUBLE END, 9) AS phi,
  round(CASE WHEN b = 960 THEN cos(pi()/2) ELSE cos((b%30 + 0.5)*0.2)*cos((b//30 + 0.5)*0.2) END, 9) + 0 AS nx FROM range(961) r(b)""")
def bin_directions(spark, sf_dir):
    d = spark.range(961).withColumnRenamed("id", "bin")
    t, p = expr.angular_bin_direction("bin")
    d = d.withColumns({"theta": t, "phi": p})
    return d.select("bin", F.round("theta", 9).alias("theta"), F.round("phi", 9).alias("phi"), (F.round(expr.unit_normal("theta", "phi")[0], 9) + 0).alias("nx"))


@query(f"WITH {DIRECTION} SELECT scan_id, count(DISTINCT (CAST(floor(theta/0.2) AS INTEGER), CAST(floor(phi/0.2) AS INTEGER)))/1024.0::DOUBLE AS fill FROM d GROUP BY scan_id")
def fill_in_fraction(spark, sf_dir):
    d = directions(spark, sf_dir).select("scan_id", F.floor(F.col("theta") / 0.2).alias("a"), F.floor(F.col("phi") / 0.2).alias("b"))
    return models.fill_in(d, ["scan_id"], ["a", "b"], 1024)
