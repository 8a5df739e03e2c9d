"""Learning over aggregates: linear models, sparse kernel classifiers, kernel maps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rbf_kernel, sparse_kernel
from .trees import MODEL_ROWS, discard, shared_folder, stored


def free_samples(rays: DataFrame, keys: list[str], seed: int | None = None) -> DataFrame:
    """A hit and one free point for each started metre of a ray, labelled 1 and -1 (M1). Without a seed the points lie mid-way."""
    n = F.ceil("range").cast("int")
    ray = rays.withColumn("_s", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)))))
    u = F.rand(seed) if seed is not None else F.lit(0.5)
    share = F.when(F.col("_s") == 0, 1.0).otherwise((F.col("_s") - u) / F.greatest(n, F.lit(1)))
    rows = ray.withColumns({"_f": share, "y_label": F.when(F.col("_s") == 0, 1).otherwise(-1)}).where("_s = 0 OR range > 0")
    return rows.select(*keys, F.col("_s").alias("sample"), (F.col("x") * F.col("_f")).alias("x"), (F.col("y") * F.col("_f")).alias("y"), "y_label")


def cells_in_reach(points: DataFrame, spacing: float, support: float) -> DataFrame:
    """The inducing points (m, n) about each point, all within support and some beyond, and their distance d: cells are sent out from each point, no pairs are searched."""
    reach = int(np.ceil(support / spacing))
    step = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    near = points.withColumn("_a", step()).withColumn("_b", step())
    near = near.withColumns({"m": (F.round(F.col("x") / spacing) + F.col("_a")).cast("int"), "n": (F.round(F.col("y") / spacing) + F.col("_b")).cast("int")})
    d = F.sqrt((F.col("x") - F.col("m") * spacing) ** 2 + (F.col("y") - F.col("n") * spacing) ** 2)
    return near.withColumn("d", d).drop("_a", "_b")


def kernel_features(points: DataFrame, keys: list[str], spacing: float, support: float) -> DataFrame:
    """Values of the compact kernel at the inducing points in reach."""
    near = cells_in_reach(points, spacing, support)
    return near.withColumn("phi", sparse_kernel(F.col("d"), support)).where("phi > 0").drop("d")


def beside(weights: DataFrame) -> DataFrame:
    """A table of cells for a join: up to MODEL_ROWS rows, by count, are broadcast, since all scans share the cells about the sensor; with more AQE splits these."""
    return F.broadcast(weights) if weights.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS else weights


def margins(features: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weight times feature by point (M3)."""
    return features.join(beside(weights), ["m", "n"], "left").groupBy(*keys).agg(F.sum(F.col("phi") * F.coalesce("w", F.lit(0.0))).alias("f"))


def occupancy_query(points: DataFrame, weights: DataFrame, keys: list[str], spacing: float, support: float) -> DataFrame:
    """Probability of occupancy at points (M3)."""
    return margins(kernel_features(points, keys, spacing, support), weights, keys).withColumn("p", 1 / (1 + F.exp(-F.col("f"))))


def kernel_map(samples: DataFrame, keys: list[str], spacing: float, support: float, store, rounds: int = 10, rate: float = 0.1, l1: float = 0.0) -> tuple[DataFrame, list[float]]:
    """Weights of a logistic kernel map by full-batch gradient steps (M2), and the loss before each.

    samples has keys, x, y and y_label. Each round is two joins on inducing cells and one aggregation; weights are stored by store.
    """
    phi = store(kernel_features(samples, keys, spacing, support).select(*keys, "y_label", "m", "n", "phi"))
    w, losses = store(phi.select("m", "n").distinct().withColumn("w", F.lit(0.0))), []
    for _ in range(rounds):
        f = store(margins(phi, w, [*keys, "y_label"]))
        losses.append(f.agg(F.avg(F.log1p(F.exp(-F.col("y_label") * F.col("f"))))).first()[0])
        g = phi.join(f, [*keys, "y_label"]).withColumn("_c", -F.col("y_label") / (1 + F.exp(F.col("y_label") * F.col("f"))))
        grad = g.groupBy("m", "n").agg(F.sum(F.col("_c") * F.col("phi")).alias("_g"))
        w = store(w.join(grad, ["m", "n"]).select("m", "n", (F.col("w") - rate * (F.col("_g") + l1 * F.signum("w"))).alias("w")))
    return w, losses


def coloured_map(samples: DataFrame, keys: list[str], spacing: float, support: float, passes: int = 2, ridge: float = 1.0) -> DataFrame:
    """Weights (m, n, w) of a logistic kernel map by descent over coloured cells (M2): few passes over the samples.

    Cells so far apart that no sample reaches two of them have one colour, so the weights of a colour do not meet: each takes its own Newton step, on the samples that
    reach it, as if it moved alone. A pass is one such batch for each colour. Samples lie in a folder a colour, so a pass reads each once for each cell it reaches, and a sample's margin is
    computed from the weights where it is read: no margins are written, joined or broadcast, only a cell's sums are shuffled, and the driver holds the weights, at most
    MODEL_ROWS. With more cells weights stay a table and samples meet it by joins. ridge is the weight of the squared weights. keys name a sample; samples whose keys
    repeat are not allowed; an empty table gives no weights.
    """
    spark, apart = samples.sparkSession, 2 * int(np.ceil(support / spacing)) + 1
    colour = F.pmod("m", F.lit(apart)) * apart + F.pmod("n", F.lit(apart))
    cells = stored(kernel_features(samples, keys, spacing, support).select("m", "n").distinct())
    if cells.count() > MODEL_ROWS:
        return _coloured_by_joins(samples, keys, spacing, support, passes, ridge, apart, colour)
    folder = shared_folder(spark, "colours")
    near = kernel_features(samples, keys, spacing, support).where(F.isnotnull("y_label"))
    near = near.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("y_label").cast("double").alias("y_label"), "m", "n", colour.alias("_colour"))
    near.write.partitionBy("_colour").parquet(folder)
    near = spark.read.schema(near.schema).parquet(folder)
    at = cells.orderBy("m", "n").toArrow()
    m, n = (at[c].to_numpy().astype(np.int64) for c in ("m", "n"))
    code, w = (m << 32) + n, np.zeros(len(m))
    reach = range(-int(np.ceil(support / spacing)), int(np.ceil(support / spacing)) + 1)

    def kernel(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        q = np.sqrt((x - m * spacing) ** 2 + (y - n * spacing) ** 2) / support
        return np.where(q > 1, 0.0, (2 + np.cos(2 * np.pi * q)) / 3 * (1 - q) + np.sin(2 * np.pi * q) / (2 * np.pi))

    def sums(weight: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gradient and curvature of each cell over a task's samples."""
        g, h, met = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code), bool)
        for batch in batches:
            x, y, label, m, n = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            f, mid = np.zeros(len(x)), (np.rint(x / spacing).astype(np.int64), np.rint(y / spacing).astype(np.int64))
            for a in reach:
                for b in reach:
                    i, j = mid[0] + a, mid[1] + b
                    c = np.minimum(np.searchsorted(code, (i << 32) + j), len(code) - 1)
                    f += kernel(x, y, i, j) * np.where(code[c] == (i << 32) + j, weight[c], 0.0)
            p, phi, own = np.exp(-np.logaddexp(0, label * f)), kernel(x, y, m, n), np.searchsorted(code, (m.astype(np.int64) << 32) + n)
            g += np.bincount(own, -label * p * phi, len(code))
            h += np.bincount(own, p * (1 - p) * phi * phi, len(code))
            met[own] = True
        c = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(g[c]), pa.array(h[c])], names=["c", "g", "h"])

    for _ in range(passes):
        for c in range(apart * apart):
            own = near.where(F.col("_colour") == c).drop("_colour")
            met = own.mapInArrow(partial(sums, w), "c long, g double, h double").groupBy("c").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            c, g, h = (met[k].to_numpy() for k in "cgh")
            w[c] -= (g + ridge * w[c]) / (h + ridge)
    discard(spark, folder)
    return spark.createDataFrame(pa.table({"m": pa.array(m, pa.int32()), "n": pa.array(n, pa.int32()), "w": w}))


def _coloured_by_joins(samples: DataFrame, keys: list[str], spacing: float, support: float, passes: int, ridge: float, apart: int, colour: Column) -> DataFrame:
    """coloured_map() of cells too many to be held: margins are written after each colour and meet features by sample, weights by cell."""
    folder = shared_folder(samples.sparkSession, "colours")
    kernel_features(samples, keys, spacing, support).select(*keys, "y_label", "m", "n", "phi", colour.alias("_colour")).write.partitionBy("_colour").parquet(folder)
    phi = samples.sparkSession.read.parquet(folder)
    weights = stored(phi.select("m", "n").distinct().withColumn("w", F.lit(0.0)))
    f = stored(samples.select(*keys, "y_label", F.lit(0.0).alias("f")))
    for _ in range(passes):
        steps = []
        for c in range(apart * apart):
            own = phi.where(F.col("_colour") == c).drop("_colour")
            p = 1 / (1 + F.exp(F.col("y_label") * F.col("f")))
            sums = own.join(f, [*keys, "y_label"]).groupBy("m", "n").agg(F.sum(-F.col("y_label") * p * F.col("phi")).alias("_g"), F.sum(p * (1 - p) * F.col("phi") * F.col("phi")).alias("_h"))
            step = -(F.col("_g") + ridge * F.col("w")) / (F.col("_h") + ridge)
            steps.append(stored(sums.join(weights, ["m", "n"]).select("m", "n", step.alias("_d"))))
            change = own.join(steps[-1], ["m", "n"]).select(*keys, (F.col("phi") * F.col("_d")).alias("_c"))
            f = stored(f.join(change, keys, "left").select(*keys, "y_label", (F.col("f") + F.coalesce("_c", F.lit(0.0))).alias("f")))
        moved = reduce(DataFrame.unionByName, steps)  # each cell has one colour, so its weight moves once a pass
        weights = stored(weights.join(moved, ["m", "n"], "left").select("m", "n", (F.col("w") + F.coalesce("_d", F.lit(0.0))).alias("w")))
    discard(samples.sparkSession, folder)
    return weights


def log_likelihood(points: DataFrame) -> DataFrame:
    """Sum of -log(1 + exp(-y f))."""
    return points.agg(F.sum(-F.log1p(F.exp(-F.col("y_label") * F.col("f")))).alias("log_likelihood"))


def gram_sums(rows: DataFrame, features: list[Column], target: Column) -> DataFrame:
    """One row: g{i}{j} for i <= j, b{i}, tt and n, the sums of Phi'Phi, Phi't and t't and the number of rows (M6)."""
    m = len(features)
    cells = [F.sum(features[i] * features[j]).alias(f"g{i}{j}") for i in range(m) for j in range(i, m)]
    return rows.agg(*cells, *[F.sum(f * target).alias(f"b{i}") for i, f in enumerate(features)], F.sum(target * target).alias("tt"), F.count("*").alias("n"))


def gram(rows: DataFrame, features: list[Column], target: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(Phi'Phi, Phi't, t't, n) in one aggregation (M6); only sums come to the driver."""
    m, r = len(features), gram_sums(rows, features, target).first()
    a = np.array([[r[f"g{min(i, j)}{max(i, j)}"] for j in range(m)] for i in range(m)], float)
    return a, np.array([r[f"b{i}"] for i in range(m)], float), float(r["tt"]), int(r["n"])


@dataclass
class LinearModel:
    """Bayesian linear regression from its sums (M6): prior precision alpha, noise precision beta."""

    a: np.ndarray
    b: np.ndarray
    tt: float
    n: int
    alpha: float = 1.0
    beta: float = 25.0

    def least_squares(self) -> np.ndarray:
        return np.linalg.lstsq(self.a, self.b, rcond=None)[0]

    def posterior(self) -> tuple[np.ndarray, np.ndarray]:
        s = np.linalg.inv(self.alpha * np.eye(len(self.b)) + self.beta * self.a)
        return self.beta * s @ self.b, s

    def evidence(self) -> float:
        """Log marginal likelihood (Q20: of the evidence, not of the prior)."""
        mean, s = self.posterior()
        error = self.beta / 2 * (self.tt - 2 * mean @ self.b + mean @ self.a @ mean) + self.alpha / 2 * mean @ mean
        return float(len(self.b) / 2 * np.log(self.alpha) + self.n / 2 * np.log(self.beta / (2 * np.pi)) - error + np.linalg.slogdet(s)[1] / 2)

    def maximise(self, rounds: int = 50) -> LinearModel:
        """Type-II maximum likelihood of alpha and beta by fixed-point updates."""
        alpha, beta = self.alpha, self.beta
        for _ in range(rounds):
            m = LinearModel(self.a, self.b, self.tt, self.n, alpha, beta)
            mean, s = m.posterior()
            gamma = len(mean) - alpha * np.trace(s)
            error = self.tt - 2 * mean @ self.b + mean @ self.a @ mean
            alpha, beta = gamma / max(mean @ mean, 1e-12), max(self.n - gamma, 1e-12) / max(error, 1e-12)
        return LinearModel(self.a, self.b, self.tt, self.n, alpha, beta)

    def sample(self, draws: int, seed: int) -> np.ndarray:
        mean, s = self.posterior()
        return np.random.default_rng(seed).multivariate_normal(mean, s, draws)

    def predict(self, features: list[Column]) -> tuple[Column, Column]:
        """Mean and variance of the prediction as expressions; two standard deviations bound it."""
        mean, s = self.posterior()
        mu = sum((f * float(w) for f, w in zip(features[1:], mean[1:], strict=True)), features[0] * float(mean[0]))
        var = F.lit(1 / self.beta)
        for i, f in enumerate(features):
            for j, g in enumerate(features):
                var = var + f * g * float(s[i, j])
        return mu, var


def squared_error(rows: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """(G32)"""
    return rows.agg(F.avg((predicted - target) ** 2).alias("error"))


@dataclass
class RelevanceVector:
    """Sparse kernel classifier (M5): centres, weights, and how a point is scored."""

    centres: np.ndarray
    weights: np.ndarray
    width: float

    def score(self, x: str = "x0", y: str = "x1") -> Column:
        total = F.lit(0.0)
        for (a, b), w in zip(self.centres, self.weights, strict=True):
            total = total + rbf_kernel((F.col(x) - float(a)) ** 2 + (F.col(y) - float(b)) ** 2, self.width) * float(w)
        return total

    def predict(self, rows: DataFrame, x: str = "x0", y: str = "x1") -> DataFrame:
        return rows.withColumn("p", 1 / (1 + F.exp(-self.score(x, y))))


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive matrix; what rounding took from its smallest eigenvalues is given back."""
    value, vector = np.linalg.eigh(a)
    return (vector / np.maximum(value, np.finfo(float).eps * value.max(initial=0))) @ vector.T


def _interpolation(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Weights (row of x, node) by which values at Chebyshev nodes give those at x."""
    sign = np.sin(np.pi * (np.arange(len(nodes)) + 0.5) / len(nodes)) * (-1.0) ** np.arange(len(nodes))
    d = x[:, None] - nodes
    met = d == 0
    weight = sign / np.where(met, 1.0, d)
    weight /= weight.sum(1, keepdims=True)
    return np.where(met.any(1, keepdims=True), met, weight)


def _kernel_nodes(low: float, high: float, width: float) -> np.ndarray:
    """Chebyshev nodes of a range, so many that interpolation along one axis gives the kernel and its square for all points and centres there within 1e-12."""
    n, half = 16, max((high - low) / 2, width**0.5 / 2)
    while True:
        nodes = (low + high) / 2 + half * np.cos(np.pi * (np.arange(n) + 0.5) / n)
        x = np.linspace(nodes.min(), nodes.max(), 12 * n + 1)
        if np.abs(_interpolation(x, nodes) @ np.exp(-2 * (nodes[:, None] - x) ** 2 / width) - np.exp(-2 * (x[:, None] - x) ** 2 / width)).max() < 1e-12:
            return nodes
        n += n // 4


#: Shares of a Newton step that are tried after the whole one; in every so many rounds all rows are priced as centres.
HALVES, PRICED = [0.5**n for n in range(1, 20)], 3


def fit_rvm(rows: DataFrame, x: str = "x0", y: str = "x1", label: str = "label", centres: int = 40, rounds: int = 30, width: float = 0.25, prune: float = 1e3, steps: int = 20) -> RelevanceVector:
    """Laplace approximation and evidence updates; likelihood, gradient and Hessian are aggregated over all rows, which are stored once.

    Every row is a candidate centre. The model starts with centres rows, those with the smallest hash; in the first and then every third round all rows are priced by what they would add to the
    evidence (sparse Bayesian learning by its sparsity s and quality q), and of those that add to it the best of each neighbourhood join. A row that is left out is priced again
    the next time. Rounds end early where none joins or leaves and the precisions stand still. Pricing all rows against all rows takes two passes and no pairs: the kernel is smooth, so sums over rows are
    kept at Chebyshev nodes of the plane, as many as its extent in kernel widths asks for, and give the sum at any centre within rounding (1e-12 of the weights summed).
    In each round the weights go to the mode of their posterior, by at most steps Newton steps: a step that does not raise the posterior enough is halved until it does, so
    that weights stay finite where the kernels tell the labels apart. Only there are the precisions updated.
    """
    picked = rows.select(x, y).distinct().orderBy(F.xxhash64(x, y), x, y).limit(centres).collect()
    c = np.array([[r[0], r[1]] for r in picked], float)
    w, alpha = np.zeros(len(c)), np.ones(len(c))
    data = stored(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(label).cast("double").alias("t")))
    ends = data.agg(*[f(n) for n in "xy" for f in (F.min, F.max)]).first()
    nodes = [_kernel_nodes(ends[2 * n], ends[2 * n + 1], width) for n in (0, 1)]
    kernel = lambda px, py, at: np.exp(-((px[:, None] - at[:, 0]) ** 2 + (py[:, None] - at[:, 1]) ** 2) / width)

    def sums(at: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, Phi'(t - p) and Phi'BPhi over all rows: each task gives its own sums, so what is shuffled does not grow with the rows."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, j = np.triu_indices(len(at))
            values = np.zeros(1 + len(at) + len(i))
            for batch in batches:
                px, py, t = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                phi = kernel(px, py, at)
                f = phi @ weight
                p = np.exp(-np.logaddexp(0, -f))
                h = phi.T @ (phi * (p * (1 - p))[:, None])
                values += np.concatenate(([(t * f - np.logaddexp(0, f)).sum()], phi.T @ (t - p), h[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2], np.full(len(at), -1), i))), pa.array(np.concatenate(([0], np.arange(len(at)), j))), pa.array(values)], names=["i", "j", "v"])

        total = data.mapInArrow(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        row, column, value = (total[n].to_numpy() for n in ("i", "j", "v"))
        grad, hess = np.zeros(len(at)), np.zeros((len(at), len(at)))
        grad[column[row == -1]] = value[row == -1]
        hess[row[row >= 0], column[row >= 0]] = value[row >= 0]
        return float(value[row == -2].sum()), grad, np.triu(hess) + np.triu(hess, 1).T

    def along(at: np.ndarray, weight: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log-likelihood after each share of a step in HALVES, in one pass over the rows."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = np.zeros(len(HALVES))
            for batch in batches:
                px, py, t = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                f, g = (kernel(px, py, at) @ np.stack((weight, step), 1)).T
                values += [(t * (f + h * g) - np.logaddexp(0, f + h * g)).sum() for h in HALVES]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(HALVES))), pa.array(values)], names=["n", "v"])

        return data.mapInArrow(part, "n long, v double").groupBy("n").agg(F.sum("v").alias("v")).toArrow().sort_by("n")["v"].to_numpy()

    def moments(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """At the nodes, the sums over all rows of t - p, of B and of BPhi for each centre."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = np.zeros((2 + len(at), len(nodes[0]), len(nodes[1])))
            for batch in batches:
                px, py, t = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                phi = kernel(px, py, at)
                p = np.exp(-np.logaddexp(0, -(phi @ weight)))
                b, left, right = p * (1 - p), _interpolation(px, nodes[0]).T, _interpolation(py, nodes[1])
                for n, v in enumerate((t - p, b, *(phi * b[:, None]).T)):
                    values[n] += (left * v) @ right
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array([v.tobytes() for v in values], pa.binary())], names=["n", "v"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v, float) for v in table["v"].to_pylist())
            return pa.table({"n": table["n"][:1], "v": pa.array([total.tobytes()], pa.binary())})

        total = data.mapInArrow(part, "n long, v binary").groupBy("n").applyInArrow(add, "n long, v binary").toArrow().sort_by("n")
        return np.stack([np.frombuffer(v, float).reshape(len(nodes[0]), len(nodes[1])) for v in total["v"].to_pylist()])

    def gains(at: np.ndarray, known: np.ndarray, cover: np.ndarray) -> pa.Table:
        """Of each neighbourhood of the plane the row (x, y) that would add most to the evidence, and the precision that it would have."""

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                px, py = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                left, right = (np.exp(-((v[:, None] - n) ** 2) / width) for v, n in zip((px, py), nodes, strict=True))
                near = lambda m, a=left, b=right: ((a @ m) * b).sum(1)
                q, whole = near(known[0]), near(known[1], left**2, right**2)
                beside = np.stack([near(m) for m in known[2:]], 1)
                s = whole - ((beside @ cover) * beside).sum(1)
                found = np.flatnonzero((s > 1e-9 * whole) & (q * q > s) & ~np.isin(px + 1j * py, at[:, 0] + 1j * at[:, 1]))
                q, s, px, py = q[found], s[found], px[found], py[found]
                precision = s * s / (q * q - s)
                gain = (q * q / s - 1 - np.log(q * q / s)) / 2
                kept = precision < prune
                yield pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (np.floor(px / width**0.5), np.floor(py / width**0.5), gain, px, py, precision)], names=["i", "j", "gain", "x", "y", "precision"])

        rows = data.select("x", "y").mapInArrow(best, "i double, j double, gain double, x double, y double, precision double")
        return rows.groupBy("i", "j").agg(F.max(F.struct("gain", "x", "y", "precision")).alias("b")).select("b.*").orderBy(F.desc("gain"), "x", "y").toArrow()

    likelihood, grad, hess = sums(c, w)
    for turn in range(rounds):
        for _ in range(steps):
            slope = grad - alpha * w
            step = _inverse(np.diag(alpha) + hess) @ slope
            now, gain, share = likelihood - alpha @ w**2 / 2, slope @ step, 1.0
            if gain <= 1e-10 * (1 + abs(now)):
                break
            tried = sums(c, w + step)
            if tried[0] - alpha @ (w + step) ** 2 / 2 < now + 1e-4 * gain:
                rise = [v - alpha @ (w + h * step) ** 2 / 2 >= now + 1e-4 * h * gain for h, v in zip(HALVES, along(c, w, step), strict=True)]
                if not any(rise):
                    break
                share = HALVES[rise.index(True)]
                tried = sums(c, w + share * step)
            w, (likelihood, grad, hess) = w + share * step, tried
        cover, before = _inverse(np.diag(alpha) + hess), alpha
        gamma = 1 - alpha * np.diag(cover)
        alpha = np.clip(gamma, 1e-6, None) / np.maximum(w**2, 1e-12)
        keep = alpha < prune
        keep = keep if keep.any() else np.ones(len(c), bool)
        joined = np.zeros((0, 3))
        if turn % PRICED == 0 and turn + 1 < rounds:
            for _, px, py, precision in zip(*(column.to_numpy() for column in gains(c, moments(c, w), cover).columns), strict=True):
                if (kernel(joined[:, 0], joined[:, 1], np.array([[px, py]])) < 0.5).all():
                    joined = np.vstack((joined, [px, py, precision]))
        if turn % PRICED == 0 and keep.all() and not len(joined) and np.abs(np.log(alpha / before)).max() < 1e-3:
            break
        if len(joined) or not keep.all():
            c, w, alpha = np.vstack((c[keep], joined[:, :2])), np.append(w[keep], np.zeros(len(joined))), np.append(alpha[keep], joined[:, 2])
            likelihood, grad, hess = sums(c, w)
    return RelevanceVector(c, w, width)


def valid(samples: DataFrame) -> DataFrame:
    """Samples marked valid (F16)."""
    return samples.where(F.col("valid") != 0)
