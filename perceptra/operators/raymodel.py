"""Ray models: observations seen from object poses, n-gram histograms, likelihoods with fallback."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_value, grams_2d, grams_3d, object_frame, polar, wrap_angle
from .histogram import Histogram
from .trees import MODEL_ROWS, gathered, stored

LEAST, SUPPORT = 1e-99, 10
#: Steps of a ray key's angle and distance.
GRAIN = (0.1, 0.1)
#: Cells of a turn, and from straight down to straight up, in which rays meet poses.
BEARINGS, ELEVATIONS = 64, 32
#: Tasks that share the rays and poses of a cell where poses are joined by shuffle.
SALTS = 16


def observations(hits: DataFrame) -> DataFrame:
    """Polar form of hits with their sines and cosines, computed once for all poses."""
    p = polar("x", "y")
    o = hits.withColumns({"range": p["range"], "theta": p["theta"]})
    return o.withColumns({"sin_t": F.sin("theta"), "cos_t": F.cos("theta")})


def _met(obs: DataFrame, arcs: DataFrame, cells: list[str], max_rows: int) -> DataFrame:
    """Observations beside the poses that cover their cells. Up to max_rows rows of arcs, by count, are broadcast; more are
    joined by shuffle, each copied to SALTS tasks over which a cell's observations are dealt, so that a cell that all scans share is no hot key."""
    if arcs.limit(max_rows + 1).count() <= max_rows:
        return obs.join(F.broadcast(arcs), cells).drop(*cells)
    copies = arcs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = obs.withColumn("_salt", F.pmod(F.xxhash64("theta", "range"), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [*cells, "_salt"]).drop(*cells, "_salt")


def _bearings(p: DataFrame, size: float) -> DataFrame:
    """Poses in each of the bearing cells that their disc covers (_c)."""
    step, d = 2 * math.pi / BEARINGS, F.sqrt(F.col("px") ** 2 + F.col("py") ** 2)
    half = F.when(d > size, F.asin(size / d) + 1e-9).otherwise(math.pi)
    first, last = F.floor((F.atan2("py", "px") - half) / step), F.floor((F.atan2("py", "px") + half) / step)
    return p.withColumn("_c", F.explode(F.sequence(first, F.least(last, first + BEARINGS - 1)))).withColumn("_c", F.pmod("_c", F.lit(BEARINGS)))


def _bearing() -> Column:
    return F.pmod(F.floor(F.col("theta") / (2 * math.pi / BEARINGS)), F.lit(BEARINGS))


def seen_from(obs: DataFrame, poses: DataFrame, size: float, max_poses: int = 100_000) -> DataFrame:
    """Observations that concern an object at each pose (J7, F7): rays that pass within size in front of it, not ending before it.

    Each pose is sent to the bearing cells, BEARINGS to a turn, that its disc covers, and each observation to its own, so rays meet the poses
    about them by an equi-join. Poses whose cells count up to max_poses are broadcast; others are joined by shuffle with a salt.
    """
    p = poses.select("pose_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("theta").alias("pt"))
    pairs = _met(obs.withColumn("_c", _bearing()), _bearings(p, size), ["_c"], max_poses)
    m = object_frame("theta", "range", "px", "py", "pt", F.col("sin_t"), F.col("cos_t"))
    return pairs.withColumns(m).where((F.abs("dist_ray") <= size) & F.col("in_front") & (F.col("dist_obs") >= -size))


def relevant_to_all(seen: DataFrame, keys: list[str], sizes: list[float]) -> DataFrame:
    """Observations that every model of a pose finds relevant (F8)."""
    all_ = [(F.abs("dist_ray") <= s) & (F.col("dist_obs") >= -s) for s in sizes]
    ok = all_[0]
    for a in all_[1:]:
        ok = ok & a
    return seen.where(ok).select(*keys, "hit_idx")


def with_previous(seen: DataFrame, group: list[str], order: str, column: str, name: str) -> DataFrame:
    """The previous row's value in a circle: the first row's previous is the last."""
    w = Window.partitionBy(*group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return seen.withColumn(name, F.coalesce(F.lag(column).over(w), F.last(column).over(whole)))


def half_turn_order(seen: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """Order that starts half a turn away when the first ray already concerns the object."""
    first = F.min(order).over(Window.partitionBy(*group)) == 0
    return seen.withColumn("turn", F.pmod(F.col(order) - F.when(first, n // 2).otherwise(0), F.lit(n)))


def gram_keys(seen: DataFrame, grain: tuple[float, float] = GRAIN) -> DataFrame:
    k_phi, k_dist = grams_2d("m_phi", "dist_ray", *grain)
    return seen.withColumns({"k_phi": k_phi, "k_dist": k_dist})


def one_gram(seen: DataFrame, keys: list[str], hist: Histogram, grain: tuple[float, float] = GRAIN) -> DataFrame:
    """Histograms of the end's distance by ray key."""
    return hist.count(gram_keys(seen, grain), [*keys, "k_phi", "k_dist"], "dist_obs", None)


def two_gram(seen: DataFrame, keys: list[str], group: list[str], hist: Histogram, grain: tuple[float, float] = GRAIN) -> DataFrame:
    """Histograms by ray key and the neighbour's bin, each pair of neighbours counted both ways."""
    from ..functions.expr import bin_index

    s = gram_keys(seen, grain).withColumn("bin", bin_index("dist_obs", hist.lo, hist.hi, hist.res))
    for c in ("k_phi", "k_dist", "bin"):
        s = with_previous(s, group, "hit_idx", c, f"p_{c}")
    forth = s.select(*keys, "k_phi", "k_dist", F.col("p_bin").alias("prev"), "bin")
    back = s.select(*keys, F.col("p_k_phi").alias("k_phi"), F.col("p_k_dist").alias("k_dist"), F.col("bin").alias("prev"), F.col("p_bin").alias("bin"))
    return forth.unionAll(back).groupBy(*keys, "k_phi", "k_dist", "prev", "bin").agg(F.count("*").cast("double").alias("w"))


def likelihoods(hist: DataFrame, keys: list[str], res: float, support: float = SUPPORT) -> DataFrame:
    """Likelihood of each bin for the keys with enough weight."""
    total = F.sum("w").over(Window.partitionBy(*keys))
    return hist.withColumn("_n", total).where(F.col("_n") >= support).withColumn("lik", F.col("w") / F.col("_n") / res).drop("_n", "w")


def score(seen: DataFrame, one: DataFrame, two: DataFrame, keys: list[str], group: list[str], hist: Histogram, support: float = SUPPORT, grain: tuple[float, float] = GRAIN) -> DataFrame:
    """Sum of log likelihoods (J8, G23): of the two-gram if its key has support, else of the one-gram, else of LEAST."""
    from ..functions.expr import bin_index

    s = gram_keys(seen, grain).withColumn("bin", bin_index("dist_obs", hist.lo, hist.hi, hist.res))
    s = with_previous(s, group, "hit_idx", "bin", "prev")
    one_key, two_key = [*keys, "k_phi", "k_dist"], [*keys, "k_phi", "k_dist", "prev"]
    has2 = two.groupBy(*two_key).agg(F.sum("w").alias("_n2")).where(F.col("_n2") >= support)
    s = s.join(likelihoods(two, two_key, hist.res, support).withColumnRenamed("lik", "_l2"), [*two_key, "bin"], "left").join(has2, two_key, "left")
    s = s.join(likelihoods(one, one_key, hist.res, support).withColumnRenamed("lik", "_l1"), [*one_key, "bin"], "left")
    lik = F.when(F.col("_n2").isNotNull(), F.coalesce("_l2", F.lit(0.0))).otherwise(F.coalesce("_l1", F.lit(0.0)))
    return s.groupBy(*group).agg(F.sum(F.ln(F.greatest(lik, F.lit(LEAST)))).alias("score"), F.count("*").alias("n"))


def least_log(p: Column) -> Column:
    return F.ln(F.greatest(p, F.lit(LEAST)))


def sample_ranges(draws: DataFrame, one: DataFrame, keys: list[str], hist: Histogram, u: str = "u") -> DataFrame:
    """A drawn distance for each ray (keys, k_phi, k_dist and u in (0, 1]) from its one-gram histogram (M9); rays without a histogram fall out."""
    return hist.sample(one, draws, [*keys, "k_phi", "k_dist"], u)


def transitions(two: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, k_phi, k_dist, trans): of each ray key an array of (prev, total, bins: array of (upto, bin)), the running weights of the bins after each bin before.

    The entry with prev null sums over all bins before; it serves those without weight of their own. The array is bounded by the square of the number of bins.
    """
    key = [*keys, "k_phi", "k_dist"]
    whole = two.groupBy(*key, F.lit(None).cast(two.schema["prev"].dataType).alias("prev"), "bin").agg(F.sum("w").alias("w"))
    both = two.groupBy(*key, "prev", "bin").agg(F.sum("w").alias("w")).where("prev IS NOT NULL").unionByName(whole)
    w = Window.partitionBy(*key, "prev")
    run = both.withColumns({"upto": F.sum("w").over(w.orderBy("bin")), "total": F.sum("w").over(w)})
    rows = run.groupBy(*key, "prev").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("upto", "bin"))).alias("bins"))
    return rows.groupBy(*key).agg(F.collect_list(F.struct("prev", "total", "bins")).alias("trans"))


def _walked(draws: DataFrame, weights: DataFrame, keys: list[str], chain: list[str]) -> DataFrame:
    """Rows (keys, chain, step, bin) of sample_chain(): draws has the number _id of its ray key (null: unknown), weights _id, prev, total, upto and bin.

    Only the draws are shuffled and sorted, a few numbers each; a task walks the chains of a batch side by side and keeps the state of the last one for the next batch.
    """
    held = weights.orderBy("_id", F.asc_nulls_first("prev"), "bin").toArrow()
    first_bin = min(pc.min(held["prev"]).as_py() or 0, pc.min(held["bin"]).as_py() or 0)
    span = max(pc.max(held["prev"]).as_py() or 0, pc.max(held["bin"]).as_py() or 0) - first_bin + 2
    # slot 0 of a ray key sums over all bins before; -1 stands for no bin
    code = held["_id"].to_numpy().astype(np.int64) * span + pc.fill_null(pc.add(held["prev"], 1 - first_bin), 0).to_numpy()
    code, begin = np.unique(code, return_index=True)
    upto, bins, total = held["upto"].to_numpy(), held["bin"].to_numpy().astype(np.int64) - first_bin, held["total"].to_numpy()
    end = np.append(begin[1:], len(bins))[: len(begin)]

    def drawn(ray: np.ndarray, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The bin that each draw takes after the bin at, -1 if none."""
        out = np.full(len(ray), -1)
        if not len(code):
            return out
        own, rest = (np.minimum(np.searchsorted(code, ray * span + slot), len(code) - 1) for slot in (at + 1, 0))
        use = np.where((at >= 0) & (code[own] == ray * span + at + 1), own, rest)
        known = (ray >= 0) & ((use == own) & (at >= 0) & (code[own] == ray * span + at + 1) | (code[use] == ray * span))
        low, high = begin[use], np.where(known, end[use], begin[use])
        for n in range(int((high - low).max(initial=0))):
            place = np.minimum(low + n, len(bins) - 1)
            hit = (out < 0) & (low + n < high) & (upto[place] >= u * total[place])
            out[hit] = bins[place[hit]]
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            for c in [*keys, *chain]:
                number = pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy()
                new[1:] |= number[1:] != number[:-1]
            if last is not None:
                new, fresh = new[1:], new[1]
            else:
                fresh = True
            new[0] = True
            first = np.flatnonzero(new)
            size, at = np.diff(np.append(first, len(new))), np.full(len(first), -1)
            at[0] = -1 if fresh else state
            ray, u = pc.fill_null(batch["_id"], -1).to_numpy().astype(np.int64), pc.fill_null(batch["u"], np.nan).to_numpy()
            out, live = np.full(len(new), -1), np.arange(len(first))
            for n in range(int(size.max())):
                live = live[size[live] > n]
                row = first[live] + n
                out[row] = pick = drawn(ray[row], at[live], u[row])
                at[live] = np.where(pick >= 0, pick, at[live])
            last, state = batch.slice(batch.num_rows - 1), at[-1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in [*keys, *chain, "step"]), pa.array(out + first_bin, pa.int64(), mask=out < 0)], names=[*keys, *chain, "step", "bin"])

    own = [*keys, *chain]
    rows = gathered(draws.select(*own, "step", F.col("_id").cast("long").alias("_id"), F.col("u").cast("double").alias("u")), own).sortWithinPartitions(*own, "step")
    shape = ", ".join(f"`{c}` {draws.schema[c].dataType.simpleString()}" for c in [*own, "step"])
    return rows.mapInArrow(walk, f"{shape}, bin long").withColumn("bin", F.col("bin").cast(weights.schema["bin"].dataType))


def sample_chain(draws: DataFrame, two: DataFrame, keys: list[str], chain: list[str], hist: Histogram, max_keys: int = 50_000) -> DataFrame:
    """Distances drawn one after the other, each given the bin of the one before (M9), as (keys, chain, step, bin, value).

    draws has keys, chain, step, k_phi, k_dist and u in (0, 1]; two is the two-gram model. Up to max_keys ray keys and MODEL_ROWS of their weights, by count, are held by each task and walked (_walked()). With more, each draw's u makes of its ray key's transitions a map from bin to bin: the first bin
    whose running weight reaches u of the total. Such maps are composed along the chain by a fold over its steps, so all is one join with the
    model, one grouping by chain and an array expression. A bin before without weight takes the sums over all bins; a ray key without any
    weight draws nothing (null) and leaves the chain's bin.
    """
    key = [*keys, "k_phi", "k_dist"]
    model = stored(transitions(two, keys))
    if model.count() <= max_keys:
        numbered = stored(model.withColumn("_id", F.row_number().over(Window.orderBy(*key)) - 1))
        weights = numbered.select("_id", F.inline("trans")).select("_id", "prev", "total", F.inline("bins"))
        if weights.count() <= MODEL_ROWS:
            return _walked(draws.join(F.broadcast(numbered.select(*key, "_id")), key, "left"), weights, keys, chain).withColumn("value", bin_value("bin", hist.lo, hist.res))
    met = draws.join(model, key, "left")
    pick = lambda t: F.filter(t["bins"], lambda b: b["upto"] >= F.col("u") * t["total"])[0]["bin"]
    moves = F.transform(F.coalesce("trans", F.array()), lambda t: F.struct(t["prev"].alias("prev"), pick(t).alias("bin")))
    steps = met.groupBy(*keys, *chain).agg(F.sort_array(F.collect_list(F.struct("step", moves.alias("moves")))).alias("steps"))
    number = two.schema["bin"].dataType.simpleString()
    none = F.lit(None).cast(number)

    def follow(state: Column, x: Column) -> Column:
        own = F.filter(x["moves"], lambda m: m["prev"] == state["at"])
        rest = F.filter(x["moves"], lambda m: m["prev"].isNull())
        drawn = F.when(F.size(own) > 0, F.get(own, F.lit(0))["bin"]).otherwise(F.get(rest, F.lit(0))["bin"])
        return F.struct(F.coalesce(drawn, state["at"]).alias("at"), F.concat(state["out"], F.array(F.struct(x["step"].alias("step"), drawn.alias("bin")))).alias("out"))

    zero = F.struct(none.alias("at"), F.array().cast(f"array<struct<step:{draws.schema['step'].dataType.simpleString()},bin:{number}>>").alias("out"))
    walked = steps.select(*keys, *chain, F.explode(F.aggregate("steps", zero, follow)["out"]).alias("x")).select(*keys, *chain, "x.step", "x.bin")
    return walked.withColumn("value", bin_value("bin", hist.lo, hist.res))


KEYS_3D = ["k_theta", "k_phi", "k_ray", "k_z"]


def observations_3d(hits: DataFrame) -> DataFrame:
    """Polar form of hits in space with their sines and cosines, computed once for all poses."""
    o = hits.withColumns(polar("x", "y", "z"))
    return o.withColumns({"sin_t": F.sin("theta"), "cos_t": F.cos("theta"), "sin_p": F.sin("phi"), "cos_p": F.cos("phi")})


def seen_from_3d(obs: DataFrame, poses: DataFrame, size: float, height: float, max_rows: int = 500_000) -> DataFrame:
    """Observations that concern an object at each pose in space (J7): its line passes within size in the plane and height above or below, it does not end before the object.

    Adds m_theta (in -pi to pi), m_phi, dist_ray, dist_z and dist_obs, measured along the ray (X6). Rays and poses meet by an equi-join on two
    angles: each pose is sent to the bearing and elevation cells that its box covers as seen from the sensor (all of them where the sensor is within the box), each ray to its own. Any
    number of poses: up to max_rows rows of pose and cell are broadcast, more are joined by shuffle with a salt.
    """
    p = poses.select("pose_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("theta").alias("pt"))
    step, d = math.pi / ELEVATIONS, F.sqrt(F.col("px") ** 2 + F.col("py") ** 2)
    tilt = F.when(d > height, F.asin(height / d) + 1e-9).otherwise(math.pi / 2)
    within = lambda angle: F.greatest(F.lit(0), F.least(F.lit(ELEVATIONS - 1), F.floor((angle + math.pi / 2) / step))).cast("int")
    arcs = _bearings(p, size).withColumn("_e", F.explode(F.sequence(within(-tilt), within(tilt))))
    met = _met(obs.withColumns({"_c": _bearing(), "_e": within(F.col("phi"))}), arcs, ["_c", "_e"], max_rows)
    pairs = met.withColumns({
        "dist_ray": F.col("sin_t") * F.col("px") - F.col("cos_t") * F.col("py"),
        "dist_obs": (F.col("range_xy") - F.col("cos_t") * F.col("px") - F.col("sin_t") * F.col("py")) / F.col("cos_p"),
        "dist_z": -F.sqrt(F.col("px") ** 2 + F.col("py") ** 2) * F.col("sin_p"),
    })
    near = (F.abs("dist_ray") <= size) & (F.abs("dist_z") <= height)
    return pairs.where(near & (F.col("dist_obs") >= -size) & (F.col("dist_obs") < F.col("range"))).withColumns({"m_theta": wrap_angle(F.col("theta") - F.col("pt")), "m_phi": F.col("phi")})


def gram_keys_3d(seen: DataFrame, grain: tuple[float, float] = (0.2, 0.2)) -> DataFrame:
    """Keys of rays in space."""
    return seen.withColumns(dict(zip(KEYS_3D, grams_3d("m_theta", "m_phi", "dist_ray", "dist_z", *grain), strict=True)))


def one_gram_3d(seen: DataFrame, keys: list[str], hist: Histogram, grain: tuple[float, float] = (0.2, 0.2)) -> DataFrame:
    """Histograms of the end's distance by ray key in space."""
    return hist.count(gram_keys_3d(seen, grain), [*keys, *KEYS_3D], "dist_obs", None)


def score_3d(seen: DataFrame, one: DataFrame, keys: list[str], group: list[str], hist: Histogram, support: float = SUPPORT, grain: tuple[float, float] = (0.2, 0.2)) -> DataFrame:
    """Sum of log likelihoods in space (G23). A ray without a histogram adds nothing (Q11), one whose histogram has too little support, or nothing in the bin, adds that of LEAST."""
    from ..functions.expr import bin_index

    s = gram_keys_3d(seen, grain).withColumn("bin", bin_index("dist_obs", hist.lo, hist.hi, hist.res))
    by = [*keys, *KEYS_3D]
    known = one.groupBy(*by).agg(F.sum("w").alias("_n"))
    s = s.join(known, by, "left").join(likelihoods(one, by, hist.res, support), [*by, "bin"], "left")
    value = F.when(F.col("_n").isNull(), 0.0).otherwise(least_log(F.coalesce("lik", F.lit(0.0))))
    return s.groupBy(*group).agg(F.sum(value).alias("score"), F.count("*").alias("n"), F.count("_n").alias("n_known"))
