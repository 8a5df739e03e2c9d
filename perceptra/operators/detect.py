"""Pose lattices scored against models, posteriors over the lattice, and non-maximum suppression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import angular_bin
from .trees import MODEL_ROWS, gathered, stored

#: Pairs of cells, and sums, that a task makes at a time, some 40 MB.
PAIRS = 500_000


def lattice(spark: SparkSession, n_x: int, n_y: int, x0: float, y0: float, res: float) -> DataFrame:
    """Pose cells and their centres."""
    xy = spark.range(n_x).select(F.col("id").cast("int").alias("ix")).select("ix", F.explode(F.sequence(F.lit(0), F.lit(n_y - 1))).alias("iy"))
    return xy.withColumns({"x": F.col("ix") * res + res / 2 + x0, "y": F.col("iy") * res + res / 2 + y0})


def known_cells(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Known cells (gi, gj, k) and whether they are occupied (o). A grid's cells lie together, so its pairs are summed, and its poses compared, where they are made."""
    known = grid.where("log_odds != 0").select(*keys, F.col("i").alias("gi"), F.col("j").alias("gj"), "k", (F.col("log_odds") > 0).alias("o"))
    return gathered(known, keys) if keys else known


def pose_scores(grid: DataFrame, model: DataFrame, keys: list[str], reach: int, cls: str = "model_cls") -> DataFrame:
    """Sum of log probabilities of the known cells about each pose (J6, G17), poses within reach cells.

    Known cells meet model cells of the same height; the pose is their difference, so unknown cells cost nothing and
    the work is bounded by the model's cells. model has cls, i, j, k, log_free, log_occ. It is stored and counted: up to MODEL_ROWS rows are broadcast, so
    that cells stay where they are and few heights make no hot keys; a larger model is joined by height and column, each known cell sent to the columns in reach.
    """
    model = stored(model)
    known = known_cells(grid, keys)
    if model.count() <= MODEL_ROWS:
        pairs = known.join(F.broadcast(model), "k")
    else:
        spread = known.withColumn("i", F.explode(F.sequence(F.col("gi") - reach, F.col("gi") + reach)))
        pairs = spread.join(model, ["k", "i"])
    pairs = pairs.withColumns({"px": F.col("gi") - F.col("i"), "py": F.col("gj") - F.col("j")})
    inside = F.col("px").between(-reach, reach) & F.col("py").between(-reach, reach)
    return pairs.where(inside).groupBy(*keys, "px", "py", cls).agg(F.sum(F.when(F.col("o"), F.col("log_occ")).otherwise(F.col("log_free"))).alias("score"), F.count("*").alias("n"))


def pose_arrays(grid: DataFrame, model: DataFrame, keys: list[str], reach: int, cls: str = "model_cls") -> DataFrame:
    """pose_scores() with the rows of a pose as one array, column scores, for what compares no more than a pose's classes.

    A function of a grid's cells makes them, so a task holds a batch of grids, however many it is given: there is no table of all its poses to sort or to spill.
    Nothing is known of where its rows lie, so windows over a grid want pose_scores(). So does a model of more than MODEL_ROWS rows, with nulls (sums pass over
    these) or with more sums a grid than PAIRS.
    """
    model = stored(model)
    n, free, occ, classes = model.agg(F.count("*"), F.count("log_free"), F.count("log_occ"), F.count_distinct(F.struct(cls))).first()
    if not keys or n > MODEL_ROWS or min(free, occ) < n or (2 * reach + 1) ** 2 * classes > PAIRS:
        return pose_scores(grid, model, keys, reach, cls).groupBy(*keys, "px", "py").agg(F.collect_list(F.struct(cls, "score", "n")).alias("scores"))
    cells = known_cells(grid, keys).dropna(subset=["gi", "gj", "k"]).groupBy(*keys).agg(F.collect_list(F.struct("gi", "gj", "k", "o")).alias("_cells"))
    whole = "bigint" if "bigint" in {kind for df in (grid, model) for _, kind in df.select("i", "j").dtypes} else "int"
    poses = f"array<struct<px:{whole},py:{whole},scores:array<struct<`{cls}`:{dict(model.dtypes)[cls]},score:double,n:bigint>>>>"
    sums = F.arrow_udf(pose_sums(model.dropna(subset=["i", "j", "k"]).toArrow(), cls, reach, whole), poses)
    return cells.select(*keys, F.inline(sums("_cells")))


def pose_sums(model: pa.Table, cls: str, reach: int, whole: str = "int", most: int = PAIRS):
    """A function from a batch of grids, each an array of its cells, to the poses of each. It makes up to most pairs at a time, more only where one cell has more."""
    model = model.sort_by("k")
    heights, first, many = np.unique(model["k"].to_numpy(), return_index=True, return_counts=True)
    i, j, free, occ = (model[c].to_numpy() for c in ("i", "j", "log_free", "log_occ"))
    classes = model[cls].combine_chunks().dictionary_encode("encode")
    of, names = classes.indices.to_numpy(), classes.dictionary
    side, whole = 2 * reach + 1, pa.int64() if whole == "bigint" else pa.int32()
    wide = side * side * max(1, len(names))

    def sums(cells: pa.Array) -> pa.Array:
        owner = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
        gi, gj, k, o = (c.to_numpy(zero_copy_only=False) for c in cells.flatten().flatten())
        met = np.isin(k, heights)
        owner, gi, gj, o, at = owner[met], gi[met], gj[met], o[met], np.searchsorted(heights, k[met])
        ends = np.concatenate([[0], np.cumsum(many[at])])  # of each cell's pairs
        of_grid = np.searchsorted(owner, np.arange(len(cells) + 1))  # the first cell of each grid
        found, lo = [], 0
        while lo < len(cells):
            hi = max(lo + 1, min(lo + most // wide, np.searchsorted(ends[of_grid], ends[of_grid[lo]] + most, "right") - 1))
            total, n = np.zeros((hi - lo) * wide), np.zeros((hi - lo) * wide, np.int64)
            a = of_grid[lo]
            while a < of_grid[hi]:
                b = min(of_grid[hi], max(a + 1, np.searchsorted(ends, ends[a] + most, "right") - 1))
                own = np.repeat(np.arange(a, b), many[at[a:b]])
                row = np.arange(ends[a], ends[b]) + (first[at] - ends[:-1])[own]
                px, py = gi[own] - i[row] + reach, gj[own] - j[row] + reach
                near = (px >= 0) & (px < side) & (py >= 0) & (py < side)
                own, row = own[near], row[near]
                sum_ = (((owner[own] - lo) * side + px[near]) * side + py[near]) * len(names) + of[row]
                total += np.bincount(sum_, np.where(o[own], occ[row], free[row]), len(total))
                n += np.bincount(sum_, minlength=len(n))
                a = b
            seen = np.flatnonzero(n)
            found.append((seen + lo * wide, total[seen], n[seen]))
            lo = hi
        seen, total, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        pose, kind = np.divmod(seen, max(1, len(names)))
        start = np.flatnonzero(np.diff(pose, prepend=-1))
        rows = pa.StructArray.from_arrays([names.take(pa.array(kind)), pa.array(total, pa.float64()), pa.array(n, pa.int64())], [cls, "score", "n"])
        pose = pose[start]
        px, py = pose // side % side - reach, pose % side - reach
        scores = pa.ListArray.from_arrays(pa.array([*start, len(seen)], pa.int32()), rows)
        poses = pa.StructArray.from_arrays([pa.array(px, whole), pa.array(py, whole), scores], ["px", "py", "scores"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(pose, np.arange(len(cells) + 1) * side * side), pa.int32()), poses)

    return sums


def turned(rows: DataFrame, i: str = "i", j: str = "j", turns: int = 4) -> DataFrame:
    """Cells about the origin at each of the quarter turns, column turn: exact on the lattice."""
    t = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    x, y = F.col(i), F.col(j)
    at = lambda a, b, c, d: F.when(F.col("turn") == 0, a).when(F.col("turn") == 1, b).when(F.col("turn") == 2, c).otherwise(d)
    return t.withColumns({i: at(x, -y, -x, y), j: at(y, x, -y, -x)})


def pose_scores_with_normals(grid: DataFrame, model: DataFrame, normals: DataFrame, keys: list[str], reach: int, n_bins: int, cls: str = "model_cls", least: float = 1e-4, turns: int = 4) -> DataFrame:
    """The score of each pose and quarter turn (G17): log probabilities of known cells, and of the directions of occupied cells that have a valid one.

    grid has keys, i, j, k, log_odds, theta, phi and valid_normal (scoring.with_features(): null where a cell has no direction); model has cls, i, j, k, log_free, log_occ;
    normals has cls, i, j, k, bin and n, the counts of directions. The model's cells and directions are a stencil, turned about its origin; a grid cell's direction is turned
    back by the pose and meets the stencil by its angular bin. A model cell that has seen no direction gives each of the n_bins the same share; a
    bin it has not seen has share least. Cells without a direction, free ones and invalid directions add nothing. Up to MODEL_ROWS rows of a stencil are broadcast.
    """
    small = lambda df: F.broadcast(df) if df.count() <= MODEL_ROWS else df
    seen = normals.groupBy(cls, "i", "j", "k").agg(F.sum("n").alias("_n"))
    cells = stored(turned(model.join(seen, [cls, "i", "j", "k"], "left"), turns=turns))
    share = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col("n") / F.col("_n")))
    bins = stored(turned(normals.join(seen, [cls, "i", "j", "k"]).withColumn("log_n", F.ln(share)), turns=turns).select(cls, "turn", "i", "j", "k", "bin", "log_n"))
    known = grid.where("log_odds != 0").select(*keys, F.col("i").alias("gi"), F.col("j").alias("gj"), "k", (F.col("log_odds") > 0).alias("o"), "theta", "phi", F.coalesce("valid_normal", F.lit(False)).alias("valid"))
    if keys:
        known = gathered(known, keys)  # as in pose_scores()
    wide = known.withColumn("i", F.explode(F.sequence(F.col("gi") - reach, F.col("gi") + reach))).withColumn("j", F.explode(F.sequence(F.col("gj") - reach, F.col("gj") + reach)))
    met = wide.join(small(cells), ["i", "j", "k"])
    bin_ = F.when(F.col("o") & F.col("valid"), angular_bin(F.col("theta") - F.col("turn") * (np.pi / 2), F.col("phi")))
    met = met.withColumn("bin", bin_).join(small(bins), [cls, "turn", "i", "j", "k", "bin"], "left")
    direction = F.when(F.col("bin").isNull(), 0.0).when(F.col("_n").isNull(), float(-np.log(n_bins))).otherwise(F.coalesce("log_n", F.lit(float(np.log(least)))))
    term = F.when(F.col("o"), F.col("log_occ")).otherwise(F.col("log_free")) + direction
    return met.groupBy(*keys, (F.col("gi") - F.col("i")).alias("px"), (F.col("gj") - F.col("j")).alias("py"), "turn", cls).agg(F.sum(term).alias("score"), F.count("*").alias("n"), F.count("bin").alias("n_directions"))


def local_maxima(scores: DataFrame, keys: list[str], score: str, window: int, reach: int) -> DataFrame:
    """Poses without a better one within window cells on either axis (J11); of equal ones the first in order stays.

    A neighbour outside the lattice counts as log-odds 0. Each pose is sent to the rows (py) of its window and meets those of its columns (px) there in a sliding
    frame, so scores are computed once and neither joined with themselves nor shuffled beyond their keys.
    """
    sent = scores.withColumn("_dy", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("_y", F.col("py") + F.col("_dy"))
    near = Window.partitionBy(*keys, "_y").orderBy("px").rangeBetween(-window, window)
    own = F.struct((-F.col(score)).alias("s"), F.col("px").alias("x"), F.col("py").alias("y"))
    top = sent.withColumn("_o", F.min(own).over(near)).where((F.col("_dy") == 0) & F.col("_o").eqNullSafe(own)).select(*scores.columns)
    inner = (F.abs("px") <= reach - window) & (F.abs("py") <= reach - window)
    return top.where(inner | (F.col(score) >= 0))


def window_maxima(scores: DataFrame, keys: list[str], score: str, window: int) -> DataFrame:
    """Rows that are the best of their pose over the other states and of a window over poses."""
    w = Window.partitionBy(*keys, "px", "py")
    return local_maxima(scores.withColumn("_m", F.max(score).over(w)).where(F.col("_m") == F.col(score)).drop("_m"), keys, score, window, 1 << 30)


def greedy_radius(poses: DataFrame, keys: list[str], score: str, radius: float, schema: str | None = None) -> DataFrame:
    """Detections from the best down, without those within radius of one that was taken (J13): depends on the order, so one fold over each group's array.

    Rows without a score come last. The columns are those of poses; schema is not needed.
    """
    others = [c for c in poses.columns if c not in keys]
    row = F.struct(F.isnull(score).alias("_none"), (-F.col(score)).alias("_s"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.struct(*others).alias("_row"))
    groups = poses.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    near = lambda p: lambda k: (k["_x"] - p["_x"]) ** 2 + (k["_y"] - p["_y"]) ** 2 < radius**2
    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), lambda taken, p: F.when(F.exists(taken, near(p)), taken).otherwise(F.concat(taken, F.array(p))))
    return groups.select(*keys, F.explode(kept).alias("_kept")).select(*keys, "_kept._row.*").select(*poses.columns)


def in_labelled_box(points: DataFrame, boxes: DataFrame, by: list[str], buffer: float = 0.0, width: float = 4.0) -> DataFrame:
    """Type of the first box that holds each point (J10), Closeish within the buffer about one, else Background.

    boxes has by, box_id, type, cx, cy, half_x, half_y, heading; points has by, point_id, x, y. Each box is sent to the
    cells, width wide, that its own circle covers, so one large box does not bring all points to all boxes of its frame.
    """
    reach = F.sqrt((F.col("half_x") + buffer) ** 2 + (F.col("half_y") + buffer) ** 2)
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width)))
    b = boxes.withColumn("_cx", cells("cx")).withColumn("_cy", cells("cy"))
    p = points.withColumns({"_cx": F.floor(F.col("x") / width), "_cy": F.floor(F.col("y") / width)})
    dx, dy, c, s = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.cos("heading"), F.sin("heading")
    u, v = F.abs(c * dx + s * dy), F.abs(c * dy - s * dx)
    met = p.join(b, [*by, "_cx", "_cy"], "left").withColumns({
        "_in": (u <= F.col("half_x")) & (v <= F.col("half_y")), "_near": (u <= F.col("half_x") + buffer) & (v <= F.col("half_y") + buffer)
    })
    found = met.groupBy(*by, "point_id").agg(F.min_by("type", F.when(F.col("_in"), F.col("box_id"))).alias("t"), F.max("_near").alias("close"))
    return found.select(*by, "point_id", F.coalesce("t", F.when(F.col("close"), "Closeish"), F.lit("Background")).alias("label"))


def not_too_close(samples: DataFrame, objects: DataFrame, by: list[str], distance: float) -> DataFrame:
    """Samples with no object within distance on both axes (F9): an anti join by cell and neighbour cells."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    o = objects.withColumn("_a", near).withColumn("_b", near).select(
        *[F.col(c).alias(f"o_{c}") for c in by], F.col("x").alias("ox"), F.col("y").alias("oy"), (F.floor(F.col("x") / distance) + F.col("_a")).alias("_ox"), (F.floor(F.col("y") / distance) + F.col("_b")).alias("_oy")
    )
    s = samples.withColumns({"_sx": F.floor(F.col("x") / distance), "_sy": F.floor(F.col("y") / distance)})
    same = (F.col("_sx") == F.col("_ox")) & (F.col("_sy") == F.col("_oy"))
    for c in by:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    return s.join(o, same & (F.abs(F.col("x") - F.col("ox")) < distance) & (F.abs(F.col("y") - F.col("oy")) < distance), "left_anti").drop("_sx", "_sy")


def active_at(intervals: DataFrame, events: DataFrame, start: str, days: int, at: str, on: list[str]) -> DataFrame:
    """Events inside the intervals that share their key (J9): an equi join with the bounds as its condition."""
    return intervals.join(events, on).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.expr(f"INTERVAL {days} DAYS")))


def camera_view(points: DataFrame, matrix: list[list[float]], width: int = 1392, height: int = 512) -> DataFrame:
    """Points in front of the camera that fall on the image."""
    from ..functions.expr import project

    u, v, depth = project(["x", "y", "z"], matrix)
    return points.withColumns({"u": u, "v": v, "depth": depth}).where((F.col("depth") >= 0) & F.col("u").between(0, width) & F.col("v").between(0, height))


def wholly_in_view(objects: DataFrame, matrix: list[list[float]], reach: float = 1.0, width: int = 1392, height: int = 512) -> DataFrame:
    """Objects whose four corners, reach away on both axes, all are in front of the camera and on the image."""
    from ..functions.expr import project

    seen = F.lit(True)
    for a in (-reach, reach):
        for b in (-reach, reach):
            u, v, depth = project([F.col("x") + a, F.col("y") + b, F.col("z")], matrix)
            seen = seen & (depth >= 0) & u.between(0, width) & v.between(0, height)
    return objects.where(seen)


def angle_marginal(poses: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Probability summed over headings."""
    return poses.groupBy(*keys).agg(F.sum(p).alias(p))

