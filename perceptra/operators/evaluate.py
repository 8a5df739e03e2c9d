"""Detections against ground truth: overlap, assignment, recall thresholds, precision, similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums
from .trees import MODEL_ROWS, gathered

#: Fixed values of the evaluation: recall steps and least overlaps.
SAMPLES = 41
MIN_OVERLAP = {"Car": 0.7, "Pedestrian": 0.5, "Cyclist": 0.5}
#: Fixed values: (least height, most occlusion, most truncation) of easy, moderate and hard.
DIFFICULTY = [(40, 0, 0.15), (25, 1, 0.3), (25, 2, 0.5)]
#: Kinds that are neutral for another.
NEIGHBOURS = {"Car": "Van", "Pedestrian": "Person_sitting"}


def image_overlap(a: str, b: str, criterion: int = -1) -> Column:
    """Overlap of two boxes' columns with prefixes a and b (J15): over the union (-1), the first (0) or the second (1)."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    area = {p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1")) for p in (a, b)}
    whole = {-1: area[a] + area[b] - inter, 0: area[a], 1: area[b]}[criterion]
    return inter / F.nullif(whole, F.lit(0.0))


#: Parts of a frame's detections that meet its boxes in different tasks.
PARTS = 16


def pairs(det: DataFrame, gt: DataFrame, on: list[str]) -> DataFrame:
    """Detections and boxes of the same frame and kind whose images touch; columns d_ and g_.

    The pairs of a frame grow with the square of its boxes, so its detections are dealt to PARTS parts by their keys and its boxes are sent to each: a few large frames are many tasks.
    The parts are dealt to tasks before they meet the boxes, also where these are so few that they are broadcast: a table that is read by one task is not paired by one.
    Boxes whose copies are more than MODEL_ROWS, by count, are not broadcast, whatever their files' size: they are sorted by frame and part and meet the detections there.
    """
    few = gt.limit(MODEL_ROWS // PARTS + 1).count() <= MODEL_ROWS // PARTS
    d = det.select(*on, *[F.col(c).alias(f"d_{c}") for c in det.columns if c not in on])
    g = gt.select(*on, *[F.col(c).alias(f"g_{c}") for c in gt.columns if c not in on])
    d = d.withColumn("_part", F.pmod(F.xxhash64(*[c for c in d.columns if c not in on]), F.lit(PARTS)).cast("int"))
    g = g.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    touch = (F.col("d_x1") < F.col("g_x2")) & (F.col("g_x1") < F.col("d_x2")) & (F.col("d_y1") < F.col("g_y2")) & (F.col("g_y1") < F.col("d_y2"))
    return gathered(d, [*on, "_part"]).join(g if few else g.hint("merge"), [*on, "_part"]).where(touch).drop("_part")


def corners(x: np.ndarray, y: np.ndarray, length: np.ndarray, width: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """Corners of rotated boxes, counter-clockwise: box, corner, axis."""
    c, s = np.cos(heading)[:, None], np.sin(heading)[:, None]
    u, v = length[:, None] / 2 * np.array([1, -1, -1, 1]), width[:, None] / 2 * np.array([1, 1, -1, -1])
    return np.stack([x[:, None] + c * u - s * v, y[:, None] + s * u + c * v], 2)


def clip(subjects: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Intersections of convex polygons, row by row, corners counter-clockwise; rows with fewer corners repeat their first, or a zero if they have none."""
    out = subjects
    for n in range(by.shape[1]):
        a, edge = by[:, n, None], (by[:, (n + 1) % by.shape[1]] - by[:, n])[:, None]
        side = edge[..., 0] * (out[..., 1] - a[..., 1]) - edge[..., 1] * (out[..., 0] - a[..., 0])
        last, other = np.roll(out, 1, 1), np.roll(side, 1, 1)
        inside = side >= 0
        cut = inside != (other >= 0)
        share = np.divide(other, other - side, out=np.zeros_like(side), where=cut)
        points = np.stack([last + share[..., None] * (out - last), out], 2).reshape(len(out), -1, 2)
        valid = np.stack([cut, inside], 2).reshape(len(out), -1)
        order = np.argsort(~valid, 1, kind="stable")[:, : max(1, valid.sum(1).max(initial=0))]
        valid, points = np.take_along_axis(valid, order, 1), np.take_along_axis(points, order[..., None], 1)
        points[~valid[:, 0]] = 0
        out = np.where((valid | ~valid[:, :1])[..., None], points, points[:, :1])
    return out


def area(polygons: np.ndarray) -> np.ndarray:
    p, q = polygons, np.roll(polygons, -1, 1)
    return (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(1) / 2


def common_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area common to the boxes (x, y, length, width, heading) of the rows of a and b; only pairs whose surrounding circles meet are clipped."""
    reach = (np.hypot(a[:, 2], a[:, 3]) + np.hypot(b[:, 2], b[:, 3])) / 2
    near = np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]) < reach
    out = np.zeros(len(a))
    if near.any():
        centre = np.pad(a[near, :2], ((0, 0), (0, 3)))
        out[near] = np.maximum(0, area(clip(corners(*(a[near] - centre).T), corners(*(b[near] - centre).T))))
    return np.where(np.isnan(a).any(1) | np.isnan(b).any(1), np.nan, out)


def ground_overlap(a: str, b: str, solid: bool = False, criterion: int = -1) -> Column:
    """Overlap of rotated boxes on the ground, or of their solids with z and height (J15); columns x, y, l, w, heading (z, h) by prefix. Criterion as in image_overlap()."""
    def common(ax: pd.Series, ay: pd.Series, al: pd.Series, aw: pd.Series, at: pd.Series, bx: pd.Series, by: pd.Series, bl: pd.Series, bw: pd.Series, bt: pd.Series) -> pd.Series:
        return pd.Series(common_area(np.column_stack([ax, ay, al, aw, at]), np.column_stack([bx, by, bl, bw, bt])))

    c = lambda p, n: F.col(f"{p}{n}").cast("double")
    inter = F.pandas_udf(common, "double")(*[c(p, n) for p in (a, b) for n in ("x", "y", "l", "w", "heading")])
    size = {p: c(p, "l") * c(p, "w") for p in (a, b)}
    if solid:
        z = F.greatest(F.lit(0.0), F.least(c(a, "z") + c(a, "h"), c(b, "z") + c(b, "h")) - F.greatest(c(a, "z"), c(b, "z")))
        inter, size = inter * z, {p: s * c(p, "h") for p, s in size.items()}
    whole = {-1: size[a] + size[b] - inter, 0: size[a], 1: size[b]}[criterion]
    return inter / F.nullif(whole, F.lit(0.0))


def ground_pairs(det: DataFrame, gt: DataFrame, on: list[str], width: float = 4.0) -> DataFrame:
    """Detections and boxes of the same frame whose circles on the ground share a cell, each pair once; columns d_ and g_.

    Each box is sent to the cells, width wide, that its own circle covers, and boxes meet by frame and cell, so a frame's boxes are not all paired. A
    pair that shares several cells is kept in the first one that both cover. Boxes with a null or infinite place or size meet none.
    """
    def spread(rows: DataFrame, p: str) -> DataFrame:
        reach = F.sqrt(F.col("l") ** 2 + F.col("w") ** 2) / 2
        finite = F.isnotnull("heading")
        for c in ("x", "y", "l", "w"):
            finite = finite & (F.abs(c) < 1e12)
        low, high = ([F.floor((F.col(c) + side * reach) / width) for c in ("x", "y")] for side in (-1, 1))
        own = rows.where(finite).withColumns({f"_{p}x": low[0], f"_{p}y": low[1]})
        own = own.withColumn("_cx", F.explode(F.sequence(F.col(f"_{p}x"), high[0]))).withColumn("_cy", F.explode(F.sequence(F.col(f"_{p}y"), high[1])))
        return own.select(*on, "_cx", "_cy", f"_{p}x", f"_{p}y", *[F.col(c).alias(f"{p}{c}") for c in rows.columns if c not in on])

    met = spread(det, "d_").join(spread(gt, "g_"), [*on, "_cx", "_cy"])
    first = (F.col("_cx") == F.greatest("_d_x", "_g_x")) & (F.col("_cy") == F.greatest("_d_y", "_g_y"))
    return met.where(first).drop("_cx", "_cy", "_d_x", "_d_y", "_g_x", "_g_y")


#: Ground place of a box; pairs that are looked at, or of places that are measured, at once; by how many a frame's detections are dealt by place, and by key.
PLACE, AT_ONCE, BY_PLACE, BY_KEY = ["x", "y", "l", "w", "heading"], 1 << 20, 4, 4


def _places(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of box, and the number of each row's."""
    return np.unique(box, axis=0, return_inverse=True)


def place_overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap on the ground, over the union, of the boxes of the rows of a and b; nan where the union is nothing."""
    inter, size = common_area(a, b), (a[:, 2] * a[:, 3], b[:, 2] * b[:, 3])
    whole = size[0] + size[1] - inter
    return np.divide(inter, whole, out=np.full(len(a), np.nan), where=whole != 0)


def touching_overlaps(det: DataFrame, gt: DataFrame, frame: str, digits: int) -> DataFrame:
    """Rows (frame, d_box_id, g_box_id, overlap): of the pairs of pairs() of a frame, whatever their kinds, the overlap on the ground, rounded; null where it has none.

    det and gt have frame, box_id, the image box x1, y1, x2, y2 and the place x, y, l, w, heading. The pairs of a frame grow with the square of its boxes, and each is a row: a frame's detections are dealt
    by place and key to parts, which meet its boxes in tasks of their own. A task holds the boxes of its frame and hands on AT_ONCE pairs at a time, so pairs are not joined, sorted or sent to
    Python. Overlaps of places that repeat are measured once a part, if that is fewer than its pairs.
    """
    image, kinds = ["x1", "y1", "x2", "y2"], ["box_id", "x1", "y1", "x2", "y2", *PLACE]
    of = lambda rows, role, *part: rows.where(F.col(frame).isNotNull()).select(F.col(frame).cast("long").alias(frame), *part, F.lit(role).alias("_role"), F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in kinds[1:]])
    dealt = F.pmod(F.xxhash64(*[F.col(c).cast("double") for c in PLACE]), F.lit(BY_PLACE)) * BY_KEY + F.pmod(F.xxhash64("box_id"), F.lit(BY_KEY))
    d = of(det, 0, dealt.cast("int").alias("_part"))
    g = of(gt, 1, F.explode(F.sequence(F.lit(0), F.lit(BY_PLACE * BY_KEY - 1))).alias("_part"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        role, key = rows["_role"].to_numpy(), rows[frame][0].as_py()
        found, box = ({c: rows[c].to_numpy()[role == n] for c in kinds} for n in (0, 1))
        (a, a_of), (b, b_of) = (_places(np.column_stack([x[c] for c in PLACE])) for x in (found, box))
        known = None
        if 2 * len(a) * len(b) <= len(a_of) * len(b_of):
            step = max(1, AT_ONCE // max(1, len(b)))
            known = np.concatenate([place_overlaps(np.repeat(a[i : i + step], len(b), 0), np.tile(b, (len(a[i : i + step]), 1))) for i in range(0, len(a), step)] or [np.zeros(0)])
            known = rounded(known).reshape(len(a), len(b))
        x1, y1, x2, y2 = (box[c] for c in image)
        step = max(1, AT_ONCE // max(1, len(b_of)))
        for i in range(0, len(a_of), step):
            left, low, right, high = (found[c][i : i + step, None] for c in image)
            n, m = np.nonzero((left < x2) & (x1 < right) & (low < y2) & (y1 < high))
            n += i
            share = known[a_of[n], b_of[m]] if known is not None else rounded(place_overlaps(a[a_of[n]], b[b_of[m]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), key)), pa.array(found["box_id"][n]), pa.array(box["box_id"][m]), pa.array(share, from_pandas=True)], names=[frame, "d_box_id", "g_box_id", "overlap"])

    rounded = lambda share: np.floor(share * 10.0**digits + 0.5) / 10.0**digits
    sides = gathered(d.unionByName(g), [frame, "_part"]).groupBy(frame, "_part")
    return sides.applyInArrow(meet, f"`{frame}` long, d_box_id long, g_box_id long, overlap double")


#: Overlap measures (J15): how boxes meet, and the overlap of a pair by criterion.
MEASURES = {
    "image": (pairs, lambda a, b, criterion: image_overlap(a, b, criterion)),
    "ground": (ground_pairs, lambda a, b, criterion: ground_overlap(a, b, False, criterion)),
    "solid": (ground_pairs, lambda a, b, criterion: ground_overlap(a, b, True, criterion)),
}

def ignored(kind: str, height: str, occlusion: str, truncation: str, wanted: str, level: int) -> Column:
    """0 for boxes that count, 1 for neutral ones, -1 for others."""
    least, occ, trunc = DIFFICULTY[level]
    hard = (F.col(occlusion) > occ) | (F.col(truncation) > trunc) | (F.col(height) < least)
    near = NEIGHBOURS.get(wanted)
    neutral = (F.lower(kind) == near.lower()) if near else F.lit(False)
    same = F.lower(kind) == wanted.lower()
    return F.when(same & ~hard, 0).when(neutral | same, 1).otherwise(-1)


def greedy_match(candidates: DataFrame, by: list[str], least: float, schema: str) -> DataFrame:
    """One detection for each box, in the order of boxes: the best overlap left over (J14). Depends on the order, so one group a frame.

    candidates has by, g_box_id, d_box_id, d_score and overlap.
    """

    def match(pdf):
        rows = pdf[pdf.overlap > least].sort_values(["g_box_id", "overlap", "d_box_id"], ascending=[True, False, True])
        taken, matched, out = set(), set(), []
        for n, (g, d) in enumerate(zip(rows.g_box_id, rows.d_box_id, strict=True)):
            if g not in matched and d not in taken:
                matched.add(g)
                taken.add(d)
                out.append(n)
        return rows.iloc[out]

    return candidates.groupBy(*by).applyInPandas(match, schema)


def absorbed(det: DataFrame, dont_care: DataFrame, on: list[str], least: float) -> DataFrame:
    """Detections that lie in a region nobody cares for, by their own area."""
    d = det.select("*", *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    g = dont_care.select(*[F.col(c).alias(f"o_{c}") for c in on], *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    same = image_overlap("d_", "g_", 0) > least
    for c in on:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    return d.join(g, same, "left_semi").select(*det.columns)


def recall_ranks(sizes: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, step, rank): which scores of a group, numbered from 0 in descending order, recall_thresholds() takes. sizes has by, m (scores) and n (truths).

    A scan down the scores takes rank i at step t, when t were taken, unless the recall after it, (i + 2) / n, is nearer to t / 40 than (i + 1) / n. So no rank before
    n t / 40 - 3/2 is taken at step t, and the ranks follow from the counts: the first from there on that is after the step before. The last
    rank is taken whatever the step. Where both recalls are equally near, the scan's own sum of steps decides, as it rounds.
    """
    parts = SAMPLES - 1
    n, m, t = F.col("n").cast("long"), F.col("m").cast("long"), F.col("step").cast("long")
    most = F.least(m - 1, F.ceil((m + 2) * parts / n) + 1).cast("int")
    steps = sizes.where("m > 0").withColumn("step", F.explode(F.sequence(F.lit(0), most)))
    reached = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("step"))), F.lit(0.0), lambda s, _: s + 1.0 / parts)
    reached = F.when(F.col("step") > 0, reached).otherwise(0.0)
    first = F.greatest(F.lit(0).cast("long"), -F.floor(-(n * t * 2 - 3 * parts) / (2 * parts)))
    tie = 2 * (2 * first + 3) * parts == 4 * n * t
    nearer = (first + 2) / n.cast("double") - reached < reached - (first + 1) / n.cast("double")
    ahead = F.max(F.when(tie & nearer, first + 1).otherwise(first) - t).over(Window.partitionBy(*by).orderBy("step"))
    ranked = steps.withColumn("rank", t + F.greatest(F.lit(0).cast("long"), ahead))
    ends = F.min(F.when(F.col("rank") >= m - 1, F.col("step"))).over(Window.partitionBy(*by))
    return ranked.withColumn("_end", ends).where("step <= _end").select(*by, "step", F.least("rank", m - 1).alias("rank"))


def recall_thresholds(scores: DataFrame, by: list[str], n_truth: str = "n_truth") -> DataFrame:
    """Scores nearest to SAMPLES steps of recall (W6), as (by, step, threshold).

    scores has by, score (of true positives) and n_truth. The ranks to take follow from the counts of a group alone (recall_ranks()), so no group is
    gathered: its scores are numbered by running sums over ranges, and the rows of these ranks are picked. Null scores are no scores; an empty table gives no rows.
    """
    known = scores.where("score IS NOT NULL")
    sizes = known.groupBy(*by).agg(F.count("*").alias("m"), F.max(n_truth).alias("n"))
    ranks = recall_ranks(sizes, by).select(*[F.col(c).alias(f"_of_{c}") for c in by], "step", F.col("rank").alias("_rank"))
    numbered = running_sums(known.select(*by, "score"), by, ["score"], {"_n": F.lit(1)}, descending=True)
    same = F.col("_n") - 1 == F.col("_rank")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return numbered.join(ranks, same).select(*by, "step", F.col("score").alias("threshold"))


def envelope(curve: DataFrame, by: list[str], value: str = "precision", order: str = "step") -> DataFrame:
    """The best value at or after each step."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return curve.withColumn(value, F.max(value).over(w))


def average_precision(curve: DataFrame, by: list[str], value: str = "precision", order: str = "step") -> DataFrame:
    """Every fourth of SAMPLES values over eleven."""
    return curve.where(F.col(order) % 4 == 0).groupBy(*by).agg((F.sum(value) / 11).alias("ap"))


def precision_recall(scored: DataFrame, by: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Precision and recall at each distinct score, from the highest down (M11). Scores are aggregated before the running sums."""
    s = scored.groupBy(*by, score).agg(F.sum(truth).alias("t"), F.count("*").alias("n"))
    run = running_sums(s, by, [score], {"tp": F.col("t"), "all": F.col("n")}, descending=True)
    return run.select(*by, score, "tp", (F.col("all") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("all")).alias("precision"), (F.col("tp") / F.nullif("tp_total", F.lit(0))).alias("recall"))


def counts_at(matches: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, FN and orientation similarity (G29): matches has by and delta, the angle between match and truth; totals has by, n_det, n_truth."""
    m = matches.groupBy(*by).agg(F.count("*").alias("tp"), F.sum((1 + F.cos("delta")) / 2).alias("similarity"))
    t = totals.join(m, by, "left").na.fill(0, ["tp"]).na.fill(0.0, ["similarity"])
    return t.select(*by, "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), (F.col("similarity") / F.nullif("n_det", F.lit(0))).alias("aos"))


def completion_loss(pairs_: DataFrame, a: str, b: str, by: list[str], differs: float = 1e-2) -> DataFrame:
    """Mean absolute difference of voxel arrays and how many voxels differ."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return pairs_.select(*by, (F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a)).alias("l1"), F.size(F.filter(d, lambda x: x > differs)).alias("mismatches"))
