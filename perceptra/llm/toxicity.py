"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, slices
from .text_arrays import distinct, scrambled, word_begins, word_hashes

#: Features are hashed into 2**BITS coordinates; coordinate 0 is the intercept.
BITS = 30
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their key.
MAX_LABELLED = 40_000
#: Rows and bytes of text that one task learns from in a round, about; rounds over all of them.
SHARD_ROWS, SHARD_BYTES, ROUNDS = 5_000, 16 << 20, 4
#: The rate of a coordinate is ALPHA / (BETA + root of its squared gradients); the penalties.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 1e-3
#: Rows whose key's CRC-32 is a multiple of FOLDS are held out.
FOLDS = 5

#: Bytes of terms (letters, and all beyond ASCII), and A-Z lower-cased.
SOLID = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Marks of single terms, neighbours, triples, and pairs with one term between.
ONE, TWO, THREE, SKIP = np.random.default_rng(20240102).integers(1, 1 << 63, 4, np.uint64)


def features(text: str | None) -> np.ndarray:
    """Coordinates of a text's distinct terms, neighbours, triples and skip-pairs, ascending; first the intercept. The whole text counts."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    solid = SOLID[data]
    begins = word_begins(solid) if len(data) else data
    if not len(begins):
        return np.zeros(1, np.uint32)
    h = word_hashes(data, solid, begins)
    two = scrambled(h[:-1] * np.uint64(3) + h[1:])
    kinds = [h ^ ONE, two ^ TWO, scrambled(two[:-1] * np.uint64(3) + h[2:]) ^ THREE, scrambled(h[:-2] * np.uint64(5) + h[2:]) ^ SKIP]
    at = (scrambled(np.concatenate(kinds)) >> np.uint64(64 - BITS)).astype(np.uint32)
    return np.concatenate((np.zeros(1, np.uint32), distinct(np.maximum(at, np.uint32(1)))))


def chance(margin: float) -> float:
    """The logistic function; far margins are cut, so that nothing overflows."""
    return float(1 / (1 + np.exp(-min(max(margin, -35.0), 35.0))))


def weights(z: np.ndarray, n: np.ndarray, penalty: np.ndarray | float = L1) -> np.ndarray:
    """What the state of a coordinate, the sums of its adjusted and of its squared gradients, says of its weight: none within the penalty."""
    return -np.sign(z) * np.maximum(np.abs(z) - penalty, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)


def learn(rows: list[np.ndarray], labels: list[int], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal: each row in turn changes the states of its coordinates (of which the first is the intercept)."""
    for at, label in zip(rows, labels, strict=True):
        penalty = np.full(len(at), L1)
        penalty[0] = 0
        before = n[at]
        w = weights(z[at], before, penalty)
        g = chance(float(w.sum())) - label
        after = before + g * g
        z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        n[at] = after


@dataclass
class Model:
    """The coordinates with a state, ascending, and their states; the intercept is the first."""

    at: np.ndarray
    z: np.ndarray
    n: np.ndarray

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates that have a weight, and their weights."""
        w = weights(self.z, self.n, np.where(self.at == 0, 0, L1))
        return self.at[w != 0], w[w != 0]

    def round(self, rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States of coordinates after a pass over rows: those of the model, and new ones that have a weight.

        A row moves z by less than 1 as long as there is no weight, so a coordinate of no more than L1 rows cannot pass the penalty and is left out beforehand.
        """
        every = np.concatenate([*rows, self.at])
        known, times = np.unique(every, return_counts=True)
        known = known[(times > L1) | np.isin(known, self.at)]
        z, n = np.zeros(len(known)), np.zeros(len(known))
        own = np.searchsorted(known, self.at)
        z[own], n[own] = self.z, self.n
        local = []
        for row in rows:
            place = np.searchsorted(known, row)
            place = place[known[np.minimum(place, len(known) - 1)] == row]
            local.append(place)
        learn(local, labels, z, n)
        out = np.abs(z) > L1
        out[own] = True
        return known[out], z[out], n[out]


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int) -> DataFrame:
    """Rows (shard, h, label, text) of the labelled rows to learn from, dealt into shards by hash and sorted."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(f"_k IS NOT NULL AND _y IN (0, 1) AND crc32(string(_k)) % {FOLDS} != 0")
    known = known.orderBy(F.xxhash64("_k"), "_k", "_y").limit(limit)
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(known), "_k")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shards = max(1, -(-size.n // SHARD_ROWS), -(-(size.b or 0) // SHARD_BYTES))
    h = F.xxhash64("_k", "text")
    dealt = rows.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), F.col("_y").alias("label"), "text")
    return materialize(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "label"), "labelled")


def _passed(sample: DataFrame, model: Model) -> DataFrame:
    """Rows (at, z, n): the states of each shard after its pass, all shards beside one another."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels, here = [], [], None

        def states() -> pa.RecordBatch:
            at, z, n = shared.value.round(found, labels)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(z), pa.array(n)], names=["at", "z", "n"])

        for batch in slices(batches):
            for shard, y, t in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if shard != here and found:
                    yield states()
                    found, labels = [], []
                here = shard
                found.append(features(t))
                labels.append(y)
        if found:
            yield states()

    return sample.repartition("shard").sortWithinPartitions("shard", "h", "label").mapInArrow(run, "at long, z double, n double")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> Model | None:
    """A model fitted on at most limit labelled rows that are not held out; None if they are not of both kinds.

    In each round every shard passes over its rows from the states so far; a coordinate's states are then averaged over the shards that report it. Only
    coordinates within the model or with a weight are reported, so what reaches the driver is bounded by limit and sparse by the penalty.
    """
    sample = _sample(docs, labels, key, text, label, limit)
    if sample.select("label").distinct().count() < 2:
        drop_table(sample)
        return None
    model = Model(np.zeros(1, np.uint32), np.zeros(1), np.zeros(1))
    for _ in range(ROUNDS):
        merged = _passed(sample, model).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("z", "n"))).alias("s"))
        total = lambda x: F.aggregate(F.col("s")[x], F.lit(0.0), lambda a, b: a + b)
        got = merged.select("at", (total("z") / F.size("s")).alias("z"), (total("n") / F.size("s")).alias("n")).toArrow().sort_by("at")
        model = Model(got["at"].to_numpy().astype(np.uint32), got["z"].to_numpy(), got["n"].to_numpy())
    drop_table(sample)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> DataFrame:
    """Rows (key, held_out, score, predicted) for every row of docs; texts are not shuffled.

    held_out: the CRC-32 of the key in decimals is a multiple of FOLDS; such rows are never learnt from, and rows with a null key count as held out.
    score is the likelihood of label 1 by the whole text alone, predicted whether it is at least 0.5. Null and empty texts have the
    score of the intercept. Without labels of both kinds every score is 0. Repeated keys are rows like others; labels that
    are null or not 0 or 1 are left out; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, key, text, label, limit)
    at, weight = model.compact() if model else (np.zeros(0, np.uint32), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast((at, weight))
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value
        for batch in slices(batches):
            out = []
            for t in batch.column(2).to_pylist():
                if not len(at):
                    out.append(0.0)
                    continue
                found = features(t)
                place = np.minimum(np.searchsorted(at, found), len(at) - 1)
                out.append(chance(float(weight[place[at[place] == found]].sum())))
            scores = np.array(out, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(True)).alias("held_out")
    return docs.select(key, held, text).mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")
