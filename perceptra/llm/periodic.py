"""Periodic runs of words: aligned power-of-two blocks are searched across their document, and occurrences at a distance of the block's scale seed exact extension."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices

#: A run has at least LEAST words and PERIODS periods.
LEAST, PERIODS = 6, 4
#: Words compared at first when a seed is extended; doubled as long as they agree.
STEP = 64

Run = tuple[int, int, int]


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, counted from 0."""
    of_word = dict(zip(dict.fromkeys(words), count()))
    return np.fromiter(map(of_word.__getitem__, words), np.int64, len(words))


def recurrences(x: np.ndarray) -> np.ndarray:
    """How many places further each value stands next; len(x) where it does not come again."""
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    out = np.full(len(x), len(x))
    out[order[again]] = order[again + 1] - order[again]
    return out


def extended(x: np.ndarray, begin: int, end: int, d: int) -> tuple[int, int]:
    """The largest range around begin..end whose values all stand d places further again."""
    last, step = len(x) - d, STEP
    while end < last:
        differ = x[end : min(end + step, last)] != x[end + d : min(end + step, last) + d]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + len(differ), 2 * step
    step = STEP
    while begin > 0:
        low = max(0, begin - step)
        differ = x[low:begin] != x[low + d : begin + d]
        if differ.any():
            begin -= int(differ[::-1].argmax())
            break
        begin, step = low, 2 * step
    return begin, end


def primitive(x: np.ndarray) -> bool:
    """Whether x is no shorter sequence repeated."""
    n = rest = len(x)
    f = 2
    while rest > 1:
        f = f if f * f <= rest else rest
        if rest % f:
            f += 1
            continue
        rest //= f
        if (x[n // f :] == x[: n - n // f]).all():
            return False
    return True


def seeds(x: np.ndarray, begins: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(begin, distances): where the block of size values at one of begins stands again, at distances of size to 2 size - 1."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key = [tuple(x[b : b + size].tolist()) for b in begins.tolist()]
    number = dict(zip(dict.fromkeys(key), count()))
    for block, k in number.items():
        found.add_word(block, k)
    found.make_automaton()
    of_block = np.fromiter(map(number.__getitem__, key), np.int64, len(key))
    at, which = [], []
    reach = np.minimum(begins + 3 * size - 1, len(x))
    parts = np.flatnonzero(np.concatenate(([True], begins[1:] > reach[:-1])))
    for lo, hi in zip(begins[parts].tolist(), reach[np.append(parts[1:] - 1, len(begins) - 1)].tolist(), strict=True):
        for end, k in found.iter(tuple(x[lo:hi].tolist())):
            at.append(lo + end - size + 1)
            which.append(k)
    width = len(x) + 2 * size
    places = np.sort(np.array(which, np.int64) * width + np.array(at, np.int64))
    low = np.searchsorted(places, of_block * width + begins + size)
    high = np.searchsorted(places, of_block * width + begins + 2 * size)
    for i in np.flatnonzero(high > low).tolist():
        yield int(begins[i]), places[low[i] : high[i]] % width - begins[i]


def find_runs(x: np.ndarray) -> list[Run]:
    """Every run (start, length, period) of a sequence of numbers, by start, then period.

    A run with smallest period q holds at least (PERIODS - 1) q places whose value stands q further again, so an aligned block of the largest power
    of two up to q lies among them, together with its copy q further. Scale by scale such blocks are searched with one automaton. Left
    out are blocks that no run of the scale can hold: with a value that does not recur within the scale, or so far inside a run of a
    smaller period that they stand again only at multiples of it.
    """
    n, runs = len(x), []
    if n < LEAST:
        return runs
    again, size = recurrences(x), 1
    while PERIODS * size <= n:
        fits = (again < 2 * size)[: n // size * size].reshape(-1, size).all(1)
        begins = np.flatnonzero(fits) * size
        known = np.array(runs).reshape(-1, 3)
        first, last = known[:, 0], known[:, 0] + known[:, 1]
        if len(begins) and len(known):
            order = np.argsort(first)
            farthest = np.maximum.accumulate(last[order])
            at = np.searchsorted(first[order], begins, "right") - 1
            begins = begins[(at < 0) | (begins + 3 * size - 1 > farthest[np.maximum(at, 0)])]
        reached: dict[int, int] = {}
        for begin, distances in seeds(x, begins, size) if len(begins) else ():
            for i in np.flatnonzero((first <= begin) & (last >= begin + 2 * size)).tolist() if len(distances) > 1 else ():
                distances = distances[(distances % known[i, 2] > 0) | (begin + distances + size > last[i])]
            for d in distances.tolist():
                if begin >= reached.get(d, 0):
                    low, high = extended(x, begin, begin + size, d)
                    reached[d] = high
                    if high - low + d >= max(LEAST, PERIODS * d) and primitive(x[low : low + d]):
                        runs.append((low, high - low + d, d))
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, runs: array of start, length, period, by start and period; collapsed) for every row of docs; no shuffle.

    Words are counted from 0 within the whole text. collapsed is the text of the words that lie in no run after its first period, with one
    space between. Null and empty texts have no words, no runs and an empty collapsed. Null and repeated keys are rows like others; an empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, found, left = [], [], []
            for t in batch.column(1).to_pylist():
                words = (t or "").encode().split()
                runs = find_runs(numbers(words))
                if runs:
                    gone = dropped(len(words), runs).tolist()
                    left.append(b" ".join([w for w, drop in zip(words, gone, strict=True) if not drop]))
                else:
                    left.append(b" ".join(words))
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, RUNS), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "runs", "collapsed"])

    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(key, text).mapInArrow(search, schema)


def with_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, in which every tenth key by hash repeats a stretch of its words up to the text's end: known runs for an audit.

    h is the CRC-32 of the key in decimals, g = h // 10; where h % 10 = 0, word i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Texts without words and rows with a null key or text stay.
    """
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int") + 1
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, place(i))), " "))

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    changed = F.transform(F.array(words), tail)[0]
    return docs.withColumn(text, F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(F.col(text)))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of periodic_runs(): (key, n_runs; start, length, period, exponent_milli of the longest run; SHA-256 of the runs and of the collapsed text)."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(lines)
    best = found.withColumn("_best", longest)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return best.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(ended, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
