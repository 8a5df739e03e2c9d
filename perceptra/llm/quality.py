"""Quality rules: base counts of a text, and a linear-chain CRF that tells content lines from boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .text_arrays import MIX, window_numbers, windows, word_begins, word_hashes

#: Base rules: fewer words fail, as does a larger percentage of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Labelled documents that the model is fitted on, at most; those with the smallest hash of their key. Of each, at most so many lines, around its middle.
MAX_LABELLED, MAX_LINES = 800, 256
#: Share of a document's words that must lie in content lines.
MIN_CONTENT = 0.5
ROUNDS, RATE, DECAY, CHAIN = 60, 0.3, 1e-3, 4

LETTER, SYMBOL, UPPER, DIGIT, EXCLAIM, PUNCT, BLANK, WIDE, TRAIL = range(9)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, LETTER, np.uint8)
    for group, chars in ((PUNCT, b"\"'(),-./:;=?@[\\]^_`{}~+"), (SYMBOL, b"#*$%&|<>"), (EXCLAIM, b"!"), (BLANK, b" \t\n\x0b\x0c\r")):
        kind[np.frombuffer(chars, np.uint8)] = group
    kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = UPPER, DIGIT
    kind[0x80:0xC0], kind[0xC0:] = TRAIL, WIDE
    return kind


CLASS = _byte_classes()


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


@dataclass
class Measured:
    """Base counts of a text and features and words of its lines."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_words: np.ndarray
    features: np.ndarray


FEATURES = 17


def measure(text: str | None) -> Measured:
    raw = (text or "").encode()
    data = np.frombuffer(raw + b"\n", np.uint8)
    kind = CLASS[data]
    breaks = data == 10
    line = np.cumsum(breaks) - breaks
    n_lines = int(line[-1]) + 1
    counts = np.bincount(line * 9 + kind, minlength=9 * n_lines).reshape(n_lines, 9).astype(np.float64)
    solid = kind != BLANK
    begins = word_begins(solid)
    n = len(begins)
    line_words = np.bincount(line[begins], minlength=n_lines)
    word_hash = word_hashes(data, solid, begins) if n else np.empty(0, np.uint64)
    covered = np.zeros(n, bool)
    if n > WINDOW:
        again = _repeated(windows(word_hash, WINDOW))
        if again.any():  # equal hashes are no proof: these windows are told apart by their words
            again = _repeated(window_numbers(raw.split(), WINDOW))
        at = np.flatnonzero(again)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
    lines, seen, dup = (text or "").split("\n"), set(), np.zeros(n_lines)
    for i, words in enumerate(line_words.tolist()):
        if words:
            if lines[i] in seen:
                dup[i] = 1
            seen.add(lines[i])
    words = np.maximum(line_words, 1)
    _, first = np.unique(word_hash ^ (line[begins].astype(np.uint64) * MIX), return_index=True)
    distinct = np.bincount(line[begins[first]], minlength=n_lines)
    chars = np.maximum(counts[:, :BLANK].sum(1) + counts[:, WIDE], 1)
    share = counts / chars[:, None]
    features = np.column_stack([
        np.ones(n_lines), share[:, SYMBOL], share[:, SYMBOL] > 0.05, share[:, SYMBOL] > 0.005, share[:, UPPER], share[:, UPPER] > 0.4, share[:, DIGIT], share[:, DIGIT] > 0.2,
        share[:, EXCLAIM], share[:, EXCLAIM] > 0.02, share[:, PUNCT], dup, 1 - distinct / words, (1 - distinct / words) > 0.6,
        np.bincount(line[begins], covered, n_lines) / words, line_words < 3, chars / words / 10 > 1.2,
    ])
    blank = line_words == 0
    features[blank, 1:] = 0
    symbols, word_chars = int(counts[:, SYMBOL].sum()), int(np.count_nonzero(solid & (kind != TRAIL)))
    return Measured(n, word_chars, symbols, int(dup.sum()), int(covered.sum()), line_words, features)


@dataclass
class LineModel:
    """Scores of boilerplate (0) and content (1) by feature, and of one label after another."""

    weights: np.ndarray
    moves: np.ndarray

    def label(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of a text's lines (Viterbi)."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [], 0.0, 0.0
        for i, (u, v) in enumerate((features @ self.weights).tolist()):
            if i:
                x, y, z, w = a + m00, b + m10, a + m01, b + m11
                back.append((y > x, w >= z))
                a, b = (y if y > x else x) + u, (w if w >= z else z) + v
            else:
                a, b = u, v
        out = np.empty(len(features), np.int8)
        at = int(b >= a)
        for i in range(len(out) - 1, 0, -1):
            out[i] = at
            at = int(back[i - 1][at])
        out[0] = at
        return out


def fit(chains: list[tuple[np.ndarray, np.ndarray]]) -> LineModel:
    """Maximises the likelihood of labelled line sequences by gradient ascent, all sequences side by side."""
    chains = sorted(chains, key=lambda c: -len(c[1]))
    n, longest = len(chains), max(len(y) for _, y in chains)
    x, y = np.zeros((longest, n, FEATURES)), np.zeros((longest, n), np.int64)
    size = np.array([len(c[1]) for c in chains])
    for k, (features, labels) in enumerate(chains):
        x[: len(labels), k], y[: len(labels), k] = features, labels
    live = [int((size > t).sum()) for t in range(longest)]
    inside = np.arange(longest)[:, None] < size
    seen_w = np.einsum("tnf,tnl->fl", x, np.eye(2)[y] * inside[..., None])
    seen_m = np.zeros((2, 2))
    np.add.at(seen_m, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
    w, m = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    total = inside.sum()
    for step in range(1, ROUNDS + 1):
        score = x @ w
        emit = np.exp(score - score.max(-1, keepdims=True))
        move = np.exp(m)
        fore, back = np.zeros((longest, n, 2)), np.ones((longest, n, 2))
        fore[0] = emit[0] / emit[0].sum(-1, keepdims=True)
        for t in range(1, longest):
            a = (fore[t - 1, : live[t]] @ move) * emit[t, : live[t]]
            fore[t, : live[t]] = a / a.sum(-1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            b = (back[t + 1, : live[t + 1]] * emit[t + 1, : live[t + 1]]) @ move.T
            back[t, : live[t + 1]] = b / b.sum(-1, keepdims=True)
        mean = fore * back * inside[..., None]
        mean /= np.maximum(mean.sum(-1, keepdims=True), 1e-300)
        pair = fore[:-1, :, :, None] * move * (emit[1:] * back[1:])[:, :, None, :] * inside[1:, :, None, None]
        pair /= np.maximum(pair.sum((-1, -2), keepdims=True), 1e-300)
        for k, (p, grad) in enumerate(((w, (seen_w - np.einsum("tnf,tnl->fl", x, mean)) / total - DECAY * w), (m, (seen_m - pair.sum((0, 1))) / total - DECAY * m))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad**2
            p += RATE * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return LineModel(w, m)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_LABELLED) -> LineModel | None:
    """A model fitted on at most limit labelled documents; None if they are not of both kinds.

    Every line of a document takes its document's quality as label; CHAIN documents in the order of a hash make a sequence, so
    that labels change within it. Lines are measured in the tasks; the driver gets the features of at most MAX_LINES lines of a document, which
    bounds what it holds whatever the texts' lengths. Rows with a null key, quality or text are left out.
    """
    order = F.xxhash64("_k")
    known = labels.select(F.col(key).alias("_k"), F.col("quality").alias("_q")).where("_k IS NOT NULL AND _q IS NOT NULL").orderBy(order, "_k", "_q").limit(limit)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t IS NOT NULL").join(F.broadcast(known), "_k")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for t in batch.column(3).to_pylist():
                lines = measure(t).features
                begin = max(0, (len(lines) - MAX_LINES) // 2)
                found.append(lines[begin : begin + MAX_LINES].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["h", "t", "q", "lines"])

    chosen = rows.select(order.alias("h"), F.xxhash64("_t").alias("t"), F.col("_q").cast("double").alias("q"), "_t").mapInArrow(features, "h long, t long, q double, lines binary")
    found = sorted((r.h, r.q, r.t, bytes(r.lines)) for r in chosen.orderBy("h", "q", "t").limit(limit).collect())
    if len({q > 0 for _, q, *_ in found}) < 2:
        return None
    measured = [(np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(np.float64), int(q > 0)) for _, q, _, x in found]
    parts = [measured[i : i + CHAIN] for i in range(0, len(measured), CHAIN)]
    return fit([(np.concatenate([x for x, _ in p]), np.concatenate([np.full(len(x), y) for x, y in p])) for p in parts])


def judge(text: str | None, model: LineModel | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_content_words)."""
    m = measure(text)
    failed = m.n_words < MIN_WORDS or 100 * m.n_repeat_words > MAX_REPEATED * m.n_words
    content = m.n_words if model is None else int(m.line_words[model.label(m.features) == 1].sum())
    return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, not failed and content >= MIN_CONTENT * m.n_words, content


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rate_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, base counts, base_failed, kept, n_content_words) for every row of docs; no shuffle.

    A document that passes the base rules is kept if at least MIN_CONTENT of its words lie in lines that the model marks as
    content; without labels of both kinds there is no model and all lines are content. Null text counts as empty, and fails. Null
    and repeated keys are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(zip(*(judge(t, model) for t in batch.column(1).to_pylist()), strict=True)) or [()] * 8
            numbers = [pa.array(c, pa.int64()) for c in (*rows[:5], rows[7])]
            flags = [pa.array(c, pa.bool_()) for c in rows[5:7]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers[:5], *flags, numbers[5]], names=[key, *COUNTS, "base_failed", "kept", "n_content_words"])

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, n_content_words long"
    return docs.select(key, text).mapInArrow(rate, schema)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that rate_documents() keeps, all columns. Null and empty texts fail the base rules; an empty table gives an empty result."""
    model = train(docs, labels, key, text)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([judge(t, model)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
