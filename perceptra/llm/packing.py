"""Packing documents into windows beside their lexical neighbours."""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .text_arrays import scrambled

WINDOW, END = 2048, 1
#: Tokens for each partition of shards; tokens, and documents, that share an index at most.
PART_TOKENS, SHARD_TOKENS, SHARD_DOCS = 3_000_000, 4_000_000, 4096
SLICE = 1 << 18
K1, B = 1.2, 0.75
#: The classes that deal documents to shards are fitted on at most SAMPLE documents, by the TERMS terms of most weight, SAMPLE_TERMS of a document.
SAMPLE, TERMS, SAMPLE_TERMS, CLASSES, ROUNDS = 2048, 4096, 512, 64, 10
#: Weighted minima that order the documents of a class.
MINIMA = 3
#: Texts with a longer run of white space, or of other characters, go to the tokenizers library itself.
LONGEST_RUN = 512
BLANK_RUN = re.compile(rf"\s{{{LONGEST_RUN}}}")

_encoders: dict = {}


def encoder(vocabulary: str) -> Callable[[str | None], bytes]:
    """Text to the bytes of its ids as unsigned 16-bit numbers; one for each worker process.

    The ids are those of the tokenizers library with the vocabulary's .json. Its rank file, where there is one, gives the same ids several times
    faster for ordinary texts; texts with an added token's string or a very long run, which its pattern may not get through, are the library's. The
    tests hold one against the other.
    """
    if vocabulary not in _encoders:
        import tokenizers

        path = public_tokenizers.path(vocabulary)
        tokenizer = tokenizers.Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        plain = _rank_encoding(ranks).encode_ordinary if os.path.exists(ranks) else None

        def ordinary(text: str) -> bool:
            if len(text) >= LONGEST_RUN and (max(map(len, text.split()), default=0) >= LONGEST_RUN or BLANK_RUN.search(text)):
                return False
            return not any(map(text.__contains__, added))

        def encode(text: str | None) -> bytes:
            text = text or ""
            ids = plain(text) if plain and ordinary(text) else tokenizer.encode(text, add_special_tokens=False).ids
            return array("H", ids).tobytes()

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def _rank_encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several documents: document, term and frequency, by document and term. Sorted in slices of about SLICE tokens."""
    found, begin, held = [(np.empty(0, np.int32),) * 3], 0, 0
    for end, x in enumerate(ids, 1):
        held += len(x)
        if held >= SLICE or end == len(ids):
            doc = np.repeat(np.arange(begin, end, dtype=np.int64), [len(x) for x in ids[begin:end]])
            both = np.sort(doc << 16 | np.concatenate(ids[begin:end]).astype(np.int64))
            start = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            tf = np.diff(np.append(start, len(both)))
            both = both[start]
            found.append(((both >> 16).astype(np.int32), (both & 0xFFFF).astype(np.int32), tf.astype(np.int32)))
            begin, held = end, 0
    return tuple(map(np.concatenate, zip(*found, strict=True)))


@dataclass
class Deal:
    """What deals documents to shards: a class and the first of the document's terms in several weighted random orders.

    Two documents have the same first term with the probability that a term, drawn by squared idf from those of both, is in each; so
    documents that share telling terms lie side by side.
    """

    weight: np.ndarray
    column: np.ndarray
    centres: np.ndarray
    orders: np.ndarray

    def keys(self, begin: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A row for each document, whose terms begin there: its class and its minima."""
        out = np.zeros((len(begin), 1 + MINIMA), np.int32)
        for k, order in enumerate(self.orders):
            out[:, 1 + k] = np.minimum.reduceat(order[term], begin)
        if len(self.centres):
            value, column = self.weight[term] * np.log1p(tf), self.column[term]
            for d, (i, j) in enumerate(zip(begin, np.append(begin[1:], len(term)), strict=True)):
                out[d, 0] = (value[i:j] @ self.centres[column[i:j]]).argmax()
        return out


def weighted_orders(weight: np.ndarray) -> np.ndarray:
    """Random orders of the terms in which the first of a set is each of its terms with a probability by weight."""
    terms = np.arange(len(weight), dtype=np.uint64)
    out = np.empty((MINIMA, len(weight)), np.int32)
    for k in range(MINIMA):
        uniform = (scrambled(scrambled(terms + np.uint64(1)) + np.uint64(k)) >> np.uint64(11)).astype(np.float64) / 2**53
        out[k, np.argsort(-np.log(uniform + 1e-18) / np.maximum(weight, 1e-9), kind="stable")] = terms
    return out


def fit_deal(docs: DataFrame, text: str, vocabulary: str) -> Deal:
    """Fits term weights and classes (spherical k-means) on at most SAMPLE different texts, those with the smallest hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in slices(batches):
            found = [np.unique(np.frombuffer(encode(t), "<u2"), return_counts=True) for t in batch.column(1).to_pylist()]
            terms, tfs = ([x.astype(kind).tobytes() for x in column] for kind, column in zip(("<u2", "<i4"), list(zip(*found, strict=True)) or [()] * 2, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["h", "terms", "tfs"])

    share = min(1.0, 2 * SAMPLE / max(1, docs.count()))
    few = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    few = few.groupBy("h").agg(F.first("t").alias("t")).orderBy("h").limit(SAMPLE)
    rows = sorted(few.mapInArrow(count, "h long, terms binary, tfs binary").collect())
    sample = [(np.frombuffer(bytes(r.terms), "<u2"), np.frombuffer(bytes(r.tfs), "<i4")) for r in rows]
    df = np.zeros(1 << 16)
    for term, _ in sample:
        df[term] += 1
    idf = inverse_frequency(df, len(sample))
    total = np.zeros(1 << 16)
    for term, tf in sample:
        total[term] += idf[term] * np.log1p(tf)
    known = np.argsort(-total, kind="stable")[:TERMS]
    known = known[total[known] > 0]
    column = np.full(1 << 16, len(known), np.int32)
    column[known] = np.arange(len(known))
    x = np.zeros((len(sample), len(known) + 1), np.float32)
    for i, (term, tf) in enumerate(sample):
        x[i, column[term]] = idf[term] * np.log1p(tf)
    x[:, -1] = 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[:CLASSES].copy()
    for _ in range(ROUNDS if len(x) > CLASSES else 0):
        nearest = (x @ centres.T).argmax(1)
        for c in np.unique(nearest):
            mean = x[nearest == c].mean(0)
            centres[c] = mean / max(np.linalg.norm(mean), 1e-9)
    return Deal(idf.astype(np.float32), column, np.ascontiguousarray(centres.T), weighted_orders(idf**2))


def inverse_frequency(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - df + 0.5) / (df + 0.5))


class Index:
    """BM25 inverted index of one shard's documents, with the idf and mean length of the whole corpus.

    Terms in more than a sixteenth of the documents have no postings: their part of the scores of all pairs is one
    matrix product, of weights by presence. The others' postings are added up for each query.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float):
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        often = np.bincount(term, minlength=1 << 16) > max(16, len(size) // 16)
        column = np.cumsum(often) - 1
        dense = often[term]
        common = np.zeros((int(often.sum()), len(size)), np.float32)
        common[column[term[dense]], doc[dense]] = weight[dense]
        self.common = np.sign(common).T @ common
        del common
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        self.term, self.first = term, np.searchsorted(doc, np.arange(len(size) + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        lo, hi = self.start[terms], self.start[terms + 1]
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], len(self.first) - 1) + self.common[seed]

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents, the best match for the seed's terms first; of equals the first."""
        score = self.scores(seed)
        score[~unused] = -np.inf
        for _ in range(8):
            best = int(score.argmax())
            if score[best] == -np.inf:
                return
            score[best] = -np.inf
            yield best
        left = np.flatnonzero(score > -np.inf)
        yield from left[np.argsort(-score[left], kind="stable")].tolist()


#: (document, start, length).
Piece = tuple[int, int, int]


def pack_shard(index: Index, rest: np.ndarray, window: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of pieces, and the pieces of the last window, which is not full: every token of the documents, rest many of each, once.

    Each document in order seeds a window that its unused neighbours fill, best match first; the one that does not fit is cut, and its rest
    seeds the next window.
    """
    rest, start, full = rest.copy(), np.zeros(len(rest), np.int64), []
    unused = rest > 0
    pending, begin = -1, 0
    while True:
        if pending < 0:
            while begin < len(rest) and not unused[begin]:
                begin += 1
            if begin == len(rest):
                return full, []
            pending = begin
        seed, pending, space, pieces = pending, -1, window, []
        unused[seed] = False
        for d in chain((seed,), index.ranked(seed, unused)):
            unused[d] = False
            n = min(space, int(rest[d]))
            pieces.append((int(d), int(start[d]), n))
            start[d] += n
            rest[d] -= n
            space -= n
            if not space:
                pending = int(d) if rest[d] else -1
                break
        if space:
            return full, pieces
        full.append(pieces)


def cut_tail(pieces: list[Piece], window: int = WINDOW) -> Iterator[list[Piece]]:
    """A window that is not full as sequences whose lengths are powers of two, which need no padding."""
    size = sum(n for *_, n in pieces)
    for power in (1 << k for k in range(window.bit_length() - 1, -1, -1)):
        need, part = power if size & power else 0, []
        while need:
            d, at, n = pieces.pop(0)
            part.append((d, at, min(n, need)))
            if n > need:
                pieces.insert(0, (d, at + need, n - need))
            need -= min(n, need)
        if part:
            yield part


#: Rows of encoded documents: what whole windows leave of one, a whole window, and the counts of a task.
REST, WHOLE, COUNTS = range(3)
KEYS = ["_class", *(f"_min{k}" for k in range(MINIMA))]
ENCODED = {"kind": pa.int32(), "ids": pa.binary(), "start": pa.int64(), "doc_tokens": pa.int64(), "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "terms": pa.binary(), "tfs": pa.binary(), **dict.fromkeys(KEYS, pa.int32())}


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A binary value for each run of values."""
    edges = (np.append(begin, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(values.tobytes())])


def encode_documents(docs: DataFrame, key: str, text: str, vocabulary: str, deal: Deal, window: int = WINDOW) -> DataFrame:
    """Rows _key and ENCODED, two bytes for each id, a text's ids ending in END.

    Whole windows of long documents are sequences of their own. What they leave is a row with the terms of the whole document and their counts
    and the keys that deal it to a shard. Each task adds a row of its documents with each term, all documents and all tokens.
    """
    shared, key_type = docs.sparkSession.sparkContext.broadcast(deal), docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, end = encoder(vocabulary), array("H", [END]).tobytes()
        df, documents, tokens, sequence = np.zeros(1 << 16, np.int64), 0, 0, 1 << 62 | TaskContext.get().partitionId() << 32
        kind = pa.int64()

        def rows(keys: pa.Array, n: int, **columns) -> pa.RecordBatch:
            arrays = [x if isinstance(x := columns.get(name), pa.Array) else pa.nulls(n, t) if x is None else pa.array(x, t) for name, t in ENCODED.items()]
            return pa.RecordBatch.from_arrays([keys, *arrays], names=["_key", *ENCODED])

        for batch in slices(batches):
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            raw = [encode_text(t) + end for t in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
            doc, term, tf = _terms([np.frombuffer(x, "<u2") for x in raw])
            begin = np.searchsorted(doc, np.arange(len(raw)))
            df += np.bincount(term, minlength=1 << 16)
            documents, tokens = documents + len(raw), tokens + int(size.sum())
            long = [(i, at) for i in np.flatnonzero(size >= window).tolist() for at in range(0, int(size[i]) // window * window, window)]
            if long:
                crc = [_crc(np.frombuffer(raw[i], "<u2", window, 2 * at)) for i, at in long]
                owner = pa.array([i for i, _ in long])
                yield rows(batch.column(0).take(owner), len(long), kind=[WHOLE] * len(long), start=[at for _, at in long], doc_tokens=size[[i for i, _ in long]], ids_crc32=crc, sequence_id=range(sequence, sequence + len(long)))
                sequence += len(long)
            start = size // window * window
            dealt = dict(zip(KEYS, shared.value.keys(begin, term, tf).T.copy(), strict=True))
            terms, tfs = _cut(term.astype("<u2"), begin), _cut(tf.astype("<i4"), begin)
            left = rows(batch.column(0), len(raw), kind=[REST] * len(raw), ids=[x[2 * at :] for x, at in zip(raw, start.tolist(), strict=True)], start=start, doc_tokens=size, terms=terms, tfs=tfs, **dealt)
            yield left.filter(pa.array(start < size))
        at = np.flatnonzero(df)
        counts = pa.array([df[at].astype("<i8").tobytes()], pa.binary())
        yield rows(pa.nulls(1, kind), 1, kind=[COUNTS], terms=[at.astype("<u2").tobytes()], tfs=counts, start=[documents], doc_tokens=[tokens])

    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    schema = f"_key {key_type}, " + ", ".join(f"{n} {names[t]}" for n, t in ENCODED.items())
    rows = docs.select(F.col(key).alias("_key"), F.col(text)).mapInArrow(encode, schema)
    return materialize(rows.withColumn("_rid", F.monotonically_increasing_id()), "ids")


def corpus_statistics(encoded: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents with each term, documents, tokens: over all documents; one row a term of the vocabulary comes to the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts, documents, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                term = np.append(np.frombuffer(terms, "<u2").astype(np.int64), [-1, -2])
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.append(np.frombuffer(counts, "<i8"), [documents, tokens]))], names=["term", "df"])

    rows = encoded.where(F.col("kind") == COUNTS).select("terms", "tfs", "start", "doc_tokens").mapInArrow(spread, "term long, df long")
    found = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    df = np.zeros(1 << 16, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return df, found.get(-1, 0), found.get(-2, 0)


def deal_documents(encoded: DataFrame, tokens: int) -> DataFrame:
    """The documents' rests, in partitions of about PART_TOKENS tokens, those that share telling terms side by side; rows with equal terms may be parted, so none is hot."""
    order = [*KEYS, "_rid"]
    rests = encoded.where(F.col("kind") == REST).select("_key", "ids", "start", "doc_tokens", "terms", "tfs", *order)
    return rests.repartitionByRange(max(1, -(-tokens // PART_TOKENS)), *order).sortWithinPartitions(*order).drop(*order)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every token of every row of docs in one piece.

    Documents are dealt to shards by the telling terms they share (Deal); each shard is an inverted index of at most SHARD_TOKENS tokens or SHARD_DOCS
    documents in which every seed is scored against all unused documents by the terms of the whole documents; idf and mean length are the whole
    corpus's. What does not fill a shard's last window goes to the task's next shard; a task's last window is cut into powers of two. Nothing but
    terms and the sample comes to the driver. A null or empty text is its end id alone. Null and repeated keys are documents like others (a
    repeated row is packed again); an empty table gives an empty result; other columns are ignored. Very long texts are cut into windows like others.
    """
    encoded = encode_documents(docs, key, text, vocabulary, fit_deal(docs, text, vocabulary), window)
    df, n, tokens = corpus_statistics(encoded)
    mean = max(1.0, tokens / max(1, n))
    shared = docs.sparkSession.sparkContext.broadcast(inverse_frequency(df, n))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, key_type = TaskContext.get().partitionId() << 32, pa.int64()
        held: list[tuple] = []

        def written(full: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            owner, rows = [], []
            for pieces in full:
                offset = 0
                for d, at, size in pieces:
                    k, ids, start, whole, *_ = held[d]
                    owner.append(k)
                    rows.append((start + at, size, _crc(ids[at : at + size]), whole, sequence, offset))
                    offset += size
                sequence += 1
            cells = np.array(rows, np.int64).reshape(-1, len(columns))
            return pa.RecordBatch.from_arrays([pa.array(owner, key_type), *map(pa.array, cells.T.copy())], names=[key, *columns])

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal held
            terms, tfs = ([np.frombuffer(row[at], kind) for row in held] for at, kind in ((4, "<u2"), (5, "<i4")))
            doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t in terms])
            index = Index(doc, np.concatenate(terms), np.concatenate(tfs), np.array([row[3] for row in held], np.float64), shared.value, mean)
            full, left = pack_shard(index, np.array([len(row[1]) for row in held], np.int64), window)
            out = written(full + list(cut_tail(left, window)) if last else full)
            held = [(k, ids[at:], start + at, *more) for k, ids, start, *more, at in ((*held[d], at) for d, at, _ in left)]
            return out

        tokens = 0
        for batch in slices(batches):
            key_type = batch.schema.field(0).type
            for k, ids, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((k, np.frombuffer(ids, "<u2"), *more))
                tokens += len(ids) // 2
                if tokens >= SHARD_TOKENS or len(held) >= SHARD_DOCS:
                    yield packed(False)
                    tokens = sum(len(row[1]) for row in held)
        if held:
            yield packed(True)

    kind = docs.schema[key].dataType.simpleString()
    rests = deal_documents(encoded, tokens).mapInArrow(pack, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in columns))
    whole = encoded.where(F.col("kind") == WHOLE)
    return whole.select(F.col("_key").alias(key), "start", F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")).unionAll(rests)
