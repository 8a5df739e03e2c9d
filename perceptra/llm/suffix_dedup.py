"""Repeated passages: merged Burrows-Wheeler transforms of the places that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, flagged, materialize, slices
from .text_arrays import scrambled

#: Length of the strings that are judged, and of the anchors that deal them out: a string's anchor is the least hash among its substrings of that length.
SPAN, ANCHOR = 50, 16
AROUND = SPAN - ANCHOR + 1
#: Longest run of string starts that travels as one piece, and bytes of text that are looked at at once.
RUN, CHUNK = 4096, 1 << 20
#: The filter of anchors that occur twice has a bit for every two bytes of text, from 2^20 to 2^30 (128 MB), and is broadcast. Beyond 2 GB it
#: fills up: more pieces travel, no repeat is lost.
LEAST_BITS, MOST_BITS = 20, 30
#: Bytes of text for each group of anchors that are counted together, of which there are a power of two from 2^8 to 2^16.
TEXT_PER_COUNT = 1 << 28
#: Anchors are counted by their upper 44 bits.
COUNTED = np.uint64(20)
#: An anchor at more places than this is hot: its strings are dealt one by one by all of their bytes. Hot anchors are known by a filter of 2^HOT_BITS bits
#: (8 MB whatever the text); an anchor that shares its bit with one is dealt alike in all documents, so no repeat is lost.
HOT, HOT_BITS = 1 << 16, 26
#: Bytes of text for each partition that merges transforms; symbols of a shard's transform.
TEXT_PER_TASK, SHARD = 4 << 20, 1 << 18
#: Anchors, and bytes of pieces, gathered before they are handed on.
FLUSH, FLUSH_BYTES = 1 << 21, 1 << 23
ZSTD = pa.Codec("zstd", 1)
#: Ends a piece; no byte of UTF-8 is 0xFF, so symbols are bytes plus one.
STOP = 0


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each substring of size bytes. Equal strings have equal hashes; unequal ones may, and are told apart by their bytes later."""
    h, power, done = data.astype(np.uint64) + np.uint64(1), 0x5851F42D4C957F2D, 1
    total, held = None, 0
    while True:
        if size & done:
            n = len(data) - held - done + 1
            total = h[:n] if total is None else total[:n] * np.uint64(power % (1 << 64)) + h[held : held + n]
            held += done
        if held == size:
            return scrambled(total)
        h, power, done = h[:-done] * np.uint64(power) + h[done:], power * power % (1 << 64), 2 * done


def anchor_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, anchor): runs of string starts with the same anchor; none if the text is shorter than SPAN."""
    if len(data) < SPAN:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    low, size = rolled(data, ANCHOR), 1
    while 2 * size <= AROUND:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (AROUND - size)], low[AROUND - size :])
    new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = np.diff(np.append(new, len(low)))
    if count.max() > RUN:
        parts = -(-count // RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(new, parts) + step * RUN
        return start, np.minimum(np.repeat(new + count, parts) - start, RUN), np.repeat(low[new], parts)
    return new, count, low[new]


def chunks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A long text as parts of CHUNK string starts each, and where they begin: every string lies whole in one part."""
    for at in range(0, max(1, len(data) - SPAN + 1), CHUNK):
        yield at, data[at : at + CHUNK + SPAN - 1]


def _packed(raw: bytes) -> bytes:
    return ZSTD.compress(raw, asbytes=True)


def _unpacked(blob: bytes, size: int) -> bytes:
    return ZSTD.decompress(blob, size, asbytes=True)


def _bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _dealt(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each part: the columns' values there, as bytes."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1])))
    upto = np.append(edge[1:], len(part))
    blobs = [pa.array([_packed(c[order[i:j]].tobytes()) for i, j in zip(edge, upto, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[order[edge]].astype(np.int64)), pa.array(upto - edge), *blobs], names=["_group", "n", *names])


def _blobs(table: pa.Table, sizes: np.ndarray, column: str, kind: type) -> np.ndarray:
    """The values of a column of blobs; sizes are their numbers of values."""
    width = np.dtype(kind).itemsize
    raw = [_unpacked(x, int(n) * width) for x, n in zip(table.column(column).to_pylist(), sizes, strict=True)]
    return np.concatenate([np.frombuffer(x, kind) for x in raw])


def _steps(sorted_values: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte of all, which compresses well."""
    return np.diff(sorted_values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def filter_bits(total: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (total // 2).bit_length()))


def repeated_anchors(docs: DataFrame, text: str, total: int) -> tuple[bytes, bytes]:
    """The filters of anchors that occur at two places or more, and of hot ones; total is the text's bytes."""
    filter_size = filter_bits(total)
    split = min(16, max(8, (total // TEXT_PER_COUNT).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held) >> COUNTED, return_counts=True)
            part = (found >> (np.uint64(64 - split) - COUNTED)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            upto = np.append(edge[1:], len(part))
            blobs = [[_packed(make(x[i:j])) for i, j in zip(edge, upto, strict=True)] for make, x in ((_steps, found), (np.ndarray.tobytes, times.astype(np.uint32)))]
            return pa.RecordBatch.from_arrays([pa.array(part[edge]), pa.array(upto - edge), *(pa.array(b, pa.binary()) for b in blobs)], names=["_group", "n", "anchor", "times"])

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                for _, data in chunks(_bytes_of(t)):
                    held.append(anchor_runs(data)[2])
                    n += len(held[-1])
                    if n >= FLUSH:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    def combine(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = table.column("n").to_numpy()
        raw = [_unpacked(x, int(n) * 8) for x, n in zip(table.column("anchor").to_pylist(), sizes, strict=True)]
        anchor, times = np.concatenate(list(map(_from_steps, raw))), _blobs(table, sizes, "times", np.uint32)
        order = np.argsort(anchor)
        anchor = anchor[order]
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        anchor, times = anchor[edge], np.add.reduceat(times[order].astype(np.int64), edge)
        group = table.column("_group")[0].as_py()

        def marked(found: np.ndarray, size: int) -> bytes:
            """The group's part of a filter of 2^size bits; empty where no bit is set."""
            bits = np.zeros(1 << (size - split) if len(found) else 0, np.uint8)
            bits[(found >> (np.uint64(64 - size) - COUNTED)).astype(np.int64) - (group << (size - split))] = 1
            return np.packbits(bits, bitorder="little").tobytes()

        yield pa.RecordBatch.from_pydict({"part": pa.array([group], pa.int64()), "bits": [marked(anchor[times > 1], filter_size)], "hot": [marked(anchor[times > HOT], HOT_BITS)]})

    dealt = docs.select(text).mapInArrow(gather, "_group long, n long, anchor binary, times binary")
    rows = by_group(dealt, combine, "part long, bits binary, hot binary", 1 << (split - 3)).collect()

    def whole(column: str, size: int) -> bytes:
        part = 1 << (size - split - 3)
        out = bytearray(part << split)
        for r in rows:
            if r[column]:
                out[r.part * part : (r.part + 1) * part] = r[column]
        return bytes(out)

    return whole("bits", filter_size), whole("hot", HOT_BITS) if any(r.hot for r in rows) else b""


def _one_by_one(data: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs, those of anchors in the filter of hot ones as single starts with a hash of their string for an anchor."""
    if not len(hot):
        return start, count, anchor
    slot = (anchor >> np.uint64(64 - HOT_BITS)).astype(np.int64)
    is_hot = (hot[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    if not is_hot.any():
        return start, count, anchor
    n = count[is_hot]
    each = np.repeat(start[is_hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rest = ~is_hot
    return np.concatenate((start[rest], each)), np.concatenate((count[rest], np.ones(len(each), np.int64))), np.concatenate((anchor[rest], rolled(data, SPAN)[each]))


#: What is known of each piece, and how it is kept.
FIELDS = {"start": np.uint32, "count": np.uint16, "anchor": np.uint32, "order": np.int64, "ident": np.int64}


def pieces(docs: DataFrame, bits: bytes, hot: bytes, parts: int) -> DataFrame:
    """Runs of strings whose anchor may occur again, dealt by anchor: docs has _order, _ident and the text; a row for each part and batch.

    Of equal pieces of one batch, those whose order is not the least are settled: they repeat whole. They travel without bytes or
    anchor, dealt by their order, so that a passage in many documents is a few pieces to the task that has its anchor.
    """
    known = docs.sparkSession.sparkContext.broadcast((bits, hot))
    shift = np.uint64(64 - (len(bits).bit_length() + 2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, hot = (np.frombuffer(x, np.uint8) for x in known.value)
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            start, count, anchor, order, ident, body = (np.concatenate(x) for x in zip(*held, strict=True))
            size = count + SPAN - 1
            first = np.cumsum(size) - size
            which, pick = pooled(body, size)
            low = np.full(len(pick), np.iinfo(np.int64).max)
            np.minimum.at(low, which, order)
            settled = order > low[which]
            columns = [start.astype(np.uint32), count.astype(np.uint16), (anchor >> np.uint64(8)).astype(np.uint32), order, ident]
            at = np.flatnonzero(settled)
            if len(at):
                part = (scrambled(order[at].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                rows = _dealt(part, [c[at] for c in columns], list(FIELDS))
                none = pa.array([b""] * rows.num_rows, pa.binary())
                yield rows.append_column("body", none).append_column("bytes", pa.array(np.zeros(rows.num_rows, np.int64)))
            at = np.flatnonzero(~settled)
            part = (anchor[at] % np.uint64(1 << 32) % np.uint64(parts)).astype(np.int64)
            rows = _dealt(part, [c[at] for c in columns], list(FIELDS))
            at = at[np.argsort(part, kind="stable")]
            sums = np.bincount(part, size[~settled]).astype(np.int64)
            sums = sums[sums > 0]
            joined, edges = _take(body, first[at], size[at]).tobytes(), np.concatenate(([0], np.cumsum(sums)))
            yield rows.append_column("body", pa.array([_packed(joined[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())).append_column("bytes", pa.array(sums))

        for batch in slices(batches):
            for order, ident, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for begin, data in chunks(_bytes_of(t)):
                    start, count, anchor = anchor_runs(data)
                    slot = (anchor >> shift).astype(np.int64)
                    hit = (mask[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    if hit.any():
                        start, count, anchor = _one_by_one(data, start[hit], count[hit], anchor[hit], hot)
                        body = _take(data, start, count + SPAN - 1)
                        held.append((start + begin, count, anchor, np.full(len(start), order), np.full(len(start), ident), body))
                        n += len(body)
                    if n >= FLUSH_BYTES:
                        yield from flush()
                        held, n = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(cut, "_group long, n long, start binary, count binary, anchor binary, order binary, ident binary, body binary, bytes long")


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The place of each suffix among the sorted suffixes of pieces that end with STOP; equal suffixes in any order."""
    n, step = len(symbols), 7
    padded = np.append(symbols, np.zeros(step, np.uint8))
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(step):
        key = key << np.uint64(8) | np.where(alive, padded[j : j + n], 0).astype(np.uint64)
        alive &= padded[j : j + n] != STOP
    order = np.argsort(key)
    key = key[order]
    edge = np.concatenate(([True], (key[1:] != key[:-1]) | ~alive[order][1:]))
    begin = np.flatnonzero(edge)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        both = rank[tied] * np.int64(n) + rank[tied + step]
        order = np.argsort(both)
        tied, both = tied[order], both[order]
        old = rank[tied]
        group = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        first = np.repeat(group, np.diff(np.append(group, len(tied))))
        begin = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        size = np.diff(np.append(begin, len(tied)))
        rank[tied] = old + np.repeat(begin, size) - first
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return rank


def repeated_intervals(shards: list[np.ndarray], depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(places, block): places of the concatenated shards whose suffixes share their first depth symbols with another's, in the order of these, and which share them.

    Each shard is sorted alone and kept as its transform: the symbol before each suffix, and the rank of the suffix one longer.
    The interleave of the shards begins in any order; in each round, suffixes in the present order are dealt by the symbol before them,
    stably, which gives the order by one symbol more. Two suffixes share a prefix one longer than before if the symbols are
    equal and the suffixes after them shared theirs. A suffix that shares its prefix with none, and so all longer
    ones that end in it, leave the interleave: that changes no one else's order. Suffixes are never compared across shards.
    """
    total, place, step, base = sum(map(len, shards)), [], [], 0
    width = np.int32 if total < 1 << 23 else np.int64
    for symbols in shards:
        rank = suffix_ranks(symbols)
        at = np.empty(len(rank), np.int64)
        at[rank] = np.arange(len(rank))
        place.append(at + base)
        step.append(((rank[at - 1] + base) << 8 | np.where(at > 0, symbols[at - 1], STOP)).astype(width))
        base += len(symbols)
    place, step = np.concatenate(place), np.concatenate(step)
    order, block = np.arange(base, dtype=np.int32), np.zeros(base, np.int32)
    for _ in range(depth):
        both = step[order]
        symbol = both.astype(np.uint8)
        inner = symbol != STOP
        symbol = symbol[inner]
        deal = np.argsort(symbol, kind="stable").astype(np.int32)
        symbol, block = symbol[deal], block[inner][deal]
        order = (both[inner] >> 8).astype(np.int32, copy=False)[deal]
        differ = np.ones(len(deal) + 1, bool)
        differ[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        shared = ~(differ[:-1] & differ[1:])
        order, block = order[shared], np.cumsum(differ[:-1], dtype=np.int32)[shared]
    return place[order], block


def _cuts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pieces of about a megabyte."""
    end, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + (1 << 20), "right")))
        yield i, j
        i = j


def _take(body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of pieces, one after the other."""
    out, at = np.empty(int(size.sum()), body.dtype), 0
    for i, j in _cuts(size):
        n = size[i:j]
        where = np.repeat(begin[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[at : at + len(where)] = body[where]
        at += len(where)
    return out


def _hashes(body: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece's bytes and length, eight bytes at a time over all pieces; equal hashes don't prove equal pieces."""
    padded = np.concatenate((body, np.zeros(7, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    begin = np.cumsum(size) - size
    h, order = scrambled(size.astype(np.uint64)), np.argsort(-size, kind="stable")
    for at in range(0, int(size.max(initial=0)), 8):
        order = order[: np.searchsorted(-size[order], -at)]
        left = size[order] - at
        value = np.ascontiguousarray(words[begin[order] + at]).view(np.uint64).ravel()
        value = np.where(left < 8, value & (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), value)
        h[order] = scrambled(h[order] * np.uint64(0x632BE59BD9B4E019) ^ value)
    return h


def pooled(body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, pick): for each piece the number of its bytes among the different ones, and for each of these the first piece that has them.

    Pieces are brought together by a hash and compared with the first of the hash byte by byte, in slices; those that differ from it are told apart by their bytes.
    """
    if not len(size):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.cumsum(size) - size
    _, pick, which = np.unique(_hashes(body, size), return_index=True, return_inverse=True)
    twin = pick[which]
    other = np.flatnonzero(twin != np.arange(len(size)))
    differ = [other[size[other] != size[twin[other]]]]
    other = other[size[other] == size[twin[other]]]
    for i, j in _cuts(size[other]):
        x = other[i:j]
        unequal = _take(body, begin[x], size[x]) != _take(body, begin[twin[x]], size[x])
        differ.append(x[np.logical_or.reduceat(unequal, np.cumsum(size[x]) - size[x])])
    odd = np.concatenate(differ)
    if len(odd):
        more: dict[bytes, int] = {}
        for x in odd.tolist():
            which[x] = more.setdefault(body[begin[x] : begin[x] + size[x]].tobytes(), len(pick) + len(more))
        extra = np.full(len(more), len(size))
        np.minimum.at(extra, which[odd] - len(pick), odd)
        pick = np.concatenate((pick, extra))
    return which, pick


def covered(anchor: np.ndarray, order: np.ndarray, count: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last): runs of string starts that also occur in a document earlier in order.

    Equal pieces are pooled: where the earliest has a smaller order, all of a piece is covered. Pieces that differ and share an
    anchor are judged by merged transforms, where another one's order is smaller.
    """
    size = count + SPAN - 1
    begin = np.cumsum(size) - size
    which, pick = pooled(body, size)
    low = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(low, which, order)
    whole = np.flatnonzero(order > low[which])
    found = [(whole, np.zeros(len(whole), np.int64), count[whole] - 1)]
    groups, of = np.unique(anchor[pick], return_inverse=True)
    least = np.full(len(groups), np.iinfo(np.int64).max)
    np.minimum.at(least, of, low)
    later = np.bincount(of, low > least[of], len(groups)) > 0
    judged = np.flatnonzero(later[of])
    if len(judged):
        own = size[pick[judged]] + 1
        text = _take(np.append(body, 0), np.append(begin, len(body))[pick[judged]], own).astype(np.uint8) + np.uint8(1)
        end = np.cumsum(own) - 1
        text[end] = STOP
        cuts = np.searchsorted(end, np.arange(SHARD, len(text), SHARD))
        edges = np.unique(np.concatenate(([0], end[np.minimum(cuts, len(end) - 1)] + 1, [len(text)])))
        place, block = repeated_intervals([text[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)])
        piece = np.repeat(np.arange(len(own)), own)
        offset = np.arange(len(text)) - (end - own + 1)[piece]
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else block
        value = low[judged][piece[place]]
        best = np.repeat(np.minimum.reduceat(value, starts), np.diff(np.append(starts, len(place)))) if len(block) else value
        flag = np.zeros(len(text) + 1, bool)
        flag[place] = best < value
        flag[:-1] &= offset < own[piece] - SPAN
        rise = np.flatnonzero(flag[:-1] & ~np.concatenate(([False], flag[:-2]))) if len(text) > 1 else np.flatnonzero(flag[:-1])
        fall = np.flatnonzero(flag[:-1] & ~flag[1:])
        owner = np.full(len(pick), -1)
        owner[judged] = np.arange(len(judged))
        mine = np.flatnonzero((order == low[which]) & (owner[which] >= 0))
        by = np.searchsorted(piece[rise], np.arange(len(judged) + 1))
        n = (by[1:] - by[:-1])[owner[which[mine]]]
        run = np.repeat(by[owner[which[mine]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append((np.repeat(mine, n), offset[rise[run]], offset[fall[run]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spans(order: np.ndarray, ident: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Ranges of bytes; those that follow on each other in a document are one."""
    by = np.lexsort((lo, ident, order))
    order, ident, lo, hi = order[by], ident[by], lo[by], hi[by]
    new = np.flatnonzero(np.concatenate(([True], (order[1:] != order[:-1]) | (ident[1:] != ident[:-1]) | (lo[1:] > hi[:-1])))) if len(lo) else np.empty(0, np.int64)
    hi = np.maximum.reduceat(hi, new) if len(new) else hi
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (order[new], ident[new], lo[new].astype(np.int32), hi.astype(np.int32))], names=["_order", "_ident", "lo", "hi"])


def repeated_spans(docs: DataFrame, text: str) -> DataFrame:
    """Rows (_order, _ident, lo, hi): bytes of documents that lie in a string which also starts in a document of smaller order."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits, hot = repeated_anchors(docs, text, total)
    parts = max(8, total // TEXT_PER_TASK)

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        settled = pc.equal(table.column("bytes"), 0)
        for rows, open_ in ((table.filter(settled), False), (table.filter(pc.invert(settled)), True)):
            if not rows.num_rows:
                continue
            c = {k: _blobs(rows, rows.column("n").to_numpy(), k, t) for k, t in FIELDS.items()}
            count = c["count"].astype(np.int64)
            if open_:
                piece, lo, hi = covered(c["anchor"], c["order"], count, _blobs(rows, rows.column("bytes").to_numpy(), "body", np.uint8))
            else:
                piece, lo, hi = np.arange(len(count)), np.zeros(len(count), np.int64), count - 1
            start = c["start"][piece].astype(np.int64)
            yield _spans(c["order"][piece], c["ident"][piece], start + lo, start + hi + SPAN)

    dealt = pieces(docs.select("_order", "_ident", text), bits, hot, parts)
    return by_group(dealt, judge, "_order long, _ident long, lo int, hi int", parts)


def kept_ranges(n: int, lo: list[int], hi: list[int]) -> tuple[list[tuple[int, int]], int]:
    """What is left of n bytes without the ranges, and the number of maximal ranges removed."""
    kept, at, spans = [], 0, 0
    for a, b in sorted(zip(lo, hi, strict=True)):
        if a > at or not spans:
            if a > at:
                kept.append((at, a))
            spans += 1
        at = max(at, b)
    if at < n:
        kept.append((at, n))
    return kept, spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256, kept_text bytes) for every row of docs.

    Of each text, as UTF-8 bytes (null: empty), those are removed that a string of SPAN bytes covers which also starts in a document with a smaller
    key. Matches end at the text's ends, are judged on the input, and may overlap. Rows that share a key do not remove from each other; a
    null key is larger than all. Keys are integers. Empty and short texts stay; an empty table gives an empty result; other columns
    are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    order = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(key).alias("_key"), order.alias("_order"), body.alias("_text"))
    again = materialize(rows.groupBy("_order").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("_order").alias("_h")), "again")
    if again.isEmpty():
        rows = rows.withColumn("_ident", F.lit(0).cast("long"))
    else:  # rows of a repeated key are told apart by their text
        rows = flagged(rows, again, F.xxhash64("_order"), "_again").withColumn("_ident", F.when(F.col("_again"), F.xxhash64("_text")).otherwise(0)).drop("_again")
    spans = materialize(repeated_spans(rows, "_text"), "spans")
    spans = spans.groupBy("_order", "_ident").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = rows.join(spans, ["_order", "_ident"], "left").select("_key", "_text", F.col("lo"), F.col("hi"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t, lo, hi in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw = t.encode()
                kept, n = kept_ranges(len(raw), lo or [], hi or [])
                left = b"".join(raw[a:b] for a, b in kept)
                out.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(strip, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
