"""Token counts by rank-synchronous merging of batched pre-tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkTable
from .common import slices

OVER = 1024
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """A byte-level BPE vocabulary as arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        if spec["normalizer"] or model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.table = ChunkTable(self.counts)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NONE)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (none empty).

        All sequences lie in one ragged array. In each step every sequence applies its lowest-rank pair at all its places,
        from the left where they overlap; sequences without a pair in the vocabulary leave the array.
        """
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        left = length.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        row = np.repeat(np.arange(len(tokens)), length)
        rank = np.full(len(symbol), NONE, np.int32)
        inner = np.flatnonzero(row[1:] == row[:-1])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            size = np.diff(np.append(start, len(symbol)))
            low = np.minimum.reduceat(rank, start)
            left[row[start]] = size
            keep = np.repeat(low != NONE, size)
            if not keep.all():
                symbol, row, rank = symbol[keep], row[keep], rank[keep]
                low, size = low[low != NONE], size[low != NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at) != 1)), np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            at = np.cumsum(stays)[at] - 1
            symbol, row, rank = symbol[stays], row[stays], rank[stays]
            for i in (at, at[at > 0] - 1):
                pair = (i + 1 < len(row)) & (row[np.minimum(i + 1, len(row) - 1)] == row[i])
                rank[i] = NONE
                i = i[pair]
                rank[i] = self.ranks(symbol[i], symbol[i + 1])
        return left

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of each part of a text; the strings of added tokens count one each."""
        words: dict[str, int] = {}
        owner, word = [], []
        extra = [0] * len(parts)
        for i, part in enumerate(parts):
            pieces = [part]
            if self.special and any(s in part for s in self.special):
                pieces = self.split_special.split(part)
                extra[i] = len(pieces) - 1
            for piece in pieces:
                for w in self.pattern.findall(piece):
                    owner.append(i)
                    word.append(words.setdefault(w, len(words)))
        if not words:
            return extra
        each = self.merge([w.encode() for w in words])
        total = np.bincount(np.array(owner), each[np.array(word)], len(parts)).astype(np.int64)
        return (total + np.array(extra)).tolist()

    def count(self, texts: list[str | None]) -> list[int]:
        return [head + sum(rest) for head, rest in self.table.values(texts)]


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One for each worker process."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", over: int = OVER) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit) for every row of docs; no shuffle.

    Null and empty texts have no bytes and no tokens. Null and repeated keys are rows like others; an empty table gives an
    empty result; other columns are ignored. Long texts are counted whole.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(public_tokenizers.path(vocabulary))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n = pa.array(m.count(texts), pa.int64())
            size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            limit = pa.array(np.asarray(n) > over)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, limit], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
