"""Words and their hashes as arrays over the bytes of a text."""

from __future__ import annotations

import hashlib

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Long words whose hash is kept in each worker process, and their length at most.
MEMO, MEMO_BYTES = 1 << 16, 64
_long_words: dict[bytes, int] = {}


def scrambled(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def word_begins(solid: np.ndarray) -> np.ndarray:
    return np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))


#: The bytes of a little-endian number that a word of so many bytes fills.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _digests(words: list[bytes]) -> list[int]:
    values = list(map(_long_words.get, words))
    for i, word in enumerate(words):
        if values[i] is None:
            values[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            if len(word) <= MEMO_BYTES:
                if len(_long_words) >= MEMO:
                    _long_words.clear()
                _long_words[word] = values[i]
    return values


def word_hashes(data: np.ndarray, solid: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each run of solid bytes; begins as word_begins() gives them, not empty.

    Up to eight bytes are one number, whose hash is a bijection, so such words never collide; up to sixteen are two numbers, mixed one
    after the other; longer ones, and those with a zero byte, have a BLAKE2b digest.
    """
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))
    ends = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False]))) + 1
    size = ends - begins
    out = scrambled((eight[begins] & _FILLED[np.minimum(size, 8)]) + MIX)
    at = np.flatnonzero(size > 8)
    out[at] = scrambled(scrambled(out[at] + MIX) ^ scrambled(eight[begins[at] + 8] & _FILLED[np.minimum(size[at] - 8, 8)]))
    long, raw = size > 16, data.tobytes()
    if b"\0" in raw:
        long[np.searchsorted(begins, np.flatnonzero(data == 0), "right") - 1] = True
    at = np.flatnonzero(long)
    if len(at):
        out[at] = np.array(_digests([raw[i:j] for i, j in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]), np.uint64)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size hashes, in order; fewer than size give one of all. Different runs may share a hash: window_numbers() tells them apart."""
    out = scrambled(h[: max(1, len(h) - size + 1)])
    for j in range(1, min(size, len(h))):
        out = scrambled(out * np.uint64(3) + h[j : j + len(out)])
    return out


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def window_numbers(words: list[bytes], size: int) -> np.ndarray:
    """A number of each run of size words, equal for equal runs alone; fewer than size give one of all.

    Runs are numbered by doubling: equal words have equal numbers, and a longer run is the pair of the numbers of its halves.
    """
    of_word = {w: i for i, w in enumerate(dict.fromkeys(words))}
    one = np.fromiter(map(of_word.__getitem__, words), np.int64, len(words))
    size = min(size, len(words))
    have, width = one, 1
    powers = {1: one}
    while 2 * width <= size:
        have = _numbered(have[:-width] * len(words) + have[width:])
        width *= 2
        powers[width] = have
    rest = size - width
    while rest:
        step = 1 << (rest.bit_length() - 1)
        more = powers[step][width : width + len(have)]
        have = _numbered(have[: len(more)] * len(words) + more)
        width, rest = width + step, rest - step
    return have
