"""Windows whose hashes collide are told apart by their words."""

import random
import re
from collections import Counter

import numpy as np

from perceptra.llm import minhash, quality, text_arrays

from . import brute

#: Two pairs of words whose window hashes are equal by construction.
P, Q = "mntyadvy giwlhvgk", "nbrqqzhx q&.8d~g^"


def colliding():
    mids = " ".join(f"mid{i}" for i in range(1, 6))
    filler = " ".join(f"f{i}" for i in range(20))
    tail = " ".join(f"x{i}" for i in range(1, 7))
    return [f"{P} x1 x2 x3 {mids} {Q} x1 x2 x3", f"{P} {tail} {filler} {Q} {tail}"]


def test_the_pairs_do_collide():
    data = [np.frombuffer(t.encode(), np.uint8) for t in (P, Q)]
    h = [text_arrays.windows(text_arrays.word_hashes(d, d != 32, text_arrays.word_begins(d != 32)), 2)[0] for d in data]
    assert h[0] == h[1]


def test_near_groups_counts_colliding_shingles(spark):
    docs = spark.createDataFrame(list(enumerate(colliding())), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles) for r in minhash.near_groups(docs).collect()) == [(i, len(brute.sets([(i, t)])[0])) for i, t in enumerate(colliding())] == [(0, 11), (1, 30)]


def test_colliding_windows_are_no_repeats(spark):
    docs = spark.createDataFrame(list(enumerate(colliding())), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.rate_documents(docs, labels).collect()}
    assert [found[i].n_repeat_words for i in range(2)] == [0, 0]
    assert not found[1].base_failed


def test_window_numbers_equal_slices():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randint(1, 30))]
        size = rng.randint(1, 12)
        got = text_arrays.window_numbers(words, size)
        want = [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
        assert len(got) == len(want)
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_counts_of_random_texts():
    rng = random.Random(6)
    for _ in range(200):
        text = re.sub(" +", " ", " ".join(rng.choices(["a", "b", "c d", "e"], k=rng.randint(0, 60))))
        words = minhash.words_of(text)
        assert minhash.count_shingles(words, minhash.shingles(words)) == len(brute.sets([(0, text)])[0])
        w = text.split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.measure(text).n_repeat_words == len(covered)
