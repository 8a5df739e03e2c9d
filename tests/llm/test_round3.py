"""Periodic runs, source divergence and toxicity against plain versions, on awkward rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from perceptra.llm import divergence, periodic, queries, toxicity
from tests.oracle import agree, connect

from . import brute


def plain_runs(x):
    """Every maximal repetition with its smallest period, by trying all periods at all places."""
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(q % r == 0 and all(x[t] == x[t + r] for t in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_sequence(rng):
    x = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.randint(0, rng.choice([0, 1, 2, 9])) for _ in range(rng.randint(1, rng.choice([3, 8, 30])))]
        x += (unit * rng.randint(1, 9))[: rng.randint(1, 200)]
        if rng.random() < 0.3:
            x += [rng.randint(0, 3) for _ in range(rng.randint(0, 9))]
    return x[: rng.randint(0, 300)]


def test_runs_equal_all_periods_tried():
    rng, found = random.Random(11), 0
    for _ in range(800):
        x = random_sequence(rng)
        want = plain_runs(x)
        assert periodic.find_runs(np.array(x, np.int64)) == want, x
        found += len(want)
    assert found > 500


@pytest.mark.parametrize("length", [5, 6, 7, 4096, 20_001])
def test_one_word_repeated(length):
    assert periodic.find_runs(np.zeros(length, np.int64)) == ([(0, length, 1)] if length >= 6 else [])


def test_long_period_inside_other_words():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 1000, 777)
    x = np.concatenate([rng.integers(1000, 2000, 333), np.tile(unit, 6)[: 777 * 5 + 13], rng.integers(1000, 2000, 99)])
    assert periodic.find_runs(x) == [(333, 777 * 5 + 13, 777)]


def plain_tail(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def plain_digests(key, words):
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def awkward_periodic():
    rng = random.Random(9)
    rows = [(k, t) for k, t, _ in brute.awkward()]
    rows += [(1000 + i, " ".join(str(v) for v in random_sequence(rng))) for i in range(120)]
    rows += [(2000, "a b " * 3 + "a"), (2001, "a\n\na\ta a a\x0ba"), (2002, "a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a"), (-5, "x y z " * 9), (2003, "w " * 3000)]
    return rows


def test_digests_equal_the_plain_version(spark):
    rows = awkward_periodic()
    docs = brute.clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    got = periodic.digests(periodic.periodic_runs(periodic.with_tails(docs))).collect()
    want = [plain_digests(k, plain_tail(k, t)) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 5
    assert periodic.digests(periodic.periodic_runs(periodic.with_tails(docs.where("false")))).count() == 0


def audit_rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "Éa", "éa", "x", "y", "z", "the", "日本", "it's", "a1b"]
    rows = [(" ".join(rng.choices(words, [20, 9, 7, 3, 3, 1, 1, 1, 30, 2, 2, 2], k=rng.randint(0, 40))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot", "hot", "hot", "a", "b", None, "", "é", *map(str, range(12))])) for _ in range(400)]
    return rows + [(None, "xx", "s"), ("", "xx", "t"), ("only here", "yy", "lonely"), ("a" * 100_000, "en", "hot"), ("the " * 50_000, "fr", "a")] + rows[:20]


def plain_audit(rows):
    docs, count = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        peers = [s for x, s in groups if x == lang]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept]

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = share(count[lang, source]), share(sum((count[lang, s] for s in peers), Counter()))
        pair = [(sum(map(f, own, share(count[lang, s]))), s) for s in peers if s != source]
        term = [(f(p, q), t) for t, p, q in zip(kept, own, whole, strict=True) if count[lang, source][t] and p > q]
        for part, items in (("pair", pair), ("term", term)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, n) for n, (value, item) in enumerate(ranked, 1) if part == "pair" or n <= 10]
    return out


@pytest.mark.parametrize(("residents", "entries"), [(8, 1 << 17), (1, 5), (2, 40), (3, 7)])
def test_audit_equals_the_plain_version(spark, monkeypatch, residents, entries):
    monkeypatch.setattr(divergence, "RESIDENTS", residents)
    monkeypatch.setattr(divergence, "CHUNK_ENTRIES", entries)
    rows = audit_rows()
    docs = brute.clashing(spark.createDataFrame(rows, "text string, lang string, source string")).withColumns({c: F.lit("y") for c in ("term", "chunk", "slot", "turn", "part", "docs", "total")})
    got = divergence.audit_sources(docs.repartition(4)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(rows))
    assert divergence.audit_sources(docs.where("false")).count() == 0


def test_shares_do_not_overflow():
    counts, total, terms = np.array([0, 7, 9 * 10**11]), 10**13, 10**6
    assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts.tolist()]


def test_vectors_round_trip():
    at, n = np.array([0, 3, 70_000]), np.array([5, 1, 10**12])
    out = divergence.unpacked(divergence.packed(at, n), 70_001)
    assert out[at].tolist() == n.tolist() and np.count_nonzero(out) == 3
    assert divergence.unpacked(divergence.packed(np.array([], int), np.array([], int)), 4).tolist() == [0] * 4


def test_each_two_sources_meet_once():
    for blocks in range(1, 12):
        met = Counter()
        for j in range(blocks):
            for t in range(blocks // 2 + 1):
                if t and (2 * t != blocks or j < t):
                    met[frozenset((j, (j + t) % blocks))] += 1
        assert met == {frozenset((a, b)): 1 for a in range(blocks) for b in range(a)}


def test_features_are_the_n_grams():
    f = lambda t: set(toxicity.features(t).tolist())
    assert f(None) == f("") == f(" ,.!1") == {0}
    assert f("Stupid!") == f("stupid") and len(f("a b c")) == 1 + 3 + 2 + 1 + 1
    assert f("a b") < f("x a b") and len(f("a b") & f("b a")) == 3
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(50_000)]
    assert len(f(" ".join(words))) > 199_900


def test_learning_equals_a_dictionary_of_states():
    rng = random.Random(2)
    rows = [np.array([0, *sorted(rng.sample(range(1, 30), rng.randint(1, 9)))], np.uint32) for _ in range(200)]
    labels = [int(5 in r) for r in rows]
    z, n = np.zeros(30), np.zeros(30)
    toxicity.learn(rows, labels, z, n)
    zs, ns = Counter(), Counter()
    for row, y in zip(rows, labels, strict=True):
        w = {}
        for i in row.tolist():
            low = 0 if i == 0 else toxicity.L1
            w[i] = 0 if abs(zs[i]) <= low else -(zs[i] - np.sign(zs[i]) * low) / ((toxicity.BETA + ns[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in row.tolist():
            step = ((ns[i] + g * g) ** 0.5 - ns[i] ** 0.5) / toxicity.ALPHA
            zs[i] += g - step * w[i]
            ns[i] += g * g
    assert np.allclose(z, [zs[i] for i in range(30)]) and np.allclose(n, [ns[i] for i in range(30)])


def test_a_round_without_rare_coordinates_gives_the_same_weights():
    rng = random.Random(8)
    rows = [np.array([0, *sorted(rng.sample(range(1, 400), 12))], np.uint32) for _ in range(300)]
    labels = [int(min(r[1:]) < 20) for r in rows]
    z, n = np.zeros(400), np.zeros(400)
    toxicity.learn(rows, labels, z, n)
    at, zs, ns = toxicity.Model(np.zeros(1, np.uint32), np.zeros(1), np.zeros(1)).round(rows, labels)
    assert np.allclose(z[at], zs) and np.allclose(n[at], ns)
    assert set(np.flatnonzero(np.abs(z) > toxicity.L1)) <= set(at.tolist())


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    bad, good = ["vile", "nasty"], [f"w{i}" for i in range(80)]
    docs, labels = [], []
    for k in range(600):
        y = int(k % 6 == 0)
        words = rng.choices(good, k=rng.randint(3, 60))
        if y:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, y, 1))
    docs += [(None, "vile words"), (9001, None), (9002, ""), (9003, "w1 " * 100_000 + "vile"), (9003, "w1 " * 100_000)] + docs[:5]
    labels += [(None, 1, 1), (9001, None, 1), (1, 7, 1)]
    schema = "doc_id long, toxic int, quality int"
    return brute.clashing(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("toxic", F.lit("x")).repartition(3), spark.createDataFrame(labels, schema), docs


def test_toxicity_of_rows_held_out(toxic):
    docs, labels, rows = toxic
    got = toxicity.score_toxicity(docs, labels).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(k) for k, _ in rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) >= 0.98 * len(held)
    assert len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1
    assert sorted(r.predicted for r in got if r.doc_id == 9003) == [0, 1]
    again = toxicity.score_toxicity(docs.repartition(7), labels.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_toxicity_without_labels_of_both_kinds(toxic):
    docs, labels, rows = toxic
    for some in (labels.where("false"), labels.where("toxic = 1")):
        got = toxicity.score_toxicity(docs, some).collect()
        assert len(got) == len(rows) and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(toxic):
    docs, labels, _ = toxic
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.score_toxicity(docs, flipped).collect())) == sorted(map(str, toxicity.score_toxicity(docs, labels).collect()))


def test_held_out_accuracy_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op13_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    bad, good = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert len(bad) > 30
    assert sum(r.predicted for r in good) <= 0.005 * len(good)
    assert sum(r.predicted for r in bad) >= 0.75 * len(bad)  # of 3,155 rows to learn from; many toxic words of the rarer languages are in few
    better = sum((b.score > g.score) + 0.5 * (b.score == g.score) for b in bad for g in good) / (len(bad) * len(good))
    assert better > 0.97


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_source_divergence"])
def test_sql_gives_the_same_rows(spark, name):
    small = "/root/testdata/sf0.001"
    agree(queries.QUERIES[name](spark, small), connect(small), queries.ORACLES[name])
