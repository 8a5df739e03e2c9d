"""Each operator on awkward rows against its plain version, on an empty table, and beside columns of clashing names."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perceptra.llm import common, exact_dedup, graph, minhash, mixing, packing, quality, sharding, suffix_dedup, text_arrays, token_counts, url_filters, warc

from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.clashing(spark.createDataFrame(brute.awkward(), brute.SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def same(got, want):
    assert sorted(map(tuple, got), key=brute.key) == sorted(map(tuple, want), key=brute.key)


def test_token_counts(docs, empty, tokenizer):
    want = [(k, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t, _ in brute.awkward()]
    same(token_counts.count_tokens(docs).collect(), want)
    assert token_counts.count_tokens(empty).count() == 0


def test_merging_equals_the_library_on_random_text(tokenizer):
    rng = random.Random(1)
    parts = ["a", "b", "  ", " ", "\n", "the", "ing", "é", "🎉", "123", "'s", "!?", "\t", "日本", "<|endoftext|>", "zzzzzz", "\x1c", " ", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)]
    m = token_counts.merger(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert m.count(texts) == [len(x) for x in want]
    encode = packing.encoder("byte_bpe_50k.json")
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == want


def pages(spark):
    rows = [(3, "http://a.com/x", "<p>one</p>"), (1, "http://b.com/", "<p>one</p>"), (2, None, None), (4, "http://c/\r\nX: y", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "v", "x" * 200_000), (None, "w", "<p>one</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows, table = pages(spark)
    got = warc.archive_pages(brute.clashing(table).repartition(3), min_bytes=least).collect()
    groups = defaultdict(list)
    for k, _, h in rows:
        groups[h or ""].append(k)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.payload_digest].append(r)
    for html, keys in groups.items():
        payload = html.encode()
        found = by[base64.b32encode(hashlib.sha1(payload).digest()).decode()]
        first = min((k for k in keys if k is not None), default=None)
        assert all(r.payload_bytes == len(payload) for r in found) and len(found) == len(keys)
        responses = [r for r in found if r.record_type == "response"]
        if len(payload) < least:
            assert len(responses) == len(keys)
        else:
            assert [r.page_id for r in responses] == [first]
            assert all(r.refers_to == first for r in found if r.record_type == "revisit")
    assert all(r.refers_to is None for r in got if r.record_type == "response")


def test_warc_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def mixed(rows):
    """Targets by resharing the excess until none is above, and sizes by source."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(brute.WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed, left = {}, set(), 1.5 * sum(size.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            return size, target | share
        for s in over:
            target[s], left = 2.0 * size[s], left - 2.0 * size[s]
            fixed.add(s)


def test_mixing(spark, docs, empty):
    rows = brute.awkward() + [(100 + n, "w " * (n % 40), f"s{n % 7}" if n % 3 else "hot") for n in range(400)]
    d = brute.clashing(spark.createDataFrame(rows, brute.SCHEMA))
    got = mixing.mix(d).collect()
    size, target = mixed(rows)
    assert len(got) == len(rows)
    taken, limit, totals = Counter(), {}, {}
    for (k, t, s), n in Counter(rows).items():
        mine = [r for r in got if r.doc_id == k and r.size == len(brute.WORD.findall(t or "")) and r.source_size == size[s]]
        assert len(mine) >= n
        r = mine[0]
        assert abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken * n
        limit[s] = max(limit.get(s, 0), r.size)
        totals[s] = r.target
    for s, t in totals.items():
        assert abs(taken[s] - t) <= 2 * limit[s] + 1
    assert sorted(map(tuple, got), key=brute.key) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()), key=brute.key)
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_documents(d)
    assert copies.columns == d.columns
    assert copies.count() == sum(r.copies for r in got)


def test_packing(docs, empty, tokenizer):
    got = packing.pack_documents(docs).collect()
    ids = defaultdict(list)
    for k, t, _ in brute.awkward():
        ids[k].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    sequences = defaultdict(list)
    for r in got:
        assert any(brute.crc(x[r.start : r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for pieces in sequences.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end == 2048 or end & (end - 1) == 0 and end < 2048
    assert packing.pack_documents(empty).count() == 0


def test_neighbours_share_windows():
    rng = np.random.default_rng(1)
    topics = [rng.integers(i * 100, i * 100 + 100, (30, 300)).astype("<u2") for i in range(6)]
    ids = [topics[n % 6][n // 6] for n in range(180)]
    together = total = 0
    size = np.array(list(map(len, ids)))
    for pieces in packing.pack_shard(packing.Index(*packing._terms(ids), size, np.ones(1 << 16), 300.0), size)[0]:
        for a, b in zip(pieces, pieces[1:], strict=False):
            total += 1
            together += a[0] % 6 == b[0] % 6
    assert together / total > 0.8


def test_sharding(spark, docs, empty):
    rows = brute.awkward() + [(1000 + n, "text " * (n % 90) + str(n), "a") for n in range(900)] + [(5000 + n, "a copy that is everywhere", "a") for n in range(400)]
    got = sharding.shard_documents(brute.clashing(spark.createDataFrame(rows, brute.SCHEMA))).collect()
    import zlib

    want = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows]
    same([(r.doc_id, r.size, r.text_crc32) for r in got], want)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = max(n for _, n, _ in want)
    assert max(load.values()) - min(load.values()) <= big + 1000
    assert sharding.shard_documents(empty).count() == 0


def test_a_hot_text_is_cut_by_key(spark):
    rows = [(n, "hot text", "a") for n in range(3000)] + [(9000 + n, f"other {n}", "a") for n in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, brute.SCHEMA)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    loads = [r.b for r in got]
    assert len(loads) == 16 and max(loads) < 1.1 * sum(loads) / 16


def test_growing_moves_units_only_into_the_new_shard(spark):
    w = spark.createDataFrame([(n, -1, 0, 1, 1000 + n % 37) for n in range(600)], "vslot int, hot_text long, part int, parts int, bytes long")
    first = sharding.build_map(w, 16)
    grown = sharding.rebalance(first, w, 17)
    before = {r.vslot: r.shard for r in first.collect()}
    moved = [(before[r.vslot], r.shard) for r in grown.collect() if before[r.vslot] != r.shard]
    assert moved and all(to == 16 for _, to in moved)
    assert {r.version for r in grown.collect()} == {2}


def test_only_texts_heavier_than_a_part_are_cut_by_key(spark):
    """Small texts that share the hot text's slot stay together."""
    slot = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % sharding.SLOTS
    hot = "hot text"
    beside = [t for t in (f"small {n}" for n in range(60_000)) if slot(t) == slot(hot)][:5]
    assert len(beside) >= 3
    rows = [(n, hot, "a") for n in range(3000)] + [(9000 + n, f"other {n}", "a") for n in range(1000)] + [(20_000 + 6 * i + c, t, "a") for i, t in enumerate(beside) for c in range(6)]
    texts = {k: t for k, t, _ in rows}
    homes = defaultdict(set)
    for r in sharding.shard_documents(spark.createDataFrame(rows, brute.SCHEMA)).collect():
        homes[texts[r.doc_id]].add(r.shard)
    assert len(homes.pop(hot)) > 8 and all(len(s) == 1 for s in homes.values())


def test_a_stored_map_is_used_again_and_edited_when_a_shard_is_added(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    rows = [(n, f"text {n} " + "x" * (n % 50), "a") for n in range(2000)] + [(5000 + n, "hot", "a") for n in range(20_000)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    first = {r.doc_id: r.shard for r in sharding.shard_documents(docs, path=path).collect()}
    again = sharding.shard_documents(docs, slot_map=sharding.load_map(spark, path), path=path)
    assert {r.doc_id: r.shard for r in again.collect()} == first
    assert sharding.load_map(spark, path).first().version == 1
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=17, slot_map=sharding.load_map(spark, path), path=path).collect()}
    moved = {k for k in first if grown[k] != first[k]}
    size = {k: len(t) + 1 for k, t, _ in rows}
    assert 0 < sum(size[k] for k in moved) < sum(size.values()) / 8
    assert sum(size[k] for k in moved if grown[k] == 16) > 0.8 * sum(size[k] for k in moved)
    assert sharding.load_map(spark, path).first().version == 2 and sharding.load_map(spark, path, 1).first().version == 1
    with pytest.raises(ValueError):
        sharding.save_map(sharding.load_map(spark, path), path)
    more = docs.unionAll(spark.createDataFrame([(90_000 + n, f"new {n}", "a") for n in range(500)], brute.SCHEMA))
    later = {r.doc_id: r.shard for r in sharding.shard_documents(more, shards=17, slot_map=sharding.load_map(spark, path)).collect()}
    assert len(later) == len(first) + 500 and sum(later[k] != grown[k] for k in grown) < len(grown) / 20


def test_minhash(docs, empty):
    got = minhash.near_groups(docs).collect()
    rows = brute.awkward()
    want = [(k, n, c, c is None or k == c) for k, n, c in brute.components(rows)]
    same(got, want)
    assert minhash.near_groups(empty).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == sorted(k for k, _, c in brute.components(rows) if k is not None and k == c)


def test_minhash_group_of_near_copies_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{n}" for n in range(150)]
    rows = []
    for n in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((n, " ".join(w), "a"))
    same([(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, brute.SCHEMA)).collect()], brute.components(rows))


def test_large_buckets_that_stay_in_parts_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(12)
    rows = []
    for family in range(3):
        base = [f"w{n}" for n in range(60)] + [f"f{family}_{n}" for n in range(12)]
        for n in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((100 * family + n, " ".join(w), "a"))
    same([(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, brute.SCHEMA)).collect()], brute.components(rows))


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_flagged_says_no_wrong_no(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "MAX_BITS", limit)
    keys = spark.range(0, 1000, 7).select(F.xxhash64("id").alias("_h"))
    got = common.flagged(spark.range(1000), keys, F.xxhash64("id"), "hit").collect()
    assert len(got) == 1000 and all(r.hit for r in got if r.id % 7 == 0) and sum(r.hit for r in got) < 300


def test_slices_keep_all_rows():
    import pyarrow as pa

    texts = [None, "x" * 3_000_000, "", "y" * 9_000_000, "z", None] + ["w" * 500_000] * 12
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": texts})
    cut = list(common.slices([batch]))
    assert len(cut) > 3 and pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert all(b.num_rows == 1 or b.nbytes < 5 << 20 for b in cut)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, n) for n in range(1001, 1200)] + [(n, n + 1) for n in range(2000, 2060)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    same(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect(), [(n, top(n)) for n in list(root)])


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.remove_repeats(docs).collect()
    same([tuple(r)[:5] for r in got], brute.stripped(brute.awkward()))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_random_overlaps(spark):
    rng = random.Random(4)
    pool = "".join(rng.choices("ab ", k=400))
    rows = []
    for n in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(350)
            parts.append(pool[at : at + rng.randint(5, 120)])
            parts.append("".join(rng.choices("cdé", k=rng.randint(0, 60))))
        rows.append((n // 2 if n % 9 == 0 else n, "".join(parts), "a"))
    same([tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, brute.SCHEMA)).collect()], brute.stripped(rows))


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_suffix_dedup_removes_nothing_where_polynomial_hashes_collide(spark):
    bits = thue_morse(128)
    one = "".join("-" * 31 + ("m" if b else "n") for b in bits)
    two = "".join("-" * 31 + ("n" if b else "m") for b in bits)
    pool = [one.encode()[i : i + 50] for i in range(len(one) - 49)]
    shared = {two.encode()[i : i + 50] for i in range(len(two) - 49)} & set(pool)
    rows = [(1, one, "a"), (2, two, "a")]
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, brute.SCHEMA)).collect()]
    same(got, brute.stripped(rows))
    apart = [(1, "".join("-" * 31 + "mp"[b] for b in bits)), (2, "".join("-" * 31 + chr(ord("mp"[b]) + (1 if c else -1)) for b, c in zip(bits, thue_morse(128), strict=True)))]
    rows = [(k, t, "a") for k, t in apart]
    same([tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, brute.SCHEMA)).collect()], brute.stripped(rows))
    assert shared is not None


@pytest.mark.parametrize("bad", [False, True])
def test_pieces_are_told_apart_by_their_bytes(monkeypatch, bad):
    if bad:
        monkeypatch.setattr(suffix_dedup, "_hashes", lambda body, size: (size % 3).astype(np.uint64))
    rng = np.random.default_rng(8)
    for _ in range(50):
        size = rng.integers(1, 40, rng.integers(0, 60))
        body = rng.integers(97, 99, size.sum()).astype(np.uint8)
        which, pick = suffix_dedup.pooled(body, size)
        found = [body[end - n : end].tobytes() for end, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]
        assert len(set(which.tolist())) == len(set(found))
        assert all(pick[w] == found.index(x) for w, x in zip(which.tolist(), found, strict=True))


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 4000)
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdef ", k=150))
    rows = [(n, "".join(rng.choices("ghijk", k=rng.randint(0, 70))) + passage[rng.randint(0, 9) :] + "".join(rng.choices("lm", k=rng.randint(0, 70))), "a") for n in range(150)]
    rows += [(200, "z" * 7000, "a"), (201, "z" * 9000, "a"), (202, "yz" * 60, "a")]
    same([tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, brute.SCHEMA).repartition(4)).collect()], brute.stripped(rows))


def test_suffix_dedup_of_texts_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(10)
    base = "".join(rng.choices("abcdefgh", k=500))
    data = np.frombuffer(base.encode(), np.uint8)
    whole = suffix_dedup.anchor_runs(data)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    starts = []
    for at, part in suffix_dedup.chunks(data):
        start, count, anchor = suffix_dedup.anchor_runs(part)
        starts += [(at + s + i, a) for s, n, a in zip(start.tolist(), count.tolist(), anchor.tolist(), strict=True) for i in range(n)]
    assert starts == [(s + i, a) for s, n, a in zip(*(x.tolist() for x in whole), strict=True) for i in range(n)]


def test_repeated_intervals_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(40):
        depth = int(rng.integers(1, 7))
        shards = [np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(rng.integers(1, 6))]).astype(np.uint8) for _ in range(3)]
        text, want = np.concatenate(shards), defaultdict(list)
        for p in range(len(text) - depth + 1):
            if (text[p : p + depth] != 0).all():
                want[text[p : p + depth].tobytes()].append(p)
        place, block = suffix_dedup.repeated_intervals(shards, depth)
        got = defaultdict(list)
        for p, b in zip(place.tolist(), block.tolist(), strict=True):
            got[b].append(p)
        assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if len(v) > 1)
        prefixes = [text[p : p + depth].tobytes() for p in place]
        assert prefixes == sorted(prefixes)


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/en/x?q", None), (2, "https://www.example.com/en/", "x"), (3, "http://b.net/es/", None), (4, "http://free.org/1", '<link rel="canonical" href="http://b.net/es/">'),
        (5, "http://free.org/2", "<meta http-equiv=refresh content='0; url=/1'>"), (6, "http://free.org/3", '<LINK href="http://x.com/" REL=canonical>'), (7, None, "x"), (8, "no scheme", None),
        (9, "http://com", None), (10, "http://com/", None), (11, "http://free.org/4", '<link rel=canonical href=http://mix.org/>'), (12, "http://mix.org/", '<link rel="canonical" href="http://b.net/fr/z">'),
        (13, "http://mix.org/", '<link rel="canonical" href="http://ok.com/">'), (None, "http://b.net/es/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(brute.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[None][3] == "block"
    assert got[4][2:] == got[5][2:] == (None, "block")
    assert got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("com", "", None, "allow") and got[10][2] == "com/"
    assert got[11][3] == got[12][3] == "allow"  # ok.com is allowed by rule, and an allow comes first
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    more = url_filters.judge_urls(spark.createDataFrame([(1, "http://r.org/", None)], "page_id long, url string, html string"), spark.createDataFrame([("http://r.org/", "http://b.net/fr/")], "a string, b string"))
    assert more.first().verdict == "block"


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    want = brute.exact(brute.awkward())
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append((r.doc_id, r.keep_id))
    assert len(kept) == len({w[3] for w in want}) and all(len(v) == 1 and v[0][0] == v[0][1] for v in kept.values())
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    same([(r.doc_id,) for r in left.collect()], [(v[0][0],) for v in kept.values()])
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_stages_on_empty_tables(spark, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int")
    assert quality.keep_good(empty, labels).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1, 0), (12, 0, 0), (20, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.rate_documents(docs, labels).collect()
    want = [(k, *brute.base_counts(t)) for k, t, _ in brute.awkward()]
    same([tuple(r)[:6] for r in got], want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.rate_documents(empty, labels).count() == 0
    none = quality.rate_documents(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.keep_good(docs, labels.limit(0)).count() == sum(r.kept for r in none)


def test_a_labelled_document_of_a_million_lines(spark, monkeypatch):
    good = [(n, " ".join(brute.BASE) + "\n" + " ".join(brute.BASE[::-1]), "a") for n in range(30)]
    bad = [(100 + n, "$$ # 12 !!\n" * 20, "a") for n in range(30)]
    docs = spark.createDataFrame([*good, *bad, (999, "x\n" * 1_000_000, "a")], brute.SCHEMA)
    labels = spark.createDataFrame([(k, int(k < 100)) for k in [*range(30), *range(100, 130), 999]], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda chains: seen.extend(len(y) for _, y in chains))
    quality.train(docs, labels)
    assert seen and max(seen) <= quality.CHAIN * quality.MAX_LINES


def test_line_labels_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(d, known.where("doc_id % 2 = 0"))
    rows = d.join(known.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").collect()
    verdicts = [(quality.judge(t, model)[6], q) for t, q in rows]
    good = [v for v, q in verdicts if q == 1]
    bad = [v for v, q in verdicts if q == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.1


def test_likeliest_labels_are_found_by_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        model = quality.LineModel(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(6, quality.FEATURES))
        score = x @ model.weights
        best = max(range(64), key=lambda c: sum(score[t, c >> t & 1] for t in range(6)) + sum(model.moves[c >> t & 1, c >> (t + 1) & 1] for t in range(5)))
        assert model.label(x).tolist() == [best >> t & 1 for t in range(6)]


def test_neighbours_are_found_in_all_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOCAL_DOCS", 0, raising=False)
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    monkeypatch.setattr(packing, "SEEDS", 16, raising=False)
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice([chr(97 + 2 * t), chr(98 + 2 * t)], 6)) for _ in range(40)] for t in range(12)]
    rows = [(n, " ".join(rng.choice(words[n // 40 if n % 2 else n % 12], 60)), "a") for n in range(480)]
    topic = {n: n // 40 if n % 2 else n % 12 for n in range(480)}
    got = packing.pack_documents(spark.createDataFrame(rows, brute.SCHEMA).repartition(5)).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, topic[r.doc_id], r.length))
    pairs = [(a[1], b[1]) for w in windows.values() for a, b in zip(sorted(w), sorted(w)[1:], strict=False)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.8
    assert sum(sum(n for *_, n in w) < 2048 for w in windows.values()) <= 11
    assert {r.doc_id for r in got} == set(topic)


def test_scores_of_a_shard_are_those_of_the_formula():
    rng = np.random.default_rng(4)
    ids = [(rng.zipf(1.5, rng.integers(1, 60)) % 300).astype("<u2") for _ in range(120)]
    idf, mean = rng.random(1 << 16), 30.0
    index = packing.Index(*packing._terms(ids), np.array(list(map(len, ids))), idf, mean)
    for seed in range(0, 120, 7):
        score = np.zeros(120)
        for d in range(120):
            for t in np.intersect1d(ids[seed], ids[d]):
                tf = (ids[d] == t).sum()
                score[d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids[d]) / mean))
        assert np.allclose(index.scores(seed), score, rtol=1e-4)
        unused = np.arange(120) % 3 > 0
        ranked = list(index.ranked(seed, unused))
        assert sorted(ranked) == np.flatnonzero(unused).tolist() and (np.diff(score[ranked]) < 1e-3).all()


def test_documents_that_share_terms_are_dealt_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_TOKENS", 4000)
    rng = np.random.default_rng(5)
    words = [[f"t{t}x{n}" for n in range(40)] for t in range(12)]
    rows = [(n, " ".join(rng.choice(words[n % 12], 50)), "a") for n in range(480)]
    d = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    encoded = packing.encode_documents(d, "doc_id", "text", "byte_bpe_50k.json", packing.fit_deal(d, "text", "byte_bpe_50k.json"))
    df, n, tokens = packing.corpus_statistics(encoded)
    assert n == 480 and df[1] == 480
    dealt = packing.deal_documents(encoded, tokens).withColumn("part", F.spark_partition_id()).select("part", "_key").collect()
    parts = defaultdict(Counter)
    for r in dealt:
        parts[r.part][r._key % 12] += 1
    assert len(parts) > 5 and sum(c.most_common(1)[0][1] for c in parts.values()) / 480 > 0.5


def test_ids_of_very_long_runs(spark, tokenizer):
    rng = random.Random(6)
    texts = [" " * 2_000_000 + "x", "a" * 1_000_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "\n" * 5000 + "\t" * 5000, "é" * 3000, "#" * 700 + " " + " " * 600 + "end"]
    encode = packing.encoder("byte_bpe_50k.json")
    for t in texts:
        assert np.array_equal(np.frombuffer(encode(t), "<u2"), tokenizer.encode(t, add_special_tokens=False).ids)
    got = packing.pack_documents(spark.createDataFrame([(n, t, "a") for n, t in enumerate(texts)], brute.SCHEMA)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert all(r.n == r.all for r in got.collect())


def test_a_band_that_agrees_in_its_slices_only_loses_no_pair():
    import pyarrow as pa

    low = np.arange(1, minhash.BANDS * minhash.ROWS + 1, dtype=np.uint64) << np.uint64(20)
    other = low.copy()
    other[0] ^= np.uint64(1)
    bands = [minhash.band_keys(x) for x in (low, other)]
    assert bands[0][0] != bands[1][0] and bands[0][1] == bands[1][1]
    sig = [(x >> np.uint64(20)).astype("<u2").tobytes() for x in (low, other)]
    columns = {"_group": [7, 7], "_band": pa.array([1, 1], pa.int32()), "_side": pa.array([0, 0], pa.int32()), "_part": [1, 2], "_key": [1, 2], "digest": [b"x", b"y"], "sig": sig}
    group = pa.table({**columns, "bands": pa.array(bands, pa.list_(pa.int64()))})
    assert [r["_key"] for b in minhash._promising(group) for r in b.to_pylist()] == [1, 2]
    words = group.append_column("words", pa.array([b"a b c d e f", b"a b c d e f"]))
    assert [(r["a"], r["b"]) for b in minhash._links(words) for r in b.to_pylist()] == [(1, 2)]
    words = group.append_column("words", pa.array([b"a b c d e f", b"a b c d e g"]))
    assert not list(minhash._links(words))


def test_texts_whose_polynomial_hashes_collide_are_not_linked(spark):
    bits = thue_morse(1024)
    rows = [(1, "".join("mn"[b] for b in bits), "a"), (2, "".join("nm"[b] for b in bits), "a"), (3, "x\x00y", "a"), (4, "x\x00", "a")]
    assert [r.kept for r in minhash.near_groups(spark.createDataFrame(rows, brute.SCHEMA)).collect()] == [True] * 4
    words = [f"{a}{b}".encode() for a in ("", "a", "é", "x" * 7, "x" * 8, "\0") for b in ("b", "bb", "\0", "b\0")]
    data = np.frombuffer(b" ".join(words), np.uint8)
    solid = data != 32
    assert len(set(text_arrays.word_hashes(data, solid, text_arrays.word_begins(solid)).tolist())) == len(set(words))


def test_links_of_a_large_group_of_near_copies_are_fewer_than_its_members(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{n}" for n in range(120)]
    rows = []
    for n in range(800):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"e{n}"
        rows.append((n, " ".join(w), "a"))
    d = spark.createDataFrame(rows, brute.SCHEMA)
    signed = minhash.signatures(d, "doc_id", "text")
    links = minhash.near_links(d, signed, "doc_id", "text")
    distinct = len({t for _, t, _ in rows})
    assert links.count() < 8 * distinct < distinct * (distinct - 1) / 8
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(d).collect()]
    assert {c for *_, c in got} == {0}


def test_relative_targets_are_resolved(spark):
    want = {"other.html": "http://h/a/b/other.html", "../x": "http://h/a/x", "?id=2&amp;n=1": "http://h/a/b/p?id=2&n=1", "/r/./s": "http://h/r/s", "//g/y": "http://g/y", "../../../z?q=a/../b": "http://h/z?q=a/../b", "..": "http://h/a/", "https://k/?a&amp;b": "https://k/?a&b"}
    pages = spark.createDataFrame([("http://h/a/b/p?old=1", f'<link rel="canonical" href="{t}">') for t in want] + [("http://n", '<link rel="canonical" href="m">'), ("http://n", '<link rel="canonical" href="mailto:x">')], "url string, html string")
    assert {tuple(r) for r in url_filters.alias_edges(pages).collect()} == {("http://h/a/b/p?old=1", b) for b in want.values()} | {("http://n", "http://n/m")}
