"""Near-duplicates: MinHash with banding, signature and full-set verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, drop_table, flagged, materialize, slices, spread
from .graph import connected_components
from .text_arrays import distinct, scrambled, window_numbers, windows, word_begins, word_hashes

WORDS, PERCENT = 5, 75
#: A pair at the threshold shares a band with probability 1 - (1 - 0.75**4)**32, all but 5e-6.
BANDS, ROWS = 32, 4
#: Minima that must agree before full sets are compared: the mean at the threshold less 4.75 standard deviations (1e-6 of such pairs have fewer).
AGREE = 72
#: Members of a bucket, and bytes of their texts, that are compared in one task; larger buckets are compared block by block.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Buckets of several blocks up to this number are broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST_ROWS = 100_000
#: Shingles that a task keeps at hand as hashes, and as bytes (some 130 bytes each).
HELD = 1 << 18

_random = np.random.default_rng(20240101)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def words_of(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    solid = SOLID[data]
    keep = solid | np.concatenate(([False], solid[:-1])) if len(data) else solid
    return np.where(solid, data, 32).astype(np.uint8)[keep].tobytes().removesuffix(b" ")


def shingles(words: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of WORDS words; of fewer words, one of them all; none without words."""
    data = np.frombuffer(words, np.uint8)
    solid = data != 32
    begins = word_begins(solid) if len(data) else data
    return distinct(windows(word_hashes(data, solid, begins), WORDS)) if len(begins) else np.empty(0, np.uint64)


def count_shingles(words: bytes, found: np.ndarray) -> int:
    """How many shingles differ. Where no two of the text's windows share a hash, that is the number of hashes; else the windows are told apart by their words."""
    windows_of = max(1, words.count(b" ") + 2 - WORDS) if words else 0
    return len(found) if len(found) == windows_of else int(window_numbers(words.split(b" "), WORDS).max()) + 1


def exact_shingles(words: bytes) -> set[bytes]:
    """The shingles themselves."""
    w = words.split(b" ")
    return {b" ".join(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))}


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash (a x + b modulo 2**64) over the set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        h = np.multiply.outer(FACTORS, found[i : i + 1024])
        h += TERMS[:, None]
        np.minimum(low, h.min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A hash of each band's number and minima, as signed 64-bit numbers."""
    key = scrambled(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in low.reshape(BANDS, ROWS).T:
        key = scrambled(key * np.uint64(3) + column)
    return key.view(np.int64)


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (_key, n_shingles, size of the words, their digest, bands, sig: 16 bits of each minimum); without words the last three are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                if not words:
                    rows.append((0, 0, None, None, None))
                    continue
                found = shingles(words)
                low = minima(found)
                rows.append((count_shingles(words, found), len(words), _digest(words), band_keys(low), (low >> np.uint64(20)).astype("<u2").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["_key", "n_shingles", "size", "digest", "bands", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    signed = docs.select(key, text).mapInArrow(sign, f"_key {kind}, n_shingles long, size long, digest binary, bands array<long>, sig binary")
    return materialize(signed.withColumn("_rid", F.monotonically_increasing_id()), "signatures")


def words_for(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (_key, digest, words) of the documents in wanted (_key), and by way of the filter a few others."""
    keys = materialize(wanted.select(F.xxhash64("_key").alias("_h")).distinct(), "wanted")
    hit = flagged(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), keys, F.xxhash64("_key"), "_hit").where("_hit").select("_key", "_text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = list(map(words_of, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, words), pa.binary()), pa.array(words, pa.binary())], names=["_key", "digest", "words"])

    return hit.mapInArrow(build, f"_key {docs.schema[key].dataType.simpleString()}, digest binary, words binary")


class Group:
    """Members of a bucket that are compared with one another, or the members of one side with those of the other."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        self.band, self.side = table.column("_band")[0].as_py(), table.column("_side").to_numpy()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(n, BANDS * ROWS)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, BANDS)
        names = table.column("_part").to_pylist()
        number = {name: i for i, name in enumerate(dict.fromkeys(names))}
        #: Members of one part are joined already.
        self.part = np.array([number[name] for name in names])
        self.mixed = bool(self.side.any())

    def partners(self, i: int, among: np.ndarray) -> np.ndarray:
        """Of members after i, those not joined to it that agree by signature and meet it here in their first common band."""
        among = among[self.part[among] != self.part[i]]
        if self.mixed:
            among = among[self.side[among] != self.side[i]]
        among = among[(self.sig[among] == self.sig[i]).sum(1) >= AGREE]
        return among[(self.bands[among] == self.bands[i]).argmax(1) == self.band] if len(among) else among

    def join(self, i: int, j: int) -> None:
        self.part[self.part == self.part[j]] = self.part[i]


MEMBER = "_group long, _band int, _side int, _part {kind}, _key {kind}, digest binary, sig binary, bands array<long>"


def _promising(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of a group, the members that have a partner by signature."""
    if table.num_rows > 1:
        group, n = Group(table), table.num_rows
        found = np.zeros(n, bool)
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            rest = rest[~found[rest]] if found[i] else rest
            if len(rest) and len(near := group.partners(i, rest)):
                found[i] = found[near] = True
        if found.any():
            yield from table.filter(pa.array(found)).combine_chunks().to_batches()


def _links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of a group: pairs that reach the threshold on their full sets and join what is not joined yet, fewer than its members."""
    n, keys = table.num_rows, table.column("_key").to_pylist()
    group, words, out = Group(table), table.column("words"), []
    hashed: dict[int, np.ndarray] = {}
    exact: dict[int, set[bytes]] = {}

    def kept(cache: dict, i: int, make: Callable):
        if i not in cache:
            if sum(map(len, cache.values())) > HELD:
                cache.clear()
            cache[i] = make(words[i].as_py())
        return cache[i]

    for i in range(n - 1):
        if (group.part[i:] == group.part[i]).all():
            continue
        for j in group.partners(i, np.arange(i + 1, n)).tolist():
            if group.part[i] != group.part[j] and similar(kept(hashed, i, shingles), kept(hashed, j, shingles)):
                x, y = kept(exact, i, exact_shingles), kept(exact, j, exact_shingles)
                if 100 * (common := len(x & y)) >= PERCENT * (len(x) + len(y) - common):
                    group.join(i, j)
                    out.append((keys[i], keys[j]))
    if out:
        kind = table.column("_key").type
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*out, strict=True)], names=["a", "b"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _confirmed(members: DataFrame, alone: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b) within the groups of members (_group, _band, _side, _part, _rid)."""
    kind = docs.schema[key].dataType.simpleString()
    named = members.join(alone.select("_rid", "_key", "digest", "sig", "bands"), "_rid").select("_group", "_band", "_side", "_part", "_key", "digest", "sig", "bands")
    found = materialize(by_group(named, _promising, MEMBER.format(kind=kind)), "candidates")
    words = words_for(docs, found, key, text).dropDuplicates(["_key", "digest"])
    links = materialize(by_group(found.join(words, ["_key", "digest"]).select("_group", *found.columns[1:], "words"), _links, f"a {kind}, b {kind}"), "links")
    drop_table(found)
    return links


def _others(large: DataFrame, links: DataFrame, alone: DataFrame) -> DataFrame:
    """Groups that compare what the blocks of large buckets left apart: members outside a bucket's largest part with one another, and with that part."""
    parts = connected_components(links)
    placed = large.join(parts, F.col("_key") == F.col("node"), "left").withColumn("_part", F.coalesce("component", "_key"))
    placed = materialize(placed.select("_bucket", "_band", "_rid", "_part", "size"), "placed")
    by_part = placed.groupBy("_bucket", "_part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sums = by_part.groupBy("_bucket").agg(F.max(F.struct("n", "s", "_part")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > m.n")
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(s / BLOCK_BYTES)).cast("int")
    sums = materialize(sums.select("_bucket", F.col("m._part").alias("_main"), blocks(F.col("m.n"), F.col("m.s")).alias("_mains"), blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("_rests")), "large")
    each = placed.join(F.broadcast(sums) if sums.count() <= MAX_BROADCAST_ROWS else sums, "_bucket")
    main = F.col("_part") == F.col("_main")
    own = F.pmod(F.xxhash64("_rid", "_band"), F.when(main, F.col("_mains")).otherwise(F.col("_rests"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"))
    one = F.col("_own")
    to_main = F.transform(upto(F.col("_mains")), lambda x: pair(0, one, x, F.lit(0)))
    to_rest = F.transform(upto(F.col("_rests")), lambda x: pair(1, F.least(one, x), F.greatest(one, x), one > x))
    from_main = F.transform(upto(F.col("_rests")), lambda x: pair(0, x, one, F.lit(1)))
    each = each.withColumn("_own", own).withColumn("_x", F.explode(F.when(main, from_main).otherwise(F.concat(to_main, to_rest))))
    return each.select(F.xxhash64("_bucket", "_x.kind", "_x.lo", "_x.hi").alias("_group"), "_band", F.col("_x.side").alias("_side"), "_part", "_rid")


def near_links(docs: DataFrame, signed: DataFrame, key: str, text: str) -> DataFrame:
    """Edges (a, b) that connect all documents that the similarity connects, each confirmed on the shingles themselves.

    Equal word sequences are compared once, for the smallest key that has them. Members of a band's bucket are compared by signature, each pair in
    its first common band only; texts are fetched only for members with a partner. What is joined already is not
    compared again, so a group writes fewer links than it has members. A bucket that is larger than a block is compared within random blocks,
    each with the bucket's leader; where that leaves it in several parts, all outside the largest meet the rest, block by block.
    """
    some = signed.where("digest IS NOT NULL AND _key IS NOT NULL")
    first = some.groupBy("digest").agg(F.min(F.struct("_key", "_rid")).alias("x")).select(F.col("x._rid").alias("_rid"))
    alone = materialize(some.join(first, "_rid", "left_semi").select("_key", "_rid", "size", "digest", "bands", "sig"), "distinct")
    banded = materialize(alone.select("_key", "_rid", "size", F.posexplode("bands").alias("_band", "_bucket")), "bands")
    sums = {"_n": ("count", F.lit(1)), "_bytes": ("sum", F.col("size")), "_lead": ("min", F.xxhash64("_rid"))}
    members = spread(banded, ["_bucket"], sums, ["_rid"], "_n > 1")
    members = members.withColumn("_blocks", F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("int"))
    members = materialize(members.select("_bucket", "_band", "_key", "_rid", "size", "_blocks", (F.col("_lead") == F.xxhash64("_rid")).alias("_leads")), "members")
    drop_table(banded)
    here = F.when(F.col("_leads"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("_rid", "_band"), F.col("_blocks")).cast("int")))
    dealt = members.withColumn("_block", F.explode(here))
    dealt = dealt.select(F.xxhash64("_bucket", "_block").alias("_group"), "_band", F.lit(0).alias("_side"), F.col("_key").alias("_part"), "_rid")
    links = _confirmed(dealt, alone, docs, key, text)
    large = members.where("_blocks > 1")
    if large.isEmpty():
        return links
    return links.unionByName(_confirmed(_others(large, links, alone), alone, docs, key, text))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id, kept) for every row of docs.

    Documents with PERCENT per cent of their shingles in common are linked, and component_id is the smallest key reachable. Texts without
    words (null, empty) are linked with nothing. Rows that share a key are one document. Rows with a null key stand alone: no
    component, kept. An empty table gives an empty result; other columns are ignored.
    """
    signed = signatures(docs, key, text)
    links = near_links(docs, signed, key, text)
    some = signed.where("digest IS NOT NULL AND _key IS NOT NULL").select("_key", "_rid", "digest")
    owners = materialize(spread(some, ["digest"], {"_owner": ("min", F.col("_key"))}, ["_rid"]).select("_key", "_rid", "_owner"), "owners")
    again = owners.groupBy("_key").agg(F.min("_owner").alias("a"), F.max("_owner").alias("_hi")).where("a < _hi").select("_key", "a")
    same = owners.join(again, "_key").where("_owner != a").select("a", F.col("_owner").alias("b"))
    parts = connected_components(links.unionByName(same))
    of_owner = owners.join(parts.withColumnRenamed("node", "_owner"), "_owner", "left").select("_rid", F.coalesce("component", "_owner").alias("_component"))
    rows = signed.select("_key", "_rid", "n_shingles").join(of_owner, "_rid", "left")
    component = F.coalesce("_component", "_key")
    return rows.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_groups() keeps, all columns. Only rows that a filter may name are shuffled.

    Null and empty texts and rows with a null key stay; of rows that share a key all stay or none does; an empty table gives an empty result.
    """
    dropped = materialize(near_groups(docs, key, text).where("NOT kept").select(F.col(key).alias("_drop")).distinct(), "dropped")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    marked = flagged(docs.select(whole, F.col(key).alias("_key")), dropped.select(F.xxhash64("_drop").alias("_h")), F.xxhash64("_key"), "_hit")
    left = marked.where("_hit").join(dropped, F.col("_drop") == F.col("_key"), "left_anti")
    return marked.where("NOT _hit").select("_doc.*").unionByName(left.select("_doc.*"))
