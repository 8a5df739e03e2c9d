"""Divergence of sources: term vectors of groups stay where they are while their peers' pass by in the rounds of a tournament."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, drop_table, materialize, slices

#: Documents of a language that a term must be in; scale of a share; what is added to a count.
MIN_DOCS, SCALE, PRIOR = 10, 1_000_000_000, 2
#: Terms that are listed for each group.
TOP = 10
#: Entries (term, source) of a language's chunk of terms, about; sources that reside in a slot, about.
CHUNK_ENTRIES, RESIDENTS = 1 << 17, 8
#: Different terms that a task holds before it hands on their counts.
HELD = 1 << 19

#: Bytes that separate terms become blanks; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The runs of letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(FOLD).split()


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), by long division in steps of a thousand, so that no product overflows."""
    whole, rest = np.divmod(counts.astype(np.int64) + PRIOR, np.int64(total + PRIOR * terms))
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, np.int64(total + PRIOR * terms))
        whole = whole * 1000 + more
    return whole + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector of counts, compressed."""
    steps = np.diff(places, prepend=0).astype("<u4")
    return zlib.compress(np.concatenate((steps.view(np.uint8), counts.astype("<i8").view(np.uint8))).tobytes(), 1)


def unpacked(blob: bytes, size: int) -> np.ndarray:
    """The counts of a chunk's terms, zeros among them."""
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    out = np.zeros(size, np.int64)
    out[np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))] = np.frombuffer(raw, "<i8", n, 4 * n)
    return out


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Rows (lang, source, term, n: occurrences, docs: documents), some for each task; term '' stands for the group itself."""

    def rows(kept: dict) -> pa.RecordBatch:
        flat = [(*g, t, c, d[t]) for g, (n, d) in kept.items() for t, c in n.items()]
        kinds = [pa.binary()] * 3 + [pa.int64()] * 2
        columns = [pa.array(c, k) for c, k in zip(list(zip(*flat, strict=True)) or [()] * 5, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns[:3]), *columns[3:]], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in slices(batches):
            for a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = ((a or "").encode(), (b or "").encode())
                if group not in kept:
                    kept[group] = Counter({b"": 0}), Counter()
                n, d = kept[group]
                here = Counter(terms_of(t))
                d.update(here.keys())
                for term, times in here.items():
                    n[term] += times
            if sum(len(n) for n, _ in kept.values()) > HELD:
                yield rows(kept)
                kept = {}
        yield rows(kept)

    return docs.select(lang, source, text).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def vectors(kept: DataFrame, groups: DataFrame, chunks: int) -> DataFrame:
    """Rows (_group, lang, chunk, source, size, terms, vector): of each chunk of a language's terms one row for every group and one, source null, for the language.

    A vector's places are those of the chunk's terms in order; terms, on the row of the language, are these terms, compressed.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    none = groups.where("source IS NOT NULL").select("lang", every, "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    some = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"), "source", "term", "n")
    rows = some.unionByName(none).select(F.xxhash64("lang", "chunk").alias("_group"), "lang", "chunk", "source", "term", "n")

    def pack(part: pa.Table) -> Iterator[pa.RecordBatch]:
        group = part.column("_group")[0].as_py()
        langs = part.column("lang").combine_chunks().dictionary_encode()
        chunk = part.column("chunk").to_numpy()
        of_lang = langs.indices.to_numpy()
        out = []
        for key in sorted(set(zip(of_lang.tolist(), chunk.tolist(), strict=True))):
            mine = part.filter(pa.array((of_lang == key[0]) & (chunk == key[1])))
            term = mine.column("term").cast(pa.binary()).to_pylist()
            names = sorted({t for t in term if t is not None})
            place = {t: i for i, t in enumerate(names)}
            at = np.fromiter((place.get(t, -1) for t in term), np.int64, len(term))
            sources = mine.column("source").combine_chunks().dictionary_encode()
            owner, n = sources.indices.to_numpy(), mine.column("n").to_numpy()
            head = (group, langs.dictionary[key[0]].as_py(), key[1])
            total = np.zeros(len(names), np.int64)
            np.add.at(total, at[at >= 0], n[at >= 0])
            out.append((*head, None, len(names), zlib.compress(b" ".join(names), 1), packed(np.arange(len(names)), total)))
            order = np.lexsort((at, owner))
            for who in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                own = who[at[who] >= 0]
                out.append((*head, sources.dictionary[int(owner[who[0]])].as_py(), len(names), None, packed(at[own], n[own])))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["_group", "lang", "chunk", "source", "size", "terms", "vector"])

    return by_group(rows, pack, "_group long, lang string, chunk int, source string, size long, terms binary, vector binary")


class Slot:
    """The residents of a slot, the language's vector beside them, and the best terms of each."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}
        self.names: list[bytes] = []
        self.whole = np.empty(0, np.int64)
        self.out: list[tuple] = []

    def take(self, row: dict) -> None:
        """One row after another: of the language (turn -1), residents (turn 0), then the peers that pass by."""
        counts = unpacked(row["vector"], row["size"])
        p = shares(counts, row["total"], row["terms_kept"]) if row["size"] else np.empty(0, np.int64)
        if row["turn"] < 0:
            self.whole, self.names = p, zlib.decompress(row["terms"]).split(b" ") if row["size"] else []
            return
        for peer, q in self.held.items():
            value = int(divergences(p, q).sum())
            self.out.append((row["lang"], row["source"], "pair", peer.encode(), value))
            self.out.append((row["lang"], peer, "pair", row["source"].encode(), value))
        if row["turn"] == 0:
            self.held[row["source"]] = p
            at = np.flatnonzero((counts > 0) & (p > self.whole))
            value = divergences(p[at], self.whole[at])
            if len(at) > TOP:
                at, value = at[near := value >= np.partition(value, -TOP)[-TOP]], value[near]
            best = heapq.nsmallest(TOP, zip((-value).tolist(), [self.names[i] for i in at.tolist()], strict=True))
            self.out += [(row["lang"], row["source"], "term", name, -v) for v, name in best]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a partition sorted by slot and turn: holds a slot's residents and one passing peer."""
    slot, here = Slot(), None
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.string()), columns[4]], names=["lang", "source", "part", "item", "value"])

    for batch in slices(batches):
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            if (at := (row["lang"], row["chunk"], row["slot"])) != here:
                yield rows(slot.out)
                slot, here = Slot(), at
            slot.take(row)
        yield rows(slot.out)
        slot.out = []


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source of a language is from every other one, and its most telling terms.

    A language keeps the terms that at least MIN_DOCS of its documents hold. p of a term in a group is shares() over these. Part pair: the sum of
    divergences() between the group's p and another source's of the language over all kept terms, every other source ranked. Part term: terms that the
    group has, with p above the language's, by divergence from it, the first TOP. Ranks are by value descending, then item in UTF-8 order.

    The terms of a language are cut into chunks and its sources into blocks. Each pair of chunk and block is a slot, where the block's vectors
    reside; every other block's vectors pass by in the turns of a round-robin tournament, compressed, so each pair of sources meets
    once a chunk and leaves both directions. A task holds one block of residents and one peer. Sums over chunks end it.

    Null texts, languages and sources count as ''. A group without terms is a group; a language without kept terms has pairs of value 0. Repeated rows count
    each; other columns are ignored; an empty table gives an empty result.
    """
    counted = term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = counted.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    known = materialize(spread.where((F.col("docs") >= MIN_DOCS) | (F.col("term") == "")).select("lang", "term", "source", "n"), "terms")
    kept = known.where("term != ''")
    groups = materialize(_sized(known), "groups")
    entries = kept.count()
    vector = materialize(vectors(kept, groups, max(1, -(-entries // CHUNK_ENTRIES))), "vectors")
    met = materialize(_dealt(vector, groups).mapInArrow(_meet, "lang string, source string, part string, item string, value long"), "meetings")
    for used in (known, vector, groups):
        drop_table(used)
    summed = met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def _sized(known: DataFrame) -> DataFrame:
    """Rows (lang, source, total, terms_kept, blocks) for every group; source null for the language."""
    real = F.col("term") != ""
    per_group = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = known.groupBy("lang").agg(F.sum("n").alias("_all"), F.count_distinct(F.when(real, F.col("term"))).alias("terms_kept"), F.count(F.when(~real, 1)).alias("_sources"))
    blocks = F.ceil(F.col("_sources") / RESIDENTS).cast("int").alias("blocks")
    both = per_group.join(per_lang, "lang").select("lang", "source", "total", "terms_kept", blocks)
    return both.unionByName(per_lang.select("lang", F.lit(None).cast("string").alias("source"), F.col("_all").alias("total"), "terms_kept", blocks))


def _dealt(vector: DataFrame, groups: DataFrame) -> DataFrame:
    """Every vector at the slots that it resides in or passes, by slot and turn.

    Block j passes slot (j + t) modulo the number of blocks at turn t, up to half of that number; where it is even, the last turn would bring each two
    blocks together twice, so only the lower half of the blocks goes.
    """
    total: Column = F.col("blocks")
    turns = F.sequence(F.lit(0), F.floor(total / 2).cast("int"))
    block = F.pmod(F.xxhash64("source"), total).cast("int")
    passing = F.filter(turns, lambda t: (t == 0) | (2 * t != total) | (F.col("_block") < t))
    at = F.transform(passing, lambda t: F.struct(F.pmod(F.col("_block") + t, total).alias("slot"), t.alias("turn")))
    everywhere = F.transform(F.sequence(F.lit(0), total - 1), lambda s: F.struct(s.alias("slot"), F.lit(-1).alias("turn")))
    rows = vector.join(groups, (vector["lang"] == groups["lang"]) & vector["source"].eqNullSafe(groups["source"])).select(vector["*"], "total", "terms_kept", "blocks")
    rows = rows.withColumn("_block", block).withColumn("_at", F.explode(F.when(F.col("source").isNull(), everywhere).otherwise(at)))
    dealt = rows.select("lang", "chunk", "_at.slot", "_at.turn", "source", "size", "terms", "vector", "total", "terms_kept")
    return dealt.repartition("lang", "chunk", "slot").sortWithinPartitions("lang", "chunk", "slot", "turn", "source")
