"""Mixing sources to target weights by hash thresholds: built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights dealt to the sources in order of name, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all words; no source is taken more often than REPEATS times.
SHARE, REPEATS = 1.5, 2.0
HASH_BITS, LEVEL_BITS = 60, 12
#: A table of sources up to this many rows is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


def hash60(key: str):
    """60 bits of the MD5 of the key's digits (null: of nothing): the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _per_source(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= MAX_BROADCAST_ROWS else small, "_src", how)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Rows (_src, source_size, target): share of all sizes dealt by weight, capped at repeats times the source.

    The excess of capped sources goes to the others by weight: with sources ordered by cap over weight, the
    level is that of the first source whose cap is not below it, what the capped ones leave being divided by
    the weights of the rest. One row a source is sorted, never the documents.
    """
    s = sizes.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.max("_named").alias("_named"))
    turn = F.row_number().over(Window.orderBy(F.col("_named").desc(), "_src")) - 1
    w = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    w = w.withColumns({"_cap": F.col("source_size") * repeats, "_total": F.sum("source_size").over(Window.partitionBy()) * share})
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    w = w.withColumns({"_level": level, "_rank": F.row_number().over(order)})
    first = F.min_by("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_rank"))).over(Window.partitionBy())
    return w.select("_src", "source_size", F.least("_cap", F.coalesce(first, F.col("_level")) * F.col("_w")).alias("target"))


def _boundary(hist: DataFrame, slot: str) -> DataFrame:
    """Rows (_src, slot, _rest, _sum): of each source the first slot that takes the running sum above _rest; _rest becomes what is left for it."""
    run = F.sum("_sum").over(Window.partitionBy("_src").orderBy(slot))
    over = hist.withColumn("_run", run).where("_run > _rest")
    return over.groupBy("_src").agg(F.min_by(F.struct(slot, (F.col("_rest") - F.col("_run") + F.col("_sum")).alias("_rest"), "_sum"), slot).alias("x")).select("_src", "x.*")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (_src, source_size, target, _times, _below): every document is taken _times times, and once more if its hash is under _below.

    Words are summed by source and hash bucket; the bucket that crosses the budget is looked into with the next
    bits, twice, and then hash by hash; no document is sorted, and the narrow table is read once a level.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    t = materialize(targets.withColumn("_times", times).withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size")), "targets")
    at = t.select("_src", "_rest", F.lit(0).cast("long").alias("_at"))
    shift = HASH_BITS
    for step in (LEVEL_BITS, LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS):
        inside = _per_source(sizes, at).where(F.shiftright("_hash", shift) == F.col("_at"))
        shift -= step
        hist = inside.groupBy("_src", F.shiftright("_hash", shift).alias("_next")).agg(F.sum("_size").alias("_sum"), F.first("_rest").alias("_rest"))
        at = materialize(_boundary(hist, "_next").withColumnRenamed("_next", "_at"), "boundary")
    nearer = F.when(2 * F.col("_rest") > F.col("_sum"), 1).otherwise(0)
    cut = at.select("_src", (F.col("_at") + nearer).alias("_below"))
    return t.join(cut, "_src", "left").select("_src", "source_size", "target", "_times", F.coalesce("_below", F.lit(1 << HASH_BITS)).alias("_below"))


def _measured(docs: DataFrame, key: str, text: str, source: str) -> dict:
    return {
        "_src": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
        "_named": F.col(source).isNotNull(),
        "_hash": hash60(key),
        "_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
    }


def _copies():
    return F.least(F.col("_times") + (F.col("_hash") < F.col("_below")).cast("int"), F.lit(int(REPEATS)))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, size, source_size, target, copies, taken) for every row of docs.

    Size: words of the text (null: 0). A null source is a source, the last in order. Rows that repeat a key share
    its hash and so its fate. A source without words has target 0. Empty tables give empty results; other
    columns are ignored.
    """
    measured = _measured(docs, key, text, source)
    sizes = materialize(docs.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in measured.items()]), "sizes")
    plan = materialize(thresholds(sizes, source_targets(sizes)), "plan")
    rows = _per_source(sizes, plan).withColumn("copies", _copies())
    return rows.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("_size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs in the mix's proportions: each row 0, 1 or 2 times, all columns. The cut is a filter on the key's hash; texts are not shuffled.

    Null keys, texts and sources are those of mix(); rows that repeat a key share their fate; an empty table gives an empty result.
    """
    measured = _measured(docs, key, text, source)
    sizes = materialize(docs.select(*[c.alias(n) for n, c in measured.items()]), "sizes")
    plan = materialize(thresholds(sizes, source_targets(sizes)), "plan")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    taken = _per_source(docs.select(whole, measured["_src"].alias("_src"), measured["_hash"].alias("_hash")), plan).withColumn("_copies", _copies()).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
