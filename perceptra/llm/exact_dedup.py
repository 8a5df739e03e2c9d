"""Exact duplicates by progressive refinement: built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, materialize, spread

#: The characters that do not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
PREFIX = 256


def _normal(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _measured(docs: DataFrame, key: str, text: str, digests: bool) -> DataFrame:
    """Length and prefix hash of the normal text, the original's code points, on request the full hash."""
    n = docs.withColumns({"_norm": _normal(text), "_cps": F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")})
    full = F.sha2(F.col("_norm"), 256) if digests else F.lit(None).cast("string")
    return n.withColumns({"_len": F.octet_length("_norm").cast("long"), "_prefix": F.xxhash64(F.substring("_norm", 1, PREFIX)), "_full": full})


SLOT = F.xxhash64  # of _len and _prefix


def refine(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, survivors): rows of documents grouped by equal normal text, and the hashes _h of the lengths and prefixes whose rows were read in full.

    First rows whose length is unique fall out, then those whose prefix hash is unique for the length; only
    the others' full SHA-256 is computed, in a second scan (digests=True: in the first, since the caller
    wants every row's). groups has key, keep_id, group_size, kept, _len, _full.
    """
    spark, columns = docs.sparkSession, [key, "_cps", "_len", "_prefix", "_full"]
    rows = materialize(_measured(docs, key, text, digests).select(*columns).withColumn("_rid", F.monotonically_increasing_id()), "measured")
    by_length = spread(rows.select("_rid", "_len", "_prefix"), ["_len"], {"_n": ("count", F.lit(1))}, ["_rid"]).where("_n > 1").drop("_n")
    by_prefix = by_length.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    survivors = materialize(by_prefix.select(SLOT("_len", "_prefix").alias("_h")), "survivors")
    marked = flagged(rows, survivors, SLOT("_len", "_prefix"), "_hit")
    if digests:
        again = marked.where("_hit").drop("_hit")
    else:
        measured = flagged(_measured(docs, key, text, False), survivors, SLOT("_len", "_prefix"), "_hit").where("_hit")
        again = materialize(measured.withColumn("_full", F.sha2(F.col("_norm"), 256)).select(*columns).withColumn("_rid", F.monotonically_increasing_id()), "full")
    best = F.struct((-F.col("_cps")).alias("c"), F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("_rid").alias("r"))
    grouped = spread(again, ["_len", "_full"], {"group_size": ("count", F.lit(1)), "_best": ("min", best)}, ["_rid"])
    many = grouped.select(key, F.col("_best.k").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_best.r")).alias("kept"), "_len", "_full")
    alone = marked.where("NOT _hit").select(key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_len", "_full")
    return many.unionByName(alone), survivors


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256 of the normal text.

    Null text counts as empty; of equal texts the one with the most code points, then the smallest key
    (null last) stays, and of rows equal in both exactly one. Empty tables give empty results; other columns
    are ignored, whatever their names.
    """
    groups, _ = refine(docs.select(key, text), key, text, digests=True)
    return groups.select(key, "keep_id", "group_size", "kept", F.col("_full").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep, all columns. Only rows that may have copies are shuffled.

    Null and empty texts are equal, so one of them stays; of rows that share key and code points the one that is greatest by the hash of its text, then of
    all its columns, stays, of equal rows one; an empty table gives an empty result.
    """
    groups, survivors = refine(docs.select(key, text), key, text)
    keepers = materialize(groups.where("kept AND _full IS NOT NULL").select(F.col(key).alias("_keep"), F.col("_full").alias("_f")), "keepers")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = _measured(docs.select(whole.alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text", False)
    measured = flagged(measured, survivors, SLOT("_len", "_prefix"), "_hit")
    order = F.struct("_cps", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("t"), F.xxhash64("_doc").alias("d"))
    hit = measured.where("_hit").select("_doc", "_key", order.alias("_by"), F.sha2(F.col("_norm"), 256).alias("_full"))
    keeper = hit.join(keepers, (F.col("_f") == F.col("_full")) & F.col("_keep").eqNullSafe(F.col("_key")), "left_semi")
    # rows may repeat the keeper's key: the longest stays, one of several; partial aggregation comes before the shuffle
    one = keeper.groupBy("_full").agg(F.max_by("_doc", "_by").alias("_doc"))
    return measured.where("NOT _hit").select("_doc.*").unionByName(one.select("_doc.*"))
