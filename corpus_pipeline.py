"""From raw documents to packed sequences: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perceptra.llm import exact_dedup, minhash, mixing, packing, quality
from perceptra.llm.common import drop_table, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content, all columns.

    Null and empty texts fail the base rules; null and repeated keys are rows like others; without labels of both kinds the base rules decide alone; an
    empty table gives an empty one.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without blanks, all columns: that with the most code points, then the smallest key.

    Null keys come last; of rows that share key and length one stays, chosen by its content; an empty table gives an empty one.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, all columns: that with the smallest key.

    Texts without words and rows with a null key stay; of rows that share a key all stay or none does; an empty table gives an empty one.
    """
    return minhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it: not at all, once or twice; all columns.

    A null source is a source of its own, null texts have no words; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences: every id of every row in one piece.

    Null texts are empty and leave their end mark; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: A trained model, MinHash components and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the documents. A stage's table is deleted as soon as the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
