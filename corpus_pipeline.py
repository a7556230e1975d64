"""A training corpus from raw documents: filter, deduplicate, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm import mixing, ngram_join, packing, quality, toxicity
from voxelmill.llm._spark import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    In this stage and the others: null and empty texts are texts without words, very long ones count
    whole, equal texts fare alike, repeated rows repeat (the n-gram join keeps or drops them together),
    rows without an id stay, empty tables stay empty, and columns of any name pass through unchanged.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return ngram_join.distinct_documents(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and blocks of small sources once more, up to the target weights."""
    return mixing.mix(docs).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Classifiers, component labels and the bucket bounds aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
