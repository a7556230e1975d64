"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import embed_dedup, hard_negatives, hash_search, licenses, media, mixing, ngram_join, packing, quality, sharding, toxicity, urls, vector_codes
from voxelmill.llm._spark import Scratch, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", packing.word_count(F.col("text")).alias("n_tokens"))
    mixed = mixing.schedule(Scratch(spark).save(docs, "words"), tokens=F.col("n_tokens"))
    return mixed.select(
        "doc_id",
        "source",
        "n_tokens",
        F.col("mix_weight").alias("weight"),
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_block").alias("block"),
        F.col("mix_rank").alias("block_rank"),
    )


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_hilbert_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_license_scan,
        op2_inverted_multi_index,
        op3_ngram_join,
        op4_length_buckets,
        op5_quality_votes,
        op6_media_columns,
        op7_weak_toxicity,
        op8_url_templates,
        op9_temperature_mixing,
        op10_feistel_shards,
        op11_hilbert_blocks,
        op12_hard_negatives,
        op13_multi_index_hashing,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.scan_sql(),
        "op2_inverted_multi_index": embed_dedup.near_duplicates_sql(),
        "op3_ngram_join": ngram_join.near_duplicates_sql(),
        "op11_hilbert_blocks": vector_codes.compress_sql(),
        "op12_hard_negatives": hard_negatives.mine_sql("a.vec_id % 100 = 0", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"),
    }
