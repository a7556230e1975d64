"""Adapters from plain tables to frames, voxels and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frame size of the ``embeddings`` table read as a video, and its foreground level.
H = W = 8
LEVEL = 0.1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, v``: one row per frame, the storage and kernel layout."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )


def voxels(frames: DataFrame) -> DataFrame:
    """``t, pixel, v``: the relational layout."""
    return frames.select("t", F.posexplode("v").alias("pixel", "v")).withColumn("pixel", F.col("pixel").cast("long"))


def foreground(voxels: DataFrame, level: float = LEVEL) -> DataFrame:
    return voxels.where(F.col("v") > level).select("t", "pixel")


def counted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mask_id, pixel, val``: multi-valued masks from ``lineitem``, suppliers over parts."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("long").alias("mask_id"), F.col("l_partkey").cast("long").alias("pixel"))
        .agg(F.count("*").cast("double").alias("val"))
    )


def truth(spark: SparkSession, sf_dir: str, level: float = 0.02) -> DataFrame:
    """``neuron, pixel``: pixels where the mean image of a label exceeds ``level``."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("neuron"), F.posexplode("embedding").alias("pixel", "v"))
    means = rows.groupBy("neuron", F.col("pixel").cast("long").alias("pixel")).agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.where(F.round("m", 9) > level).select("neuron", "pixel")


def truth_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``neuron, t``: the frames in which a neuron is active."""
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("neuron"), F.col("vec_id").alias("t"))
