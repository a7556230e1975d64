"""Pixels that several masks claim: drop them, or give each to one mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import pairs


def cancel(masks: DataFrame) -> DataFrame:
    """Pixels of one mask only; the counts are aggregated before they meet the pixels."""
    owners = masks.groupBy("pixel").agg(F.count("*").alias("n")).where("n = 1")
    return masks.join(owners, "pixel", "left_semi")


def smallest_owner(masks: DataFrame) -> DataFrame:
    """Each pixel goes to the mask with the least sum of values, the lowest id among equals."""
    totals = masks.groupBy("mask_id").agg(F.sum("val").alias("total"))
    owner = masks.join(totals, "mask_id").groupBy("pixel").agg(F.min(F.struct("total", "mask_id")).alias("o"))
    return owner.select(F.col("o.mask_id").alias("mask_id"), "pixel")


def assign_by_correlation(masks: DataFrame, vox: DataFrame, below: float) -> DataFrame:
    """``mask_id, pixel``: shared pixels of little-overlapping masks go to the best correlated one.

    A pair counts if its overlap is under a share of either area. Each of its shared pixels stays
    with the mask whose mean trace, shared pixels included, correlates best with the pixel's trace
    (the lower id among equals; a constant trace correlates with nothing). A pixel of several such
    pairs stays with the masks that lose it in none.
    """
    ratio = pairs.overlap_ratio(masks).where(F.col("ratio") < below)
    chosen = ratio.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    a = masks.select(F.col("mask_id").alias("i"), "pixel")
    b = masks.select(F.col("mask_id").alias("j"), "pixel")
    shared = chosen.join(a, "i").join(b, ["j", "pixel"])
    traces = mean_trace(masks, vox)
    claims = shared.select("i", "j", "pixel", F.explode(F.array("i", "j")).alias("mask_id"))
    need = claims.select("mask_id", "pixel").distinct()
    fit = (
        need.join(vox.select("pixel", "t", "v"), "pixel")
        .join(traces, ["mask_id", "t"])
        .groupBy("mask_id", "pixel")
        .agg(F.coalesce(F.nanvl(F.corr("v", "mean"), F.lit(-2.0)), F.lit(-2.0)).alias("fit"))
    )
    best = F.min_by("mask_id", F.struct(-F.round("fit", 12), "mask_id"))
    won = claims.join(fit, ["mask_id", "pixel"]).groupBy("i", "j", "pixel").agg(best.alias("won"))
    lost = won.select("pixel", F.when(F.col("won") == F.col("i"), F.col("j")).otherwise(F.col("i")).alias("mask_id")).distinct()
    return masks.select("mask_id", "pixel").join(lost, ["mask_id", "pixel"], "left_anti")


def mean_trace(masks: DataFrame, vox: DataFrame) -> DataFrame:
    """``mask_id, t, mean``: plain mean over a mask's pixels."""
    return masks.select("mask_id", "pixel").join(vox, "pixel").groupBy("mask_id", "t").agg(F.avg("v").alias("mean"))


