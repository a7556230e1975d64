"""Geometry of masks as group aggregates. Masks are ``mask_id, pixel, val`` with non-zero values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row(w: int) -> Column:
    return F.call_function("div", "pixel", F.lit(w))


def col(w: int) -> Column:
    return F.col("pixel") % w


def centroid(masks: DataFrame, w: int) -> DataFrame:
    """Unweighted mean row and column."""
    return masks.groupBy("mask_id").agg(F.avg(row(w).cast("double")).alias("com_h"), F.avg(col(w).cast("double")).alias("com_w"))


def centroid_int(masks: DataFrame, ids: DataFrame, w: int) -> DataFrame:
    """Centroid rounded half to even; (-1, -1) for ids without positive pixels."""
    found = masks.where("val > 0").groupBy("mask_id").agg(F.avg(row(w).cast("double")).alias("h"), F.avg(col(w).cast("double")).alias("w"))
    return ids.join(found, "mask_id", "left").select(
        "mask_id", *[F.coalesce(F.rint(c).cast("long"), F.lit(-1).cast("long")).alias(f"com_{c}") for c in ("h", "w")]
    )


def bbox_extent(masks: DataFrame, w: int) -> DataFrame:
    """Bounding box, and its extents as last minus first."""
    box = masks.groupBy("mask_id").agg(
        F.min(row(w)).alias("min_h"), F.min(col(w)).alias("min_w"), F.max(row(w)).alias("max_h"), F.max(col(w)).alias("max_w")
    )
    return box.withColumns({"ext_h": F.col("max_h") - F.col("min_h"), "ext_w": F.col("max_w") - F.col("min_w")})


def area(masks: DataFrame) -> DataFrame:
    """Sum of squared values, the number of pixels of a binary mask."""
    return masks.groupBy("mask_id").agg(F.sum(F.col("val") * F.col("val")).alias("area"))


def border_refine(masks: DataFrame, share: float) -> DataFrame:
    """Binary masks of the pixels that reach a share of their mask's peak."""
    peak = F.max("val").over(Window.partitionBy("mask_id"))
    return masks.withColumn("peak", peak).where(F.col("val") >= F.col("peak") * share).select("mask_id", "pixel", F.lit(1.0).alias("val"))
