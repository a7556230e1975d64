"""Filters on masks: activity, size, and shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions import raster
from voxelmill.operators import features


def active(times: DataFrame, run: int) -> DataFrame:
    """``mask_id``: masks with ``run`` consecutive frames or more; all for a run of 1."""
    distinct = times.select("mask_id", "t").distinct()
    if run <= 1:
        return distinct.select("mask_id").distinct()
    ahead = F.lead("t", run - 1).over(Window.partitionBy("mask_id").orderBy("t"))
    return distinct.withColumn("ahead", ahead).where(F.col("ahead") - F.col("t") == run - 1).select("mask_id").distinct()


def filter_active(masks: DataFrame, times: DataFrame, run: int, border: float) -> DataFrame:
    return features.border_refine(masks.join(active(times, run), "mask_id", "left_semi"), border)


def filter_small(masks: DataFrame, least: float, squared: bool = False) -> DataFrame:
    """Masks whose area is above a threshold (or its square)."""
    kept = features.area(masks).where(F.col("area") > (least * least if squared else least))
    return masks.join(kept, "mask_id", "left_semi")


def filter_ratio(masks: DataFrame, most: float, w: int) -> DataFrame:
    """Masks whose extents differ by a factor of at most ``most``.

    A single pixel stays; a mask one pixel thick is infinitely longer than thick and goes.
    """
    h, x = F.col("ext_h"), F.col("ext_w")
    keep = ((h == 0) & (x == 0)) | ((h > 0) & (x > 0) & (h <= x * most) & (x <= h * most))
    return masks.join(features.bbox_extent(masks, w).where(keep), "mask_id", "left_semi")


def nested(masks: DataFrame) -> DataFrame:
    """``mask_id, pixels, vals``: a row per mask for kernels; a mask is one image at most."""
    return masks.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("pixel", "val"))).alias("p")).select("mask_id", "p.pixel", "p.val")


def image(pixels, vals, h: int, w: int) -> np.ndarray:
    out = np.zeros(h * w)
    out[np.asarray(pixels, np.int64)] = np.asarray(vals, np.float64)
    return out.reshape(h, w)


def shapes(on: np.ndarray) -> list[np.ndarray]:
    """The 8-connected shapes of an image."""
    flat, first = raster.components(on, diagonal=True)
    out = []
    for k in np.unique(first):
        one = np.zeros(on.size, bool)
        one[flat[first == k]] = True
        out.append(one.reshape(on.shape))
    return out


def filter_ellipse(masks: DataFrame, bounds: tuple[float, float, float, float], h: int, w: int) -> DataFrame:
    """Compact shapes of each mask, filled; masks without any are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, pixels, vals in batch.itertuples(index=False):
                kept = np.zeros((h, w), bool)
                for one in shapes(image(pixels, vals, h, w) != 0):
                    points = raster.outline(one)
                    if len(points) > 1 and raster.is_compact(points, bounds):
                        kept |= raster.fill(one)
                rows += [(key, p, 1.0) for p in np.flatnonzero(kept)]
            yield pd.DataFrame(rows, columns=["mask_id", "pixel", "val"])

    return nested(masks).mapInPandas(run, "mask_id long, pixel long, val double")


def ellipse_split(masks: DataFrame, bounds: tuple[float, float, float, float], h: int, w: int) -> DataFrame:
    """``mask_id, compact``: whether the shape with the longest outline is compact; masks of single pixels are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, pixels, vals in batch.itertuples(index=False):
                outlines = [raster.outline(one) for one in shapes(image(pixels, vals, h, w) != 0)]
                longest = max(outlines, key=len, default=np.zeros((0, 2)))
                if len(longest) > 1:
                    rows.append((key, raster.is_compact(longest, bounds)))
            yield pd.DataFrame(rows, columns=["mask_id", "compact"])

    return nested(masks).mapInPandas(run, "mask_id long, compact boolean")
