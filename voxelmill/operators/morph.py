"""Morphology of masks: dilation and erosion as joins with offsets, opening and closing per mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import raster
from voxelmill.operators import features
from voxelmill.operators.filters import image, nested, shapes


def kernel_offsets(size: int) -> list[tuple[int, int]]:
    """Row and column offsets of the elliptical element of a size."""
    return [(int(y) - size // 2, int(x) - size // 2) for y, x in np.argwhere(raster.ellipse(size))]


def shifted(masks: DataFrame, offsets: list[tuple[int, int]], h: int, w: int) -> DataFrame:
    """``mask_id, pixel, val``: every pixel moved by every offset, without those that leave the image."""
    moves = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in offsets])
    moved = masks.select("mask_id", "val", features.row(w).alias("h"), features.col(w).alias("w"), F.explode(moves).alias("o"))
    moved = moved.select("mask_id", "val", (F.col("h") + F.col("o.y")).alias("h"), (F.col("w") + F.col("o.x")).alias("w"))
    inside = moved.where((F.col("h") >= 0) & (F.col("h") < h) & (F.col("w") >= 0) & (F.col("w") < w))
    return inside.select("mask_id", (F.col("h") * w + F.col("w")).alias("pixel"), "val")


def dilate(masks: DataFrame, size: int, h: int, w: int) -> DataFrame:
    """Greatest value under the element."""
    return shifted(masks, kernel_offsets(size), h, w).groupBy("mask_id", "pixel").agg(F.max("val").alias("val"))


def dilate_if(masks: DataFrame, size: int, least: float, most: float, h: int, w: int) -> DataFrame:
    """Dilates masks whose sum of values lies strictly between the bounds; the others stay."""
    totals = masks.groupBy("mask_id").agg(F.sum("val").alias("total"))
    chosen = totals.where((F.col("total") > least) & (F.col("total") < most))
    return dilate(masks.join(chosen, "mask_id", "left_semi"), size, h, w).unionByName(masks.join(chosen, "mask_id", "left_anti"))


def erode(masks: DataFrame, size: int, h: int, w: int) -> DataFrame:
    """Pixels whose whole neighbourhood under the element is set, as far as it lies in the image; the least value."""
    offsets = kernel_offsets(size)
    hits = shifted(masks, [(-y, -x) for y, x in offsets], h, w).groupBy("mask_id", "pixel").agg(F.count("*").alias("n"), F.min("val").alias("val"))
    within = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in offsets])
    inside = F.filter(
        within,
        lambda o: (features.row(w) + o["y"] >= 0) & (features.row(w) + o["y"] < h) & (features.col(w) + o["x"] >= 0) & (features.col(w) + o["x"] < w),
    )
    return hits.where(F.col("n") == F.size(inside)).select("mask_id", "pixel", "val")


def open_close(masks: DataFrame, size_open: int, size_close: int, h: int, w: int) -> DataFrame:
    """``mask_id, part, pixel, val``: closed, then opened, cut into 8-connected parts, each closed.

    A mask may have no part or several; ``part`` counts them from 0 in raster order.
    """
    k_open, k_close = raster.ellipse(size_open), raster.ellipse(size_close)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, pixels, vals in batch.itertuples(index=False):
                x = image(pixels, vals, h, w).astype(np.uint8)
                x = raster.opening(raster.close(x, k_close), k_open)
                for k, one in enumerate(shapes(x > 0)):
                    part = raster.close(one.astype(np.uint8), k_close)
                    rows += [(key, k, p, 1.0) for p in np.flatnonzero(part)]
            yield pd.DataFrame(rows, columns=["mask_id", "part", "pixel", "val"])

    return nested(masks).mapInPandas(run, "mask_id long, part long, pixel long, val double")


def open_close_between(masks: DataFrame, least: float, most: float, size_open: int, size_close: int, h: int, w: int) -> DataFrame:
    """``open_close`` of masks whose area lies strictly between the bounds; the others are their own part 0."""
    chosen = features.area(masks).where((F.col("area") > least) & (F.col("area") < most))
    worked = open_close(masks.join(chosen, "mask_id", "left_semi"), size_open, size_close, h, w)
    return worked.unionByName(masks.join(chosen, "mask_id", "left_anti").select("mask_id", F.lit(0).cast("long").alias("part"), "pixel", "val"))


def boundary(masks: DataFrame, h: int, w: int) -> DataFrame:
    """Pixels of a mask that lack one of their four neighbours."""
    full = shifted(masks, [(0, 1), (0, -1), (1, 0), (-1, 0)], h, w).groupBy("mask_id", "pixel").agg(F.count("*").alias("n")).where("n = 4")
    return masks.join(full, ["mask_id", "pixel"], "left_anti").select("mask_id", "pixel")
