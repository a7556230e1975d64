"""Frames to masks: connected components of the foreground, frame by frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import raster


def label_frames(frames: DataFrame, level: float, h: int, w: int, min_area: int = -1) -> DataFrame:
    """``t, label, pixel``: foreground pixels with the first pixel of their 4-connected component.

    Components of more than ``min_area`` pixels are kept, all of them: none is taken for background.
    A frame is a row, so nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for t, v in zip(batch["t"], batch["v"], strict=True):
                pixel, label = raster.components((np.asarray(v, np.float64) > level).reshape(h, w))
                large = np.bincount(label, minlength=h * w)[label] > min_area
                parts.append((np.full(large.sum(), t), label[large], pixel[large]))
            cols = [np.concatenate(x).astype(np.int64) if parts else np.zeros(0, np.int64) for x in zip(*parts, strict=True)] or [[]] * 3
            yield pd.DataFrame(dict(zip(("t", "label", "pixel"), cols, strict=True)))

    return frames.select("t", "v").mapInPandas(run, "t long, label long, pixel long")


def slice_connect(frames: DataFrame, level: float, h: int, w: int, min_area: int) -> DataFrame:
    """``mask_id, t, pixel``: a mask per component. The id, ``t * h * w`` plus its first pixel, is ascending
    in frame and raster order and needs no numbering across frames."""
    labelled = label_frames(frames, level, h, w, min_area)
    return labelled.select((F.col("t") * (h * w) + F.col("label")).alias("mask_id"), "t", "pixel")


def component_stats(masks: DataFrame, w: int) -> DataFrame:
    """``mask_id, t, area, com_h, com_w`` of binary masks."""
    return masks.groupBy("mask_id", "t").agg(
        F.count("*").alias("area"),
        F.avg(F.call_function("div", "pixel", F.lit(w)).cast("double")).alias("com_h"),
        F.avg((F.col("pixel") % w).cast("double")).alias("com_w"),
    )
