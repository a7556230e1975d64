"""Pre-processing: scaling, clamping, and windows along time and space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of one pixel that a window task orders; longer videos are cut, with their borders repeated.
CHUNK = 4096


def normalize_minmax(vox: DataFrame) -> DataFrame:
    """Values scaled by the video's least and greatest one; null for a constant video."""
    low, high = vox.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return vox
    return vox.withColumn("v", (F.col("v") - low) / F.nullif(F.lit(high - low), F.lit(0.0)))


def clamp_max(vox: DataFrame, level: float) -> DataFrame:
    return vox.withColumn("v", F.least("v", F.lit(level)))


def clamp_min(vox: DataFrame, level: float) -> DataFrame:
    return vox.withColumn("v", F.greatest("v", F.lit(level)))


def binarize(vox: DataFrame, level: float) -> DataFrame:
    """1 strictly above the level, else 0."""
    return vox.withColumn("v", (F.col("v") > level).cast("long"))


def safe_cast(value: Column, kind: str) -> Column:
    """Clamp to the range of an integer type, then cast; null and NaN become null."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32}[kind]
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.when(~F.isnan(value), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))).cast(kind)


def tumbling(vox: DataFrame, width: int, agg: Callable[[str], Column], whole_only: bool = False) -> DataFrame:
    """One value per pixel and block of ``width`` frames; ``whole_only`` drops a shorter last block."""
    if whole_only:
        total = vox.agg(F.max("t")).first()[0]
        vox = vox.where(F.col("t") < ((total or -1) + 1) // width * width)
    return vox.groupBy("pixel", F.call_function("div", "t", F.lit(width)).alias("t")).agg(agg("v").alias("v"))


def sliding(vox: DataFrame, width: int, agg: Callable[[str], Column], step: int = 0, chunk: int = CHUNK) -> DataFrame:
    """A centred window of ``width`` frames with mirrored ends; ``step`` keeps every step-th frame.

    Even widths reach one frame further ahead than back. A pixel's series is cut into chunks that
    carry their neighbours' borders, so that no task orders a whole series.
    """
    frames = vox.agg(F.max("t")).first()[0]
    total = (frames if frames is not None else -1) + 1
    if width <= 0 or step < 0 or (total and width > total):
        raise ValueError("the width must be positive and within the video, the step not negative")
    back, ahead = (width - 1) // 2, width // 2
    mirrored = F.filter(
        F.array(
            F.col("t"),
            F.when(F.col("t") < back, -1 - F.col("t")),
            F.when(F.col("t") >= total - ahead, 2 * total - 1 - F.col("t")),
        ),
        lambda x: x.isNotNull(),
    )
    padded = vox.select("pixel", "v", F.explode(mirrored).alias("t"))
    last = F.greatest(F.call_function("div", F.least(F.col("t") + back, F.lit(total - 1)), F.lit(chunk)), F.lit(0))
    first = F.call_function("div", F.greatest(F.col("t") - ahead, F.lit(0)), F.lit(chunk))
    dealt = padded.withColumn("chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("pixel", "chunk").orderBy("t").rowsBetween(-back, ahead)
    out = dealt.withColumn("v", agg("v").over(w)).where(
        (F.col("t") >= 0) & (F.col("t") < total) & (F.call_function("div", "t", F.lit(chunk)) == F.col("chunk"))
    )
    if step:
        out = out.where(F.col("t") % step == 0).withColumn("t", F.call_function("div", "t", F.lit(step)))
    return out.select("t", "pixel", "v")


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], h: int, w: int) -> DataFrame:
    """Apply a numpy kernel to each frame; frames stay where they are, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[kernel(np.asarray(v, np.float64).reshape(h, w)).ravel() for v in batch["v"]])

    return frames.select("t", "v").mapInPandas(run, "t long, v array<double>")


def median_filter(frames: DataFrame, size: int, h: int, w: int) -> DataFrame:
    """Median of ``size`` by ``size`` pixels with mirrored borders; even sizes take the upper middle."""

    def kernel(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((size // 2, (size - 1) // 2),) * 2, mode="symmetric")
        near = np.lib.stride_tricks.sliding_window_view(padded, (size, size)).reshape(*x.shape, -1)
        return np.partition(near, size * size // 2, axis=-1)[..., size * size // 2]

    return map_frames(frames, kernel, h, w)


def pixel_std(vox: DataFrame) -> DataFrame:
    return vox.groupBy("pixel").agg(F.stddev_pop("v").alias("std"))


def _nearest(i: Column, out: int, source: int) -> Column:
    scale = (source - 1) / (out - 1) if out > 1 else 0.0
    return F.floor(i * scale + 0.5).cast("long")


def resample_nearest(frames: DataFrame, size: tuple[int, int], target: tuple[int, int, int]) -> DataFrame:
    """Nearest-neighbour zoom of a video to ``target`` frames, rows and columns, as voxels.

    Frames are matched by an equi-join on the source frame; pixels by indexing the frame's array.
    """
    h, w = size
    t_out, h_out, w_out = target
    total = (frames.agg(F.max("t")).first()[0] or 0) + 1
    spark = frames.sparkSession
    times = spark.range(t_out).select(F.col("id").alias("t_out"), _nearest(F.col("id"), t_out, total).alias("t"))
    picked = frames.join(times, "t").select(F.col("t_out").alias("t"), "v", F.explode(F.sequence(F.lit(0), F.lit(h_out * w_out - 1))).alias("pixel"))
    row, col = _nearest(F.call_function("div", "pixel", F.lit(w_out)), h_out, h), _nearest(F.col("pixel") % w_out, w_out, w)
    return picked.select("t", F.col("pixel").cast("long").alias("pixel"), F.element_at("v", (row * w + col + 1).cast("int")).alias("v"))


def crop(vox: DataFrame, w: int, top: int, left: int, height: int, width: int) -> DataFrame:
    h0, w0 = F.call_function("div", "pixel", F.lit(w)), F.col("pixel") % w
    inside = h0.between(top, top + height - 1) & w0.between(left, left + width - 1)
    return vox.where(inside).withColumn("pixel", (h0 - top) * width + w0 - left)


def flip(vox: DataFrame, w: int) -> DataFrame:
    """Columns reversed."""
    return vox.withColumn("pixel", F.col("pixel") - F.col("pixel") % w + w - 1 - F.col("pixel") % w)


def rot90(vox: DataFrame, h: int, w: int) -> DataFrame:
    """A quarter turn against the clock: column c of the source becomes row w - 1 - c."""
    return vox.withColumn("pixel", (w - 1 - F.col("pixel") % w) * h + F.call_function("div", "pixel", F.lit(w)))


def scale_shift(vox: DataFrame, factor: float, offset: float, seed: int) -> DataFrame:
    """Augmentation: each frame's values times ``1 + a`` plus ``b``, with a and b drawn by frame and seed."""

    def draw(k: int) -> Column:
        digest = F.md5(F.concat(F.col("t").cast("string"), F.lit(f":{seed}:{k}")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 31) - 1

    return vox.withColumn("v", F.col("v") * (1 + draw(0) * factor) + draw(1) * offset)
