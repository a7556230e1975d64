"""Intensity traces of masks, and the background in rings around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import features

#: Share of the background that is subtracted.
BACKGROUND = 0.7


def extract(masks: DataFrame, vox: DataFrame) -> DataFrame:
    """``mask_id, t, trace``: sum of value times intensity, over the area."""
    own = features.area(masks)
    summed = masks.join(vox, "pixel").groupBy("mask_id", "t").agg(F.sum(F.col("val") * F.col("v")).alias("s"))
    return summed.join(own, "mask_id").select("mask_id", "t", (F.col("s") / F.col("area")).alias("trace"))


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over the shared frames of the pairs of two blocks of traces, by products of matrices."""
    ids, t = np.unique(pdf["mask_id"]), np.unique(pdf["t"])
    x, seen = np.zeros((2, len(ids), len(t)))
    place = np.searchsorted(ids, pdf["mask_id"]), np.searchsorted(t, pdf["t"])
    x[place], seen[place] = pdf["x"], 1
    block = np.zeros(len(ids), np.int64)
    block[place[0]] = pdf["block"]
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    i, j = np.nonzero(np.triu(np.ones((len(ids), len(ids)), bool), 1) & ((low == high) | (block[:, None] != block)))
    parts = {"n": (seen, seen), "sx": (x, seen), "sy": (seen, x), "sxx": (x * x, seen), "syy": (seen, x * x), "sxy": (x, x)}
    return pd.DataFrame({"i": ids[i], "j": ids[j]} | {k: (a @ b.T)[i, j] for k, (a, b) in parts.items()})


def correlation(traces: DataFrame, block: int = 64, chunk: int = 4096) -> DataFrame:
    """``i, j, corr``: Pearson correlation of all pairs of traces over their shared frames, i below j.

    Traces are centred and dealt to blocks; a task multiplies two blocks over a chunk of frames, and
    its sums per pair are added up. So a value is sent once per block, not once per pair.
    """
    means = traces.groupBy("mask_id").agg(F.avg("trace").alias("mean"))
    blocks = max(1, -(-means.count() // block))
    own = F.pmod(F.xxhash64("mask_id"), F.lit(blocks))
    rows = traces.join(means, "mask_id").select("mask_id", "t", (F.col("trace") - F.col("mean")).alias("x"), own.alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "part": F.floor(F.col("t") / chunk)})
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    sums = rows.groupBy("low", "high", "part").applyInPandas(_sums, "i long, j long, " + ", ".join(f"{c} double" for c in names))
    sums = sums.where("n > 0").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return sums.select("i", "j", F.when(bottom > 0, top / bottom).alias("corr"))


def axes(masks: DataFrame, w: int) -> DataFrame:
    """``mask_id, axes``: sum of major and minor axis of the ellipse with the mask's second moments.

    A pixel is a unit square (a twelfth on either moment); an axis is four standard deviations.
    """
    y, x = features.row(w).cast("double"), features.col(w).cast("double")
    m = masks.groupBy("mask_id").agg(
        (F.var_pop(y) + 1 / 12).alias("a"), (F.var_pop(x) + 1 / 12).alias("b"), F.covar_pop(y, x).alias("c")
    )
    half = F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.pow("c", F.lit(2)))
    middle = (F.col("a") + F.col("b")) / 2
    return m.select("mask_id", (4 * F.sqrt(middle + half) + 4 * F.sqrt(F.greatest(middle - half, F.lit(0.0)))).alias("axes"))


def _grown(masks: DataFrame, radius: Column, h: int, w: int) -> DataFrame:
    """``mask_id, pixel``: masks dilated by disks of their own ``radius``, in one pass over the pixels."""
    y, x = features.row(w), features.col(w)
    rows = masks.select("mask_id", y.alias("y"), x.alias("x"), F.least(radius, F.lit(float(h + w))).alias("r"))
    rows = rows.withColumn("dy", F.explode(F.sequence(-F.floor("r"), F.floor("r"))))
    reach = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("dy") * F.col("dy")))
    rows = rows.withColumn("dx", F.explode(F.sequence(-reach, reach)))
    rows = rows.select("mask_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    inside = rows.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))
    return inside.select("mask_id", (F.col("y") * w + F.col("x")).alias("pixel")).distinct()


def background_rings(masks: DataFrame, h: int, w: int) -> DataFrame:
    """``mask_id, pixel``: a wide ring around each mask, without the narrow zones around any mask."""
    sized = masks.select("mask_id", "pixel").join(axes(masks, w), "mask_id")
    near = F.greatest(F.floor(F.round(F.col("axes") / 8, 9)).cast("double"), F.lit(1.0))
    far = F.greatest(F.floor(F.round(F.col("axes") / 6, 9)).cast("double"), F.lit(2.5))
    zones = _grown(sized, near, h, w).select("pixel").distinct()
    return _grown(sized, far, h, w).join(zones, "pixel", "left_anti").select("mask_id", "pixel")


def background_removed(masks: DataFrame, vox: DataFrame, h: int, w: int) -> DataFrame:
    """``mask_id, t, cell, bg, bg_rm``; background and difference are null for masks without a ring."""
    rings = background_rings(masks, h, w).withColumn("val", F.lit(1.0))
    bg = extract(rings, vox).withColumnRenamed("trace", "bg")
    cell = extract(masks, vox).withColumnRenamed("trace", "cell")
    return cell.join(bg, ["mask_id", "t"], "left").withColumn("bg_rm", F.col("cell") - BACKGROUND * F.col("bg"))
