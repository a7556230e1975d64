"""The footprint pipeline: frames to merged, active masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.tables import Tables
from voxelmill.operators import evaluate, features, filters, merge, morph, overlap, segment, traces
from voxelmill.sources.views import voxels


@dataclass(frozen=True)
class Params:
    """Sizes and thresholds; the defaults suit frames of 8 by 8."""

    h: int = 8
    w: int = 8
    level: float = 0.1
    min_area: int = 2
    max_area: float = 40
    distance: float = 1.0
    distance_refined: float = 1.2
    iou: float = 0.7
    consume: float = 0.85
    run: int = 1
    border: float = 0.2
    ratio: float = 2.5
    least: float = 3
    shape: tuple[float, float, float, float] = (0.3, 1.2, 0.5, 2.5)
    element: int = 3
    shared: float = 0.8
    match: float = 0.5


def grouped(frames: DataFrame, p: Params = Params()) -> DataFrame:
    """``group_id, n_masks, area, n_frames`` after the first merge by centroids."""
    tables = Tables(frames.sparkSession)
    masks = tables.keep(segment.slice_connect(frames, p.level, p.h, p.w, p.min_area))
    groups = tables.keep(merge.merge_com(masks.select("mask_id", "pixel"), p.w, p.distance, tables))
    sized = masks.groupBy("mask_id", "t").agg(F.count("*").alias("area")).join(groups, "mask_id")
    return sized.groupBy("group_id").agg(F.count("*").alias("n_masks"), F.sum("area").alias("area"), F.countDistinct("t").alias("n_frames"))


def _active(frames: DataFrame, p: Params, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The final masks and their times."""
    found = tables.keep(segment.slice_connect(frames, p.level, p.h, p.w, p.min_area))
    masks, times = found.select("mask_id", "pixel", F.lit(1.0).alias("val")), found.select("mask_id", "t").distinct()

    groups = tables.keep(merge.merge_com(masks, p.w, p.distance, tables))
    masks, times = tables.keep(merge.merge_masks(masks, groups)), tables.keep(merge.merge_times(times, groups))
    groups = tables.keep(merge.refine_merge(masks, p.w, p.distance_refined, p.border, tables))
    masks, times = tables.keep(merge.merge_masks(masks, groups)), tables.keep(merge.merge_times(times, groups))
    masks, groups = merge.merge_iou(masks, p.iou, p.border, tables)
    masks, times = tables.keep(masks), tables.keep(merge.merge_times(times, groups))
    masks, groups = merge.merge_consume(masks, p.consume, p.border, p.max_area, tables)
    masks, times = tables.keep(masks), tables.keep(merge.merge_times(times, groups.where("group_id is not null")))
    return filters.filter_active(masks, times, p.run, p.border), times


def footprints(frames: DataFrame, p: Params = Params()) -> DataFrame:
    """``mask_id, pixel, n_frames``: the final footprints, and in how many frames each was seen."""
    final, times = _active(frames, p, Tables(frames.sparkSession))
    seen = times.groupBy("mask_id").agg(F.count("*").alias("n_frames"))
    return final.join(seen, "mask_id").select("mask_id", "pixel", "n_frames")


def cleaned(frames: DataFrame, p: Params, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``mask_id, pixel, val`` of well-shaped footprints, and the times of the masks they come from.

    Long, small and ragged masks go, holes are filled, the rest is closed, opened and cut into parts with ids of
    their own, and pixels that parts share go to the one whose trace they follow.
    """
    masks, times = _active(frames, p, tables)
    masks = filters.filter_small(filters.filter_ratio(masks, p.ratio, p.w), p.least)
    parts = morph.open_close(filters.filter_ellipse(masks, p.shape, p.h, p.w), p.element, p.element, p.h, p.w)
    parts = tables.keep(parts.select((F.col("mask_id") * (p.h * p.w) + F.col("part")).alias("mask_id"), "pixel", "val"))
    owned = overlap.assign_by_correlation(parts, voxels(frames), p.shared).withColumn("val", F.lit(1.0))
    return tables.keep(owned), times


def report(frames: DataFrame, truth: DataFrame, p: Params = Params()) -> DataFrame:
    """``part_id, mask_id, neuron, area, n_frames, peak, snr, iou, precision, recall, f1``: the whole way from frames to scores.

    A row for each cleaned footprint, with the frames in which its mask was seen, the peak of its trace less
    the background around it (of the plain trace where no ring is left), that peak over the trace's deviation, and
    the true mask assigned to it, if any; and one for each true mask (``mask_id, pixel, val``) that none is
    assigned to. The scores are those of the whole video. Without footprints, or truth, the other side's rows remain.
    """
    tables = Tables(frames.sparkSession)
    masks, times = cleaned(frames, p, tables)
    truth = tables.keep(truth)
    matches = tables.keep(evaluate.match_jaccard(masks, truth, p.match, tables))
    score = evaluate.scores(matches, masks, truth).first()
    clean = traces.background_removed(masks, voxels(frames), p.h, p.w).withColumn("s", F.coalesce("bg_rm", "cell"))
    strength = clean.groupBy("mask_id").agg(F.max("s").alias("peak"), F.stddev_pop("s").alias("dev"))
    seen = times.groupBy("mask_id").agg(F.count("*").alias("n_frames")).withColumnRenamed("mask_id", "of")
    own = features.area(masks).join(strength, "mask_id").withColumn("of", F.call_function("div", "mask_id", F.lit(p.h * p.w))).join(seen, "of")
    matched = matches.select(F.col("i").alias("mask_id"), F.col("j").alias("neuron"), (1 - F.col("distance")).alias("iou"))
    rows = own.join(matched, "mask_id", "left").join(truth.select(F.col("mask_id").alias("neuron")).distinct(), "neuron", "full")
    snr = F.when(F.col("dev") > 0, F.col("peak") / F.col("dev"))
    scores = [F.lit(score[c]).alias(c) for c in ("precision", "recall", "f1")]
    return rows.select(F.col("mask_id").alias("part_id"), F.col("of").alias("mask_id"), "neuron", "area", "n_frames", "peak", snr.alias("snr"), "iou", *scores)
