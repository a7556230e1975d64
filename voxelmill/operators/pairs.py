"""Metrics of mask pairs as equi-joins on pixels and range joins on centroids; absent pairs have no overlap."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from voxelmill.functions import meetings
from voxelmill.operators.features import area


#: Masks at one pixel beyond which their pairs are cut into blocks, and pixels of that kind that are broadcast at most.
CROWD, FEW_PIXELS = 1_000, 100_000
#: Rows drawn to cut masks to groups, rows that a task makes lists of, pairs of rows for a group, and masks whose areas are broadcast at most.
SAMPLE, LISTED, MEETS, FEW_MASKS = 100_000, 500_000, 2_000_000, 1_000_000
#: What grid cells are wider than the distance, so that rounded distances reach no further than the next cell.
WIDER = 1 + 1e-6


def _meet(left: DataFrame, right: DataFrame | None, crowd: int = CROWD) -> DataFrame:
    """``pixel, i, x, j, y``: values of pairs at shared pixels; pairs of one table once, with i below j.

    Masks are counted by pixel first. Where more than ``crowd`` meet, both sides are dealt to parts of
    about that many, and each part of one side meets each of the other in a key of its own, so a
    pixel of all masks is shared by many tasks.
    """
    a = left.select("pixel", F.col("mask_id").alias("i"), F.col("val").alias("x"))
    b = (left if right is None else right).select("pixel", F.col("mask_id").alias("j"), F.col("val").alias("y"))
    sides = [a.select("pixel", F.lit(1).alias("na"), F.lit(int(right is None)).alias("nb"))]
    if right is not None:
        sides.append(b.select("pixel", F.lit(0).alias("na"), F.lit(1).alias("nb")))
    counts = functools.reduce(DataFrame.unionByName, sides).groupBy("pixel").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    crowded = counts.where((F.greatest("na", "nb") > crowd) & (F.least("na", "nb") > 0))
    crowded = crowded.select("pixel", *[F.ceil(F.col(n) / crowd).alias(p) for n, p in (("na", "pa"), ("nb", "pb"))])
    some = crowded.limit(FEW_PIXELS + 1).collect()
    if some:
        if len(some) <= FEW_PIXELS:
            crowded = F.broadcast(left.sparkSession.createDataFrame(some, crowded.schema))
        a, b = (side.join(crowded, "pixel", "left").fillna(1, ["pa", "pb"]) for side in (a, b))
        whole = {s: F.explode(F.sequence(F.lit(0).cast("long"), F.col(p) - 1)) for s, p in (("a", "pb"), ("b", "pa"))}
        a = a.select("pixel", "i", "x", F.pmod(F.xxhash64("i"), "pa").alias("p"), whole["a"].alias("q"))
        b = b.select("pixel", "j", "y", F.pmod(F.xxhash64("j"), "pb").alias("q"), whole["b"].alias("p"))
    joined = a.join(b, ["pixel", "p", "q"] if some else "pixel").select("pixel", "i", "x", "j", "y")
    return joined.where("i < j") if right is None else joined


def _sizes(masks: DataFrame, crowd: int) -> Row:
    """``masks, rows, crowded, meets``: how many masks, rows and crowded pixels there are, and how many pairs of rows share a pixel."""
    n, at = F.col("count"), F.col("by") == 0
    counts = masks.groupingSets([["pixel"], ["mask_id"]], "pixel", "mask_id").agg(F.count("*").alias("count"), F.grouping("pixel").alias("by"))
    return counts.agg(
        F.count_if(~at).alias("masks"), F.coalesce(F.sum(F.when(at, n)), F.lit(0)).alias("rows"), F.count_if(at & (n > crowd)).alias("crowded"),
        F.coalesce(F.sum(F.when(at, n * (n - 1) / 2)), F.lit(0.0)).alias("meets"),
    ).first()


def _few(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def _groups(masks: DataFrame, sizes: Row, sample: int, meets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that cut masks to groups of about ``meets`` pairs of rows, by about ``sample`` rows drawn by digest, and tasks for each group.

    The rows drawn only say how work is dealt, as in a range partitioning; every row is dealt.
    """
    if sizes["meets"] <= meets:
        return np.zeros(0, np.int64), np.ones(1, np.int64)
    drawn = masks.where(F.pmod(F.xxhash64("mask_id", "pixel"), F.lit(max(1, int(sizes["rows"] // sample)))) == 0).select("mask_id", "pixel")
    met = masks.join(F.broadcast(drawn.select("pixel").distinct()), "pixel", "left_semi").groupBy("pixel").agg(F.count("*").alias("n"))
    rows = met.join(F.broadcast(drawn), "pixel").select("mask_id", F.col("n") - 1).toArrow()
    ids, weights = (c.to_numpy() for c in rows.columns)
    return meetings.borders(ids, weights * (sizes["meets"] / max(1, weights.sum())), meets)


def _own_overlap(masks: DataFrame, sizes: Row, crowd: int, sample: int, meets: int, both: bool = False) -> DataFrame:
    """``i, j, overlap`` of one table, each pair once or, if ``both``, both ways. Masks are cut by id to groups, a task each. It gets the list of
    masks at each of its group's pixels, from the first of the group on, and adds up their pairs, so what is shuffled are lists
    and not pairs; where masks at a pixel have ids near each other, few tasks get its list. Rows come in order of pairs,
    one way after the other, as such columns are stored in little space.

    Lists of crowded pixels are dealt to parts that meet each other, and the pairs of a group that has far more than ``meets``
    pairs of rows (one mask of many pixels) to several tasks by their other mask.
    """
    masks = masks.where("mask_id is not null and pixel is not null")
    rows, key = masks.select("pixel", F.col("mask_id").alias("j"), F.col("val").cast("double").alias("y")), ["pixel"]
    if sizes["crowded"]:
        parts = masks.groupBy("pixel").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("pixel", F.ceil(F.col("n") / crowd).alias("parts"))
        rows = rows.join(_few(parts, sizes["crowded"], FEW_PIXELS), "pixel", "left").withColumn("part", F.pmod(F.xxhash64("j"), F.coalesce("parts", F.lit(1))))
        key = ["pixel", "part"]
    cuts, shares = _groups(masks, sizes, sample, meets)
    lists = rows.select(*key, "j", "y").repartition(max(1, -(-sizes["rows"] // LISTED)), *key)
    sent = lists.mapInArrow(meetings.own_lists(cuts, shares), meetings.SENT)
    if sizes["crowded"]:
        some = rows.where("parts is not null").groupBy("pixel", "part").agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("e"), F.first("parts").alias("parts"))
        each = some.select("pixel", F.col("part").alias("from"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("e").alias("own"))
        crossed = each.where(F.col("from") != F.col("part")).join(some, ["pixel", "part"])
        crossed = crossed.select(F.col("own.j").alias("i"), F.col("own.y").alias("x"), F.col("e.j").alias("j"), F.col("e.y").alias("y"))
        sent = sent.unionByName(crossed.mapInArrow(meetings.crossed_lists(cuts, shares), meetings.SENT))
    return sent.repartitionById(int(shares.sum()), "task").mapInArrow(meetings.added_up(both), "i long, j long, overlap double")


def overlap(left: DataFrame, right: DataFrame | None = None, crowd: int = CROWD, sample: int = SAMPLE, meets: int = MEETS) -> DataFrame:
    """``i, j, overlap``: sums of products over shared pixels; pairs of one table once, with i below j."""
    if right is None:
        return _own_overlap(left, _sizes(left, crowd), crowd, sample, meets)
    return _meet(left, right, crowd).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("overlap"))


def _with_areas(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    ai = left.select(F.col("mask_id").alias("i"), F.col("area").alias("area_i"))
    aj = right.select(F.col("mask_id").alias("j"), F.col("area").alias("area_j"))
    return pairs.join(ai, "i").join(aj, "j")


def _own_with_areas(masks: DataFrame, both: bool = False) -> DataFrame:
    """``i, j, overlap, area_i, area_j`` of one table; areas of up to ``FEW_MASKS`` masks go to the pairs."""
    sizes = _sizes(masks, CROWD)
    own = _few(area(masks), sizes["masks"], FEW_MASKS)
    return _with_areas(_own_overlap(masks, sizes, CROWD, SAMPLE, MEETS, both), own, own)


def iou(masks: DataFrame) -> DataFrame:
    """``i, j, iou`` for i below j."""
    ratio = F.col("overlap") / (F.col("area_i") + F.col("area_j") - F.col("overlap"))
    return _own_with_areas(masks).select("i", "j", ratio.alias("iou"))


def containment(masks: DataFrame) -> DataFrame:
    """``i, j, ratio``: the share of i's area that lies in j, both ways."""
    return _own_with_areas(masks, both=True).select("i", "j", (F.col("overlap") / F.col("area_i")).alias("ratio"))


def overlap_ratio(masks: DataFrame) -> DataFrame:
    """``i, j, ratio``: overlap over the area of j, both ways."""
    return _own_with_areas(masks, both=True).select("i", "j", (F.col("overlap") / F.col("area_j")).alias("ratio"))


def jaccard_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, distance``: one minus intersection over union, with sums of values as areas."""
    a, b = (m.groupBy("mask_id").agg(F.sum("val").alias("area")) for m in (left, right))
    ratio = 1 - F.col("overlap") / (F.col("area_i") + F.col("area_j") - F.col("overlap"))
    return _with_areas(overlap(left, right), a, b).select("i", "j", ratio.alias("distance"))


def coordinate_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, distance`` of masks with counts: of the pixels that either has, the share whose values differ.

    Pairs without a common pixel are at distance 1 and have no row. For masks of 0 and 1 this is ``jaccard_distance``.
    """
    a, b = (m.where("val != 0").groupBy("mask_id").agg(F.count("*").alias("area")) for m in (left, right))
    met = _meet(left.where("val != 0"), right.where("val != 0")).groupBy("i", "j")
    met = met.agg(F.count("*").alias("both"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("equal"))
    either = F.col("area_i") + F.col("area_j") - F.col("both")
    return _with_areas(met, a, b).select("i", "j", ((either - F.col("equal")) / either).alias("distance"))


def cells(side: float) -> tuple[Column, Column]:
    """Row and column of the grid cell that a centroid lies in."""
    y, x = (F.floor(F.col(c) / max(side, 1e-9)).cast("long") for c in ("com_h", "com_w"))
    return y, x


def squared_limit(distance: float) -> float:
    """The square in single precision, as distances of single-precision centroids are compared with it."""
    return float(np.float32(distance) * np.float32(distance))


def near(left: DataFrame, right: DataFrame, distance: float, limit: float | None = None) -> DataFrame:
    """``i, j, squared``: centroids (mask_id, com_h, com_w) within a distance, compared squared, in the precision of their columns.

    A range join as an equi-join: the left goes to its grid cell, the right to the nine cells around.
    ``limit`` stands for the square of the distance.
    """
    y, x = cells(distance * WIDER)
    a = left.select(F.col("mask_id").alias("i"), F.col("com_h").alias("h1"), F.col("com_w").alias("w1"), y.alias("y"), x.alias("x"))
    b = right.select(F.col("mask_id").alias("j"), F.col("com_h").alias("h2"), F.col("com_w").alias("w2"), y.alias("y"), x.alias("x"))
    for c in ("y", "x"):
        b = b.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    dh, dw = F.col("h1") - F.col("h2"), F.col("w1") - F.col("w2")
    squared = dh * dh + dw * dw
    return a.join(b, ["y", "x"]).select("i", "j", squared.alias("squared")).where(F.col("squared") <= (distance * distance if limit is None else limit))


def near_pairs(centroids: DataFrame, distance: float) -> DataFrame:
    """Pairs of one table, i below j."""
    return near(centroids, centroids, distance).where("i < j")


def distance_to(left: DataFrame, right: DataFrame, pixel_size: float, block: int = 10_000, share: int = 100_000) -> DataFrame:
    """``i, j, distance``: all centroid distances, as the result has a row for each pair.

    The right side is dealt to blocks of about ``block`` rows, each one array, and the left to shares of
    about ``share`` rows. Each share meets each block in a key of its own, so neither side is gathered
    whole, and tasks grow in number with both. A single block is broadcast.
    """
    blocks = max(1, -(-right.count() // block))
    shares = max(1, -(-left.count() // share)) if blocks > 1 else 1
    numbers = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (blocks, shares)}
    entry = F.struct(F.col("mask_id").alias("j"), F.col("com_h").alias("h"), F.col("com_w").alias("w"))
    arrays = right.groupBy(F.pmod(F.xxhash64("mask_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(entry).alias("r"))
    each = left.select(F.col("mask_id").alias("i"), "com_h", "com_w", F.pmod(F.xxhash64("mask_id"), F.lit(shares)).alias("share"), numbers[blocks].alias("block"))
    if blocks == 1:
        each = each.join(F.broadcast(arrays), "block")
    else:
        each = each.join(arrays.select("block", "r", numbers[shares].alias("share")), ["block", "share"])
    each = each.select("i", "com_h", "com_w", F.explode("r").alias("r"))
    dh, dw = F.col("com_h") - F.col("r.h"), F.col("com_w") - F.col("r.w")
    return each.select("i", F.col("r.j").alias("j"), (F.sqrt(dh * dh + dw * dw) * pixel_size).alias("distance"))


def intersections(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """``i, j, pixel, val``: products of all overlapping pairs; pairs of one table once, with i below j."""
    return _meet(left, right).select("i", "j", "pixel", (F.col("x") * F.col("y")).alias("val"))


def intersection(masks: DataFrame, i: int, j: int) -> DataFrame:
    """Pixels of two masks."""
    a, b = (masks.where(F.col("mask_id") == k).select("pixel", F.col("val").alias(f"v{n}")) for n, k in enumerate((i, j)))
    return a.join(b, "pixel").select("pixel", (F.col("v0") * F.col("v1")).alias("val"))


def dice(left: DataFrame, right: DataFrame) -> DataFrame:
    """``mask_id, dice`` of masks with equal ids: twice the overlap over both sums; 0 where the right is empty."""
    a = left.groupBy("mask_id").agg(F.sum("val").alias("sx"))
    b = right.groupBy("mask_id").agg(F.sum("val").alias("sy"))
    both = left.join(right.withColumnRenamed("val", "y"), ["mask_id", "pixel"]).groupBy("mask_id").agg(F.sum(F.col("val") * F.col("y")).alias("xy"))
    value = F.when(F.coalesce("sy", F.lit(0.0)) == 0, 0.0).otherwise(2 * F.coalesce("xy", F.lit(0.0)) / (F.col("sx") + F.col("sy")))
    return a.join(b, "mask_id", "left").join(both, "mask_id", "left").select("mask_id", value.alias("dice"))
