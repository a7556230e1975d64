"""Training samples of videos: intensities scaled by percentiles, crops around foreground, seeded changes.

Frames are rows ``video, t, v, label``: t from 0 without gaps, and two arrays of one image's values.
All draws are digests of seed, video and sample, so any run gives the same samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.tables import Tables
from voxelmill.operators.evaluate import running_sum
from voxelmill.operators.tile import Shape

#: Rows of sample tables that are told to every executor; longer ones are joined by a shuffle.
FEW = 200_000


def _told(rows: DataFrame, tables: Tables) -> DataFrame:
    kept = tables.keep(rows)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def percentiles(frames: DataFrame, at: list[float], tables: Tables) -> DataFrame:
    """``video, p0, p1, ...``: exact percentiles of each video's values, between two values in proportion.

    Extremes are plain minima and maxima. Others count distinct values and add up the counts along one
    sort over all videos, so that no task holds a video. Nulls and NaN don't count.
    """
    if set(at) <= {0, 100}:
        return frames.groupBy("video").agg(*[(F.max(F.array_max("v")) if p else F.min(F.array_min("v"))).alias(f"p{k}") for k, p in enumerate(at)])
    values = frames.select("video", F.explode("v").alias("x")).where(~F.isnan("x")).groupBy("video", "x").agg(F.count("*").alias("n"))
    counts = running_sum(values, "video", ["x"], "n", tables)
    total = counts.groupBy("video").agg(F.sum("n").alias("total"))
    both = counts.join(total, "video")
    picks = []
    for k, p in enumerate(at):
        place = (F.col("total") - 1) * (p / 100)
        for name, rank in ((f"low{k}", F.floor(place)), (f"high{k}", F.ceil(place))):
            picks.append(F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("x"))).alias(name))
        picks.append(F.first(place - F.floor(place)).alias(f"part{k}"))
    found = both.groupBy("video").agg(*picks)
    return found.select("video", *[(F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * F.col(f"part{k}")).alias(f"p{k}") for k in range(len(at))])


def scale_percentiles(
    frames: DataFrame, tables: Tables, lower: float = 0, upper: float = 100, low: float = 0.0, high: float = 1.0, clip: bool = True
) -> DataFrame:
    """Values so that two percentiles of their video become ``low`` and ``high``; of a constant video, all become ``low``."""
    levels = _told(percentiles(frames, [lower, upper], tables), tables)
    span = F.col("p1") - F.col("p0")

    def scaled(x: Column) -> Column:
        y = F.when(span == 0, x - F.col("p0") + low).otherwise((x - F.col("p0")) / span * (high - low) + low)
        return F.least(F.greatest(y, F.lit(low)), F.lit(high)) if clip else y

    return frames.join(levels, "video").withColumn("v", F.transform("v", scaled)).drop("p0", "p1")


def draw(seed: int, k: int) -> Column:
    """A number from 0 to 1 (exclusive) by video, sample, seed and purpose."""
    digest = F.md5(F.concat_ws(":", F.col("video").cast("string"), F.col("sample").cast("string"), F.lit(f"{seed}"), F.lit(f"{k}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def centres(frames: DataFrame, samples: int, seed: int, tables: Tables, pos: float = 1, neg: float = 1, level: float = 0.0) -> DataFrame:
    """``video, sample, total, t, pixel``: the voxel that each sample is drawn at.

    A share pos / (pos + neg) of samples is drawn from the labelled voxels, the rest from others above
    the level; where either is absent, from the other. Drawn is the k-th voxel in order: counts per
    frame are added up along one sort, and only the frames drawn are looked into. A video without
    voxels of either kind has no samples.
    """
    voxels = F.arrays_zip("v", "label")
    own = {
        "fg": F.aggregate("label", F.lit(0).cast("long"), lambda n, x: n + (F.coalesce(x, F.lit(0)) > 0).cast("long")),
        "bg": F.aggregate(voxels, F.lit(0).cast("long"), lambda n, x: n + F.coalesce((F.coalesce(x["label"], F.lit(0)) <= 0) & (x["v"] > level), F.lit(False)).cast("long")),
    }
    counts = tables.keep(frames.select("video", F.col("t").cast("long").alias("t"), *[c.alias(k) for k, c in own.items()]))
    totals = counts.groupBy("video").agg(F.sum("fg").alias("n_fg"), F.sum("bg").alias("n_bg"), (F.max("t") + 1).alias("total"))
    drawn = totals.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    wanted = (draw(seed, 0) < pos / (pos + neg)).alias("fg")
    drawn = drawn.withColumn("of_fg", F.when(F.col("n_fg") == 0, False).when(F.col("n_bg") == 0, True).otherwise(wanted))
    pool = F.when(F.col("of_fg"), F.col("n_fg")).otherwise(F.col("n_bg"))
    drawn = drawn.where(pool > 0).select("video", "sample", "total", "of_fg", F.floor(draw(seed, 1) * pool).alias("rank"))
    drawn = _told(drawn, tables)
    picks = []
    for kind in ("fg", "bg"):
        before = running_sum(counts.where(F.col(kind) > 0).select("video", "t", F.col(kind).alias("n")), "video", ["t"], "n", tables)
        mine = drawn.where(F.col("of_fg") == (kind == "fg"))
        hit = before.join(mine, "video").where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        picks.append(hit.select("video", "sample", "total", "t", "of_fg", (F.col("rank") - F.col("before")).alias("k")))
    picks = _told(picks[0].unionByName(picks[1]), tables)
    marked = F.coalesce(F.col("x.label"), F.lit(0)) > 0
    rows = frames.join(picks, ["video", "t"]).select("video", "sample", "total", "t", "k", "of_fg", F.posexplode(voxels).alias("pixel", "x"))
    rows = rows.where(F.when(F.col("of_fg"), marked).otherwise(~marked & (F.col("x.v") > level)))
    # one frame's voxels at most are gathered for a sample
    order = rows.groupBy("video", "sample", "total", "t", "k").agg(F.sort_array(F.collect_list(F.col("pixel").cast("long"))).alias("all"))
    return order.select("video", "sample", "total", "t", F.element_at("all", (F.col("k") + 1).cast("int")).alias("pixel"))


def crops(frames: DataFrame, size: tuple[int, int], roi: Shape, samples: int, seed: int, tables: Tables, **kinds: float) -> DataFrame:
    """``video, sample, t0, h0, w0``: windows around drawn voxels, moved inside the video. A video shorter than a window gives all its frames."""
    h, w = size
    if roi[1] > h or roi[2] > w:
        raise ValueError("the window is larger than the frames")
    at = centres(frames, samples, seed, tables, **kinds)

    def start(x: Column, n: Column | int, r: int) -> Column:
        return F.greatest(F.least(x - r // 2, F.lit(n) - r), F.lit(0)).cast("long")

    row, col = F.call_function("div", "pixel", F.lit(w)), F.col("pixel") % w
    t0 = F.greatest(F.least(F.col("t") - roi[0] // 2, F.col("total") - roi[0]), F.lit(0)).cast("long")
    return at.select("video", "sample", t0.alias("t0"), start(row, h, roi[1]).alias("h0"), start(col, w, roi[2]).alias("w0"))


def sample_crops(
    frames: DataFrame, size: tuple[int, int], roi: Shape, seed: int, tables: Tables, samples: int = 2, flips: float = 0.5, turns: float = 0.5,
    intensity: float = 0.5, factor: float = 0.1, offset: float = 0.1, **kinds: float,
) -> DataFrame:
    """``video, sample, t, v, label``: crops with the chain of changes applied, each with its probability.

    In order: rows reversed, columns reversed, one to three quarter turns against the clock (of square
    windows only), values times 1 + a, values plus b. Labels follow the geometric changes.
    """
    h, w = roi[1:]
    if turns and h != w:
        raise ValueError("only square windows are turned")
    chosen = crops(frames, size, roi, samples, seed, tables, **kinds)
    chosen = chosen.select(
        "*", (draw(seed, 2) < flips).alias("flip_h"), (draw(seed, 3) < flips).alias("flip_w"),
        F.when(draw(seed, 4) < turns, F.floor(draw(seed, 5) * 3) + 1).otherwise(F.lit(0)).alias("turn"),
        F.when(draw(seed, 6) < intensity, 1 + (2 * draw(seed, 7) - 1) * factor).otherwise(F.lit(1.0)).alias("scale"),
        F.when(draw(seed, 8) < intensity, (2 * draw(seed, 9) - 1) * offset).otherwise(F.lit(0.0)).alias("shift"),
    )
    chosen = _told(chosen.withColumn("t", F.explode(F.sequence(F.col("t0"), F.col("t0") + roi[0] - 1))), tables)
    rows = frames.join(chosen, ["video", "t"])

    def source(p: Column) -> Column:
        """Place in the frame of a place in the changed crop."""
        y, x = F.floor(p / w), p % w
        turned_y = F.when(F.col("turn") == 1, x).when(F.col("turn") == 2, h - 1 - y).when(F.col("turn") == 3, h - 1 - x).otherwise(y)
        turned_x = F.when(F.col("turn") == 1, w - 1 - y).when(F.col("turn") == 2, w - 1 - x).when(F.col("turn") == 3, y).otherwise(x)
        row = F.col("h0") + F.when(F.col("flip_h"), h - 1 - turned_y).otherwise(turned_y)
        col = F.col("w0") + F.when(F.col("flip_w"), w - 1 - turned_x).otherwise(turned_x)
        return (row * size[1] + col + 1).cast("int")

    places = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), source)
    rows = rows.withColumn("places", places)
    v = F.transform("places", lambda p: F.element_at("v", p) * F.col("scale") + F.col("shift"))
    label = F.transform("places", lambda p: F.element_at("label", p))
    return rows.select("video", "sample", (F.col("t") - F.col("t0")).alias("t"), v.alias("v"), label.alias("label"))
