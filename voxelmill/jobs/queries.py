"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.tables import Tables
from voxelmill.jobs import footprints as flagship
from voxelmill.operators import augment, evaluate, features, filters, merge, morph, overlap, pairs, pre, segment, tile, traces, view
from voxelmill.sources import mat, sinks, tiff, views, volumes
from voxelmill.sources.views import LEVEL, H, W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Width of the image that ``lineitem`` masks are laid out on, and thresholds within their range of overlaps.
PART_W = 50
IOU_AT, RATIO_AT, BORDER = 0.17, 0.32, 0.5
ROI, OVERLAP = (16, 4, 4), (0.5, 0.25, 0.25)

# -- common parts of the SQL -------------------------------------------------------------------

VOX = """vox as (select vec_id as t, i - 1 as pixel, cast(embedding[i] as double) as v
  from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"""
N = "n as (select max(vec_id) + 1 as n from embeddings)"
FG = f"{VOX}, fg as (select t, pixel from vox where v > {LEVEL})"
LABELS = f"""{FG},
nb as (select a.t, a.pixel as p, b.pixel as q from fg a join fg b on a.t = b.t and (
  (b.pixel = a.pixel + 1 and a.pixel % 8 < 7) or (b.pixel = a.pixel - 1 and a.pixel % 8 > 0) or b.pixel = a.pixel + 8 or b.pixel = a.pixel - 8)),
reach(t, p, r) as (select t, pixel, pixel from fg union select nb.t, nb.q, reach.r from reach join nb on nb.t = reach.t and nb.p = reach.p),
lab as (select t, p as pixel, min(r) as label from reach group by t, p)"""
CM = f"""{LABELS},
cm as (select t * 64 + label as mask_id, t, pixel from lab
  where (t, label) in (select (t, label) from lab group by t, label having count(*) > 2))"""
SM = """sm as (select cast(l_suppkey as bigint) as mask_id, cast(l_partkey as bigint) as pixel, cast(count(*) as double) as val
  from lineitem group by 1, 2)"""
GT = f"""{VOX}, gt as (select cast(label as bigint) as neuron, pixel from vox join embeddings on t = vec_id
  group by 1, 2 having round(avg(v), 9) > 0.02)"""
OV = f"""{SM}, ar as (select mask_id, sum(val * val) as area from sm group by 1),
ov as (select a.mask_id as i, b.mask_id as j, sum(a.val * b.val) as overlap from sm a join sm b on a.pixel = b.pixel and a.mask_id < b.mask_id group by 1, 2)"""
RATIOS = f"""{OV}, rt as (
  select i, j, overlap / a.area as own, overlap / b.area as other from
    (select i, j, overlap from ov union all select j, i, overlap from ov) p
  join ar a on a.mask_id = i join ar b on b.mask_id = j)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            rounded = dict.fromkeys(re.findall(r', 6\) as "?(\w+)', sql))
            positive = ", ".join(f'"{c}" + 0.0 as "{c}"' for c in rounded)  # no negative zero
            SQL[f.__name__] = f"select * replace ({positive}) from ({sql})" if rounded else sql
        return f

    return add


def _vox(spark, d):
    return views.voxels(views.frames(spark, d))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _cells(spark, d) -> DataFrame:
    return segment.slice_connect(views.frames(spark, d), LEVEL, H, W, 2)


def _cell_masks(spark, d) -> DataFrame:
    return _cells(spark, d).select("mask_id", "pixel", F.lit(1.0).alias("val"))


def _truth_masks(spark, d) -> DataFrame:
    return views.truth(spark, d).select(F.col("neuron").alias("mask_id"), "pixel", F.lit(1.0).alias("val"))


# -- pre-processing ----------------------------------------------------------------------------


@query(f"with {VOX} select t, pixel, round((v - lo) / (hi - lo), 6) as v from vox, (select min(v) as lo, max(v) as hi from vox)")
def normalize_minmax(spark, d):
    return _rounded(pre.normalize_minmax(_vox(spark, d)), "v")


@query(f"with {VOX} select t, pixel, least(v, 0.1) as v from vox")
def thresh_max(spark, d):
    return pre.clamp_max(_vox(spark, d), 0.1)


@query(f"with {VOX} select t, pixel, greatest(v, 0.0) as v from vox")
def thresh_min(spark, d):
    return pre.clamp_min(_vox(spark, d), 0.0)


@query(f"with {VOX} select t, pixel, cast(v > 0.1 as bigint) as v from vox")
def thresh_binary(spark, d):
    return pre.binarize(_vox(spark, d), 0.1)


@query(f"with {VOX} select t, pixel, cast(trunc(least(greatest(v * 1000, -128), 127)) as bigint) as v from vox")
def safe_cast(spark, d):
    return _vox(spark, d).select("t", "pixel", pre.safe_cast(F.col("v") * 1000, "tinyint").cast("long").alias("v"))


@query(f"""with {VOX}, o as (select unnest([-1, 0, 1]) as o)
select vox.t, vox.pixel, median(b.v) as v from vox, o y, o x, vox b
where b.t = vox.t and b.pixel = least(greatest(vox.pixel // 8 + y.o, 0), 7) * 8 + least(greatest(vox.pixel % 8 + x.o, 0), 7)
group by 1, 2""")
def median_filter(spark, d):
    return views.voxels(pre.median_filter(views.frames(spark, d), 3, H, W))


def _sliding_sql(agg: str, back: int, ahead: int) -> str:
    return f"""{VOX}, {N}, padded as (select t, pixel, v from vox
  union all select -1 - t, pixel, v from vox where t < {back}
  union all select 2 * n - 1 - t, pixel, v from vox, n where t >= n - {ahead}),
slid as (select t, pixel, {agg}(v) over (partition by pixel order by t rows between {back} preceding and {ahead} following) as v from padded)"""


@query(f"with {_sliding_sql('avg', 2, 2)} select t, pixel, round(v, 6) as v from slid, n where t >= 0 and t < n")
def sliding_mean(spark, d):
    return _rounded(pre.sliding(_vox(spark, d), 5, F.avg), "v")


@query(f"with {_sliding_sql('avg', 1, 2)} select t // 4 as t, pixel, round(v, 6) as v from slid, n where t >= 0 and t < n and t % 4 = 0")
def sliding_mean_decimate(spark, d):
    return _rounded(pre.sliding(_vox(spark, d), 4, F.avg, step=4), "v")


@query(f"with {_sliding_sql('stddev_pop', 2, 2)} select t, pixel, round(v, 6) as v from slid, n where t >= 0 and t < n")
def sliding_std(spark, d):
    return _rounded(pre.sliding(_vox(spark, d), 5, F.stddev_pop), "v")


@query(f"with {VOX} select pixel, t // 10 as t, max(v) as v from vox group by 1, 2")
def tumbling_max(spark, d):
    return pre.tumbling(_vox(spark, d), 10, F.max)


@query(f"with {VOX}, {N} select pixel, t // 7 as t, round(avg(v), 6) as v from vox, n where t < n // 7 * 7 group by 1, 2")
def tumbling_mean(spark, d):
    return _rounded(pre.tumbling(_vox(spark, d), 7, F.avg, whole_only=True), "v")


@query(f"with {VOX} select pixel, round(stddev_pop(v), 6) as std from vox group by 1")
def pixel_std(spark, d):
    return _rounded(pre.pixel_std(_vox(spark, d)), "std")


@query(f"""with {VOX}, {N}, ts as (select i as t, cast(floor(i * ((n - 1) / 99.0) + 0.5) as bigint) as s from n, (select unnest(range(100)) as i)),
ps as (select i as pixel, cast(floor((i // 5) * (7 / 4.0) + 0.5) as bigint) * 8 + cast(floor((i % 5) * (7 / 4.0) + 0.5) as bigint) as s
  from (select unnest(range(25)) as i))
select ts.t, ps.pixel, v from ts join vox on vox.t = ts.s join ps on vox.pixel = ps.s""")
def resample_nearest(spark, d):
    return pre.resample_nearest(views.frames(spark, d), (H, W), (100, 5, 5))


@query(f"with {VOX} select t, (pixel // 8 - 2) * 4 + pixel % 8 - 1 as pixel, v from vox where pixel // 8 between 2 and 6 and pixel % 8 between 1 and 4")
def crop(spark, d):
    return pre.crop(_vox(spark, d), W, 2, 1, 5, 4)


@query(f"with {VOX} select t, pixel // 8 * 8 + 7 - pixel % 8 as pixel, v from vox")
def flip(spark, d):
    return pre.flip(_vox(spark, d), W)


@query(f"with {VOX} select t, (7 - pixel % 8) * 8 + pixel // 8 as pixel, v from vox")
def rot90(spark, d):
    return pre.rot90(_vox(spark, d), H, W)


def _draw(k: int) -> str:
    return f"(cast('0x' || md5(t || ':5:{k}')[1:8] as bigint) / 2147483648.0 - 1)"


@query(f"with {VOX} select t, pixel, round(v * (1 + {_draw(0)} * 0.1) + {_draw(1)} * 0.1, 6) as v from vox")
def scale_shift(spark, d):
    return _rounded(pre.scale_shift(_vox(spark, d), 0.1, 0.1, 5), "v")


FILM = f"""{VOX}, film as (select t // 250 as video, t % 250 as t, pixel, v as raw, cast(v > {LEVEL} as int) as label from vox)"""


def _films(spark, d) -> DataFrame:
    """Videos of 250 frames with labels."""
    label = F.transform("v", lambda x: (x > LEVEL).cast("int")).alias("label")
    return views.frames(spark, d).select(F.call_function("div", "t", F.lit(250)).alias("video"), (F.col("t") % 250).alias("t"), "v", label)


@query(f"""with {FILM}, lv as (select video, quantile_cont(raw, 0.05) as lo, quantile_cont(raw, 0.95) as hi from film group by 1)
select video, t, pixel, round(least(greatest((raw - lo) / (hi - lo), 0), 1), 6) as v from film join lv using (video)""")
def scale_percentiles(spark, d):
    got = augment.scale_percentiles(_films(spark, d), Tables(spark), 5, 95)
    return _rounded(got.select("video", "t", F.posexplode("v").alias("pixel", "v")), "v").withColumn("pixel", F.col("pixel").cast("long"))


def _drawn(k: int) -> str:
    return f"(cast('0x' || md5(video || ':' || sample || ':11:{k}')[1:8] as bigint) / 4294967296.0::double)"


@query(f"""with {FILM}, sc as (select video, t, pixel, label, (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) as v from film window w as (partition by video)),
pool as (select video, t, pixel, label = 1 as fg, row_number() over (partition by video, label order by t, pixel) - 1 as rank from sc where label = 1 or v > 0),
smp as (select video, total, n_fg, n_bg, sample from (select video, max(t) + 1 as total, count(*) filter (label = 1) as n_fg,
  count(*) filter (label = 0 and v > 0) as n_bg from sc group by 1), (select unnest([0, 1]) as sample)),
pick as (select *, case when n_fg = 0 then false when n_bg = 0 then true else {_drawn(0)} < 0.5 end as fg from smp),
ctr as (select pick.video, sample, total, pool.t, pool.pixel from pick join pool on pool.video = pick.video and pool.fg = pick.fg
  and pool.rank = cast(floor({_drawn(1).replace("video", "pick.video")} * case when pick.fg then n_fg else n_bg end) as bigint)),
crop as (select video, sample, greatest(least(t - 8, total - 16), 0) as t0, greatest(least(pixel // 8 - 2, 4), 0) as h0, greatest(least(pixel % 8 - 2, 4), 0) as w0,
  {_drawn(2)} < 0.5 as fh, {_drawn(3)} < 0.5 as fw, case when {_drawn(4)} < 0.5 then cast(floor({_drawn(5)} * 3) as bigint) + 1 else 0 end as turn,
  case when {_drawn(6)} < 0.5 then 1 + (2 * {_drawn(7)} - 1) * 0.1::double else 1 end as scale, case when {_drawn(8)} < 0.5 then (2 * {_drawn(9)} - 1) * 0.1::double else 0 end as shift from ctr),
cut as (select crop.*, sc.t - t0 as t, case when fh then 3 - (pixel // 8 - h0) else pixel // 8 - h0 end as y, case when fw then 3 - (pixel % 8 - w0) else pixel % 8 - w0 end as x, v, label
  from crop join sc on sc.video = crop.video and sc.t between t0 and t0 + 15 and pixel // 8 between h0 and h0 + 3 and pixel % 8 between w0 and w0 + 3)
select video, cast(sample as int) as sample, t, cast(case turn when 0 then y * 4 + x when 1 then (3 - x) * 4 + y when 2 then (3 - y) * 4 + 3 - x else x * 4 + 3 - y end as bigint) as pixel,
  round(v * scale + shift, 6) as v, label from cut""")
def sample_crops(spark, d):
    tables = Tables(spark)
    scaled = augment.scale_percentiles(_films(spark, d), tables)
    got = augment.sample_crops(scaled, (H, W), (16, 4, 4), 11, tables)
    got = got.select("video", "sample", "t", F.posexplode(F.arrays_zip("v", "label")).alias("pixel", "x"))
    return _rounded(got.select("video", "sample", "t", F.col("pixel").cast("long").alias("pixel"), "x.v", "x.label"), "v")


# -- tiling ------------------------------------------------------------------------------------

WINDOWS = f"""{N}, wt as (select unnest(range(0, n - 16 + 1, 8)) as t0 from n union select n - 16 from n),
wh as (select unnest([0, 3, 4]) as o), win as (select t0, cast(a.o as bigint) as h0, cast(b.o as bigint) as w0 from wt, wh a, wh b)"""


@query(f"with {WINDOWS} select t0, h0, w0 from win")
def window_tiling(spark, d):
    frames = views.frames(spark, d).agg(F.max("t")).first()[0] + 1
    return tile.windows(spark, (frames, H, W), ROI, OVERLAP)


def _centred(cube: np.ndarray) -> np.ndarray:
    return cube - cube.mean()


def _overlap_sql(weight: str) -> str:
    return f"""with {VOX}, {WINDOWS}, inside as (
  select vox.t, vox.pixel, v - avg(v) over (partition by t0, h0, w0) as p, {weight} as weight from vox join win
  on t >= t0 and t < t0 + 16 and pixel // 8 >= h0 and pixel // 8 < h0 + 4 and pixel % 8 >= w0 and pixel % 8 < w0 + 4)
select t, pixel, round(sum(p * weight) / sum(weight), 6) as v from inside group by 1, 2"""


GAUSS = "exp(-0.5 * (" + " + ".join(
    f"(({x} - {o}) - {(r - 1) / 2}) / {0.125 * r} * ((({x} - {o}) - {(r - 1) / 2}) / {0.125 * r})" for x, o, r in (("t", "t0", 16), ("pixel // 8", "h0", 4), ("pixel % 8", "w0", 4))
) + "))"


def _overlap_add(spark, d, sigma):
    frames = views.frames(spark, d)
    total = frames.agg(F.max("t")).first()[0] + 1
    return _rounded(tile.overlap_add(frames, (total, H, W), ROI, OVERLAP, _centred, sigma), "v")


@query(_overlap_sql("1.0"))
def overlap_add(spark, d):
    return _overlap_add(spark, d, None)


@query(_overlap_sql(GAUSS))
def overlap_add_gauss(spark, d):
    return _overlap_add(spark, d, 0.125)


INSIDE = f"""{VOX}, {WINDOWS}, inside as (select t0, h0, w0, t, pixel // 8 as h, pixel % 8 as w, v - avg(v) over (partition by t0, h0, w0) as p,
  {GAUSS} as weight from vox join win
  on t >= t0 and t < t0 + 16 and pixel // 8 >= h0 and pixel // 8 < h0 + 4 and pixel % 8 >= w0 and pixel % 8 < w0 + 4)"""


def _resampled(spark, d, predictor, out_roi):
    frames = views.frames(spark, d)
    total = frames.agg(F.max("t")).first()[0] + 1
    return _rounded(tile.overlap_add(frames, (total, H, W), ROI, OVERLAP, predictor, 0.125, out_roi=out_roi), "v")


def _finer(cube: np.ndarray) -> np.ndarray:
    out = (cube - cube.mean()).repeat(2, 0).repeat(2, 1).repeat(2, 2)
    out[1::2] *= 2
    return out


@query(f"""with {INSIDE}, o as (select unnest([0, 1]) as o)
select t * 2 + a.o as t, (h * 2 + b.o) * 16 + w * 2 + c.o as pixel, round(sum(p * (1 + a.o) * weight) / sum(weight), 6) as v
from inside, o a, o b, o c group by 1, 2""")
def overlap_add_finer(spark, d):
    return _resampled(spark, d, _finer, (32, 8, 8))


def _coarser(cube: np.ndarray) -> np.ndarray:
    return (cube - cube.mean()).reshape(8, 2, 2, 2, 2, 2).mean((1, 3, 5))


@query(f"""with {INSIDE}, blocks as (select t0 // 2 + (t - t0) // 2 as t, (h0 // 2 + (h - h0) // 2) * 4 + w0 // 2 + (w - w0) // 2 as pixel,
  avg(p) as p, max(weight) filter ((t - t0) % 2 = 1 and (h - h0) % 2 = 1 and (w - w0) % 2 = 1) as weight from inside group by t0, h0, w0, 1, 2)
select t, pixel, round(sum(p * weight) / sum(weight), 6) as v from blocks group by 1, 2""")
def overlap_add_coarser(spark, d):
    return _resampled(spark, d, _coarser, (8, 2, 2))


@query(f"with {VOX} select t, pixel from vox where v - (0.1 - v) > 0")
def logit_mask(spark, d):
    return tile.logit_mask(_vox(spark, d).select("t", "pixel", F.col("v").alias("fg"), (0.1 - F.col("v")).alias("bg")))


# -- segmentation and features -----------------------------------------------------------------


@query(f"with recursive {LABELS} select t, label, pixel from lab")
def ccl4(spark, d):
    return segment.label_frames(views.frames(spark, d), LEVEL, H, W)


@query(f"with recursive {CM} select mask_id, t, pixel from cm")
def slice_connect(spark, d):
    return _cells(spark, d)


@query(f"""with recursive {CM} select mask_id, t, count(*) as area, round(avg(pixel // 8), 6) as com_h, round(avg(pixel % 8), 6) as com_w
from cm group by 1, 2""")
def component_stats(spark, d):
    return _rounded(segment.component_stats(_cells(spark, d), W), "com_h", "com_w")


@query(f"with {SM} select mask_id, round(avg(pixel // {PART_W}), 6) as com_h, round(avg(pixel % {PART_W}), 6) as com_w from sm group by 1")
def centroid(spark, d):
    return _rounded(features.centroid(views.counted_masks(spark, d), PART_W), "com_h", "com_w")


@query(f"""with {SM} select cast(s_suppkey as bigint) as mask_id, coalesce(h, -1) as com_h, coalesce(w, -1) as com_w from supplier left join (
  select mask_id, cast(round_even(avg(pixel // {PART_W}), 0) as bigint) as h, cast(round_even(avg(pixel % {PART_W}), 0) as bigint) as w
  from sm group by 1) on mask_id = s_suppkey""")
def centroid_int(spark, d):
    ids = views.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("mask_id"))
    return features.centroid_int(views.counted_masks(spark, d), ids, PART_W)


@query(f"""with {SM} select *, max_h - min_h as ext_h, max_w - min_w as ext_w from (select mask_id, min(pixel // {PART_W}) as min_h,
  min(pixel % {PART_W}) as min_w, max(pixel // {PART_W}) as max_h, max(pixel % {PART_W}) as max_w from sm group by 1)""")
def bbox_extent(spark, d):
    return features.bbox_extent(views.counted_masks(spark, d), PART_W)


@query(f"with {SM} select mask_id, sum(val * val) as area from sm group by 1")
def mask_area(spark, d):
    return features.area(views.counted_masks(spark, d))


@query(f"with {SM} select mask_id, pixel, cast(1 as double) as val from (select *, max(val) over (partition by mask_id) as peak from sm) where val >= peak * {BORDER}")
def border_refine(spark, d):
    return features.border_refine(views.counted_masks(spark, d), BORDER)


def _kept_masks(spark, d) -> DataFrame:
    return Tables(spark).keep(views.counted_masks(spark, d))


# -- pairs -------------------------------------------------------------------------------------


@query(f"with {OV} select i, j, overlap from ov")
def mask_overlap(spark, d):
    return pairs.overlap(_kept_masks(spark, d))


@query(f"with {OV} select i, j, round(overlap / (a.area + b.area - overlap), 6) as iou from ov join ar a on a.mask_id = i join ar b on b.mask_id = j")
def mask_iou(spark, d):
    return _rounded(pairs.iou(_kept_masks(spark, d)), "iou")


@query(f"with {RATIOS} select i, j, round(own, 6) as ratio from rt")
def mask_containment(spark, d):
    return _rounded(pairs.containment(_kept_masks(spark, d)), "ratio")


@query(f"with {RATIOS} select i, j, round(other, 6) as ratio from rt")
def overlap_ratio(spark, d):
    return _rounded(pairs.overlap_ratio(_kept_masks(spark, d)), "ratio")


def _lines(spark, d) -> DataFrame:
    rows = views.read(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("mask_id"), F.col("l_partkey").cast("long").alias("pixel"))
    return rows.distinct().withColumn("val", F.lit(1.0))


LINES = "ln as (select distinct cast(l_linenumber as bigint) as mask_id, cast(l_partkey as bigint) as pixel, cast(1 as double) as val from lineitem)"


@query(f"""with {SM}, {LINES}, o as (select sm.mask_id as i, ln.mask_id as j, sum(sm.val * ln.val) as overlap from sm join ln using (pixel) group by 1, 2),
a as (select mask_id, sum(val) as s from sm group by 1), b as (select mask_id, sum(val) as s from ln group by 1)
select i, j, round(1 - overlap / (a.s + b.s - overlap), 6) as distance from o join a on a.mask_id = i join b on b.mask_id = j""")
def jaccard_distance(spark, d):
    return _rounded(pairs.jaccard_distance(views.counted_masks(spark, d), _lines(spark, d)), "distance")


@query(f"""with {SM}, lc as (select cast(l_linenumber as bigint) as mask_id, cast(l_partkey as bigint) as pixel, cast(count(*) as double) as val from lineitem group by 1, 2),
o as (select sm.mask_id as i, lc.mask_id as j, count(*) as met, count(*) filter (sm.val = lc.val) as same from sm join lc using (pixel) group by 1, 2),
a as (select mask_id, count(*) as s from sm group by 1), b as (select mask_id, count(*) as s from lc group by 1)
select i, j, round((a.s + b.s - met - same) / (a.s + b.s - met), 6) as distance from o join a on a.mask_id = i join b on b.mask_id = j""")
def coordinate_distance(spark, d):
    rows = views.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("mask_id"), F.col("l_partkey").cast("long").alias("pixel"))
    return _rounded(pairs.coordinate_distance(views.counted_masks(spark, d), rows.agg(F.count("*").cast("double").alias("val"))), "distance")


COM = f"""{CM}, st as (select mask_id, avg(pixel // 8) as h, avg(pixel % 8) as w from cm group by 1)"""


@query(f"""with recursive {COM} select a.mask_id as i, b.mask_id as j, round((a.h - b.h) * (a.h - b.h) + (a.w - b.w) * (a.w - b.w), 6) as squared
from st a join st b on a.mask_id < b.mask_id where round((a.h - b.h) * (a.h - b.h) + (a.w - b.w) * (a.w - b.w), 9) < 0.0625""")
def dist_pairs(spark, d):
    stats = segment.component_stats(_cells(spark, d), W)
    found = pairs.near_pairs(stats.select("mask_id", "com_h", "com_w"), 0.25)
    return _rounded(found.where(F.round("squared", 9) < 0.0625), "squared")


@query(f"""with recursive {COM}, gt as (select cast(label as bigint) as neuron, pixel from vox join embeddings on t = vec_id
  group by 1, 2 having round(avg(v), 9) > 0.02), g as (select neuron, avg(pixel // 8) as h, avg(pixel % 8) as w from gt group by 1)
select mask_id as i, neuron as j, round(sqrt((st.h - g.h) * (st.h - g.h) + (st.w - g.w) * (st.w - g.w)) * 0.5, 6) as distance from st, g""")
def com_distance(spark, d):
    stats = segment.component_stats(_cells(spark, d), W)
    return _rounded(pairs.distance_to(stats, features.centroid(_truth_masks(spark, d), W), 0.5), "distance")


@query(f"""with {SM}, {LINES}, x as (select mask_id, sum(val) as s from sm group by 1), y as (select mask_id, sum(val) as s from ln group by 1),
xy as (select mask_id, sum(sm.val * ln.val) as s from sm join ln using (mask_id, pixel) group by 1)
select x.mask_id, round(case when coalesce(y.s, 0) = 0 then 0 else 2 * coalesce(xy.s, 0) / (x.s + y.s) end, 6) as dice
from x left join y using (mask_id) left join xy using (mask_id)""")
def dice(spark, d):
    return _rounded(pairs.dice(views.counted_masks(spark, d), _lines(spark, d)), "dice")


@query(f"with {SM}, {LINES} select sm.mask_id as i, ln.mask_id as j, pixel, sm.val * ln.val as val from sm join ln using (pixel)")
def mask_intersection(spark, d):
    return pairs.intersections(views.counted_masks(spark, d), _lines(spark, d))


@query(f"with {SM} select a.mask_id as i, b.mask_id as j, pixel, a.val * b.val as val from sm a join sm b using (pixel) where a.mask_id < b.mask_id")
def mask_intersections(spark, d):
    return pairs.intersections(views.counted_masks(spark, d))


# -- merging -----------------------------------------------------------------------------------


def _closure(edges: str) -> str:
    return f"""ed as ({edges}), rc(a, b) as (select mask_id, mask_id from (select distinct mask_id from sm)
  union select rc.a, ed.b from rc join ed on rc.b = ed.a),
gr as (select a as mask_id, min(b) as group_id from rc group by 1)"""


IOU_EDGES = f"""select i as a, j as b from io where iou > cast(cast({IOU_AT} as float) as double)
  union all select j, i from io where iou > cast(cast({IOU_AT} as float) as double)"""
IOUS = f"{OV}, io as (select i, j, overlap / (a.area + b.area - overlap) as iou from ov join ar a on a.mask_id = i join ar b on b.mask_id = j)"


@query(f"with recursive {IOUS}, {_closure(IOU_EDGES)} select mask_id, group_id from gr")
def iou_groups(spark, d):
    tables = Tables(spark)
    return merge.groups_by_iou(tables.keep(views.counted_masks(spark, d)), IOU_AT, tables)


@query(f"with recursive {RATIOS}, {_closure(f'select i as a, j as b from rt where other >= {RATIO_AT} union all select j, i from rt where other >= {RATIO_AT}')} select mask_id, group_id from gr")
def overlap_groups(spark, d):
    tables = Tables(spark)
    return merge.groups_by_overlap(tables.keep(views.counted_masks(spark, d)), RATIO_AT, tables)


REFINED = IOUS.replace("sm as (", "raw as (").replace("from lineitem group by 1, 2)", f"""from lineitem group by 1, 2),
sm as (select mask_id, pixel, cast(1 as double) as val from (select *, max(val) over (partition by mask_id) as peak from raw) where val >= peak * {BORDER})""")


@query(f"""with recursive {REFINED}, {_closure(IOU_EDGES)} select group_id as mask_id, pixel, sum(val) as val from sm join gr using (mask_id) group by 1, 2""")
def merge_iou(spark, d):
    tables = Tables(spark)
    return merge.merge_iou(views.counted_masks(spark, d), IOU_AT, BORDER, tables)[0]


def _sevenths(masks: DataFrame) -> DataFrame:
    return masks.select("mask_id", (F.col("mask_id") % 7).alias("group_id")).distinct()


@query(f"with {SM} select mask_id % 7 as mask_id, pixel, sum(val) as val from sm group by 1, 2")
def merge_masks(spark, d):
    masks = views.counted_masks(spark, d)
    return merge.merge_masks(masks, _sevenths(masks))


@query(f"with recursive {CM} select distinct mask_id % 7 as mask_id, t from cm")
def merge_timestamps(spark, d):
    cells = _cells(spark, d)
    return merge.merge_times(cells.select("mask_id", "t").distinct(), _sevenths(cells))


def _merged_cells(spark, d, groups_of: Callable[[DataFrame, Tables], DataFrame]) -> DataFrame:
    tables = Tables(spark)
    cells = tables.keep(_cells(spark, d))
    masks = cells.select("mask_id", "pixel", F.lit(1.0).alias("val"))
    return merge.merged(masks, cells.select("mask_id", "t").distinct(), tables.keep(groups_of(masks, tables)))


@query()
def merge_com(spark, d):
    return _merged_cells(spark, d, lambda masks, tables: merge.merge_com(masks, W, 1.0, tables))


@query()
def refine_merge(spark, d):
    return _merged_cells(spark, d, lambda masks, tables: merge.refine_merge(masks, W, 0.5, 0.2, tables))


@query()
def merge_consume(spark, d):
    tables = Tables(spark)
    masks = tables.keep(views.counted_masks(spark, d))
    middle = features.area(features.border_refine(masks, BORDER)).agg(F.avg("area")).first()[0]  # about half are above it
    return merge.merge_consume(masks, RATIO_AT, BORDER, middle, tables)[1]


@query()
def footprints(spark, d):
    return flagship.footprints(views.frames(spark, d))


@query()
def footprint_report(spark, d):
    return _rounded(flagship.report(views.frames(spark, d), _truth_masks(spark, d), flagship.Params(match=0.8)), "peak", "snr", "iou", "precision", "recall", "f1")


# -- filters and shapes ------------------------------------------------------------------------


@query(f"""with {GT}, ah as (select label, vec_id as t, lead(vec_id) over (partition by label order by vec_id) as nx from embeddings)
select neuron as mask_id, pixel, cast(1 as double) as val from gt where neuron in (select label from ah where nx - t = 1)""")
def filter_active(spark, d):
    times = views.truth_active(spark, d).withColumnRenamed("neuron", "mask_id")
    return filters.filter_active(_truth_masks(spark, d), times, 2, 0.5)


@query(f"with {OV} select sm.* from sm join ar using (mask_id) where area > (select avg(area) from ar)")
def filter_small(spark, d):
    masks = views.counted_masks(spark, d)
    return filters.filter_small(masks, features.area(masks).agg(F.avg("area")).first()[0])


@query(f"with {OV} select sm.* from sm join ar using (mask_id) where area > 30 * 30")
def filter_small_sq(spark, d):
    return filters.filter_small(views.counted_masks(spark, d), 30, squared=True)


@query(f"""with recursive {CM}, ex as (select mask_id, max(pixel // 8) - min(pixel // 8) as h, max(pixel % 8) - min(pixel % 8) as w from cm group by 1)
select cm.mask_id, pixel, cast(1 as double) as val from cm join ex using (mask_id) where (h = 0 and w = 0) or (h > 0 and w > 0 and h <= w * 2 and w <= h * 2)""")
def ratio_filter(spark, d):
    return filters.filter_ratio(_cell_masks(spark, d), 2, W)


BOUNDS = (0.3, 2.0, 0.5, 3.0)


@query()
def filter_ellipse(spark, d):
    return filters.filter_ellipse(_cell_masks(spark, d), BOUNDS, H, W)


@query()
def ellipse_split(spark, d):
    return filters.ellipse_split(_cell_masks(spark, d), BOUNDS, H, W)


CROSS = "cr as (select unnest([0, 0, 0, 1, -1]) as y, unnest([0, 1, -1, 0, 0]) as x)"
MOVED = f"""{CROSS}, mv as (select mask_id, (pixel // 8 + y) * 8 + pixel % 8 + x as pixel, pixel as origin from cm, cr
  where pixel // 8 + y between 0 and 7 and pixel % 8 + x between 0 and 7)"""


@query(f"with recursive {CM}, {MOVED} select distinct mask_id, pixel, cast(1 as double) as val from mv")
def dilate(spark, d):
    return morph.dilate(_cell_masks(spark, d), 3, H, W)


@query(f"""with recursive {CM}, {MOVED}, big as (select mask_id from cm group by 1 having count(*) > 3 and count(*) < 6)
select distinct mask_id, pixel, cast(1 as double) as val from mv where mask_id in (select mask_id from big)
union all select mask_id, pixel, cast(1 as double) from cm where mask_id not in (select mask_id from big)""")
def dilate_if(spark, d):
    return morph.dilate_if(_cell_masks(spark, d), 3, 3, 6, H, W)


@query(f"""with recursive {CM}, {CROSS}, need as (select cm.mask_id, cm.pixel, (pixel // 8 + y) * 8 + pixel % 8 + x as q from cm, cr
  where pixel // 8 + y between 0 and 7 and pixel % 8 + x between 0 and 7)
select need.mask_id, need.pixel, cast(1 as double) as val from need left join cm b on b.mask_id = need.mask_id and b.pixel = q
group by 1, 2 having count(*) = count(b.pixel)""")
def erode(spark, d):
    return morph.erode(_cell_masks(spark, d), 3, H, W)


@query(f"""with recursive {CM}, {MOVED} select cm.mask_id, cm.pixel from cm where (mask_id, pixel) not in (
  select (mask_id, pixel) from mv group by mask_id, pixel having count(*) = 5)""")
def mask_boundary(spark, d):
    return morph.boundary(_cell_masks(spark, d), H, W)


@query()
def open_close(spark, d):
    return morph.open_close(_cell_masks(spark, d), 3, 3, H, W)


@query()
def open_close_between(spark, d):
    return morph.open_close_between(_cell_masks(spark, d), 3, 9, 3, 3, H, W)


# -- overlaps and traces -----------------------------------------------------------------------


@query(f"with {GT} select neuron as mask_id, pixel, cast(1 as double) as val from gt where pixel in (select pixel from gt group by 1 having count(*) = 1)")
def overlap_cancel(spark, d):
    return overlap.cancel(_truth_masks(spark, d))


@query(f"""with {SM}, tot as (select mask_id, sum(val) as total from sm group by 1)
select mask_id, pixel from (select mask_id, pixel, row_number() over (partition by pixel order by total, mask_id) as k from sm join tot using (mask_id)) where k = 1""")
def remove_overlap(spark, d):
    return overlap.smallest_owner(views.counted_masks(spark, d))


@query(f"""with {GT}, ar as (select neuron, count(*) as n from gt group by 1),
ov as (select a.neuron as i, b.neuron as j, count(*) as n from gt a join gt b using (pixel) where a.neuron < b.neuron group by 1, 2),
ch as (select i, j from ov join ar a on a.neuron = i join ar b on b.neuron = j where least(ov.n / a.n, ov.n / b.n) < 0.9),
sh as (select i, j, a.pixel from ch join gt a on a.neuron = i join gt b on b.neuron = j and b.pixel = a.pixel),
mt as (select neuron, t, avg(v) as m from gt join vox using (pixel) group by 1, 2),
cl as (select i, j, pixel, unnest([i, j]) as neuron from sh),
fi as (select neuron, pixel, corr(v, m) as c from (select distinct neuron, pixel from cl) join vox using (pixel) join mt using (neuron, t) group by 1, 2),
wo as (select i, j, pixel, first(neuron order by round(coalesce(case when isnan(c) then -2 else c end, -2), 12) desc, neuron) as won
  from cl join fi using (neuron, pixel) group by 1, 2, 3)
select neuron as mask_id, pixel from gt where (neuron, pixel) not in (select (case when won = i then j else i end, pixel) from wo)""")
def overlap_assign_corr(spark, d):
    return overlap.assign_by_correlation(_truth_masks(spark, d), _vox(spark, d), 0.9)


TRACE = f"{GT}, tr as (select neuron as mask_id, t, sum(v) as s, count(*) as n from gt join vox using (pixel) group by 1, 2)"


@query(f"with {TRACE} select mask_id, t, round(s / n, 6) as trace from tr")
def mask_trace(spark, d):
    return _rounded(traces.extract(_truth_masks(spark, d), _vox(spark, d)), "trace")


@query(f'with {TRACE} select mask_id, t, round(s / n, 6) as "mean" from tr')
def mean_trace(spark, d):
    return _rounded(overlap.mean_trace(_truth_masks(spark, d), _vox(spark, d)), "mean")


@query(f"""with {TRACE} select a.mask_id as i, b.mask_id as j, round(corr(a.s / a.n, b.s / b.n), 6) as corr
from tr a join tr b on a.t = b.t and a.mask_id < b.mask_id group by 1, 2""")
def trace_corr(spark, d):
    return _rounded(traces.correlation(traces.extract(_truth_masks(spark, d), _vox(spark, d))), "corr")


#: Frames are dealt to the nine tiles of a larger image, with room for rings between them.
SIDE, GAP = 60, 20


def _ring_sql(masks: str, h: int, w: int) -> str:
    middle, half = "(a + b) / 2", "sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)"

    def grown(radius: str) -> str:
        return f"""select distinct mask_id, (pixel // {w} + y.d) * {w} + pixel % {w} + x.d as pixel from {masks} join rd using (mask_id), od y, od x
  where y.d * y.d + x.d * x.d <= {radius} * {radius} and pixel // {w} + y.d between 0 and {h - 1} and pixel % {w} + x.d between 0 and {w - 1}"""

    return f"""mo as (select mask_id, var_pop(pixel // {w}) + 1 / 12.0 as a, var_pop(pixel % {w}) + 1 / 12.0 as b, covar_pop(pixel // {w}, pixel % {w}) as c from {masks} group by 1),
ax as (select mask_id, 4 * sqrt({middle} + {half}) + 4 * sqrt(greatest({middle} - {half}, 0)) as s from mo),
rd as (select mask_id, greatest(floor(round(s / 8, 9)), 1) as near, greatest(floor(round(s / 6, 9)), 2.5) as far from ax),
od as (select unnest(range(-9, 10)) as d), zo as ({grown("near")}), wi as ({grown("far")}),
ring as (select mask_id, pixel from wi where pixel not in (select pixel from zo))"""


@query(f"""with recursive {CM}, big as (select mask_id, (t % 9 // 3 * {GAP} + 6 + pixel // 8) * {SIDE} + t % 9 % 3 * {GAP} + 6 + pixel % 8 as pixel from cm),
{_ring_sql("big", SIDE, SIDE)} select mask_id, pixel from ring""")
def bg_ring(spark, d):
    tile_of = F.col("t") % 9
    y = F.call_function("div", tile_of, F.lit(3)) * GAP + 6 + features.row(W)
    x = tile_of % 3 * GAP + 6 + features.col(W)
    return traces.background_rings(_cells(spark, d).select("mask_id", (y * SIDE + x).alias("pixel")), SIDE, SIDE)


@query(f"""with {GT}, mk as (select neuron as mask_id, pixel from gt), {_ring_sql("mk", 8, 8)},
ce as (select mask_id, t, sum(v) / count(*) as v from mk join vox using (pixel) group by 1, 2),
bg as (select mask_id, t, sum(v) / count(*) as v from ring join vox using (pixel) group by 1, 2)
select mask_id, t, round(ce.v, 6) as cell, round(bg.v, 6) as bg, round(ce.v - 0.7 * bg.v, 6) as bg_rm from ce left join bg using (mask_id, t)""")
def trace_bg_removed(spark, d):
    return _rounded(traces.background_removed(_truth_masks(spark, d), _vox(spark, d), H, W), "cell", "bg", "bg_rm")


# -- evaluation --------------------------------------------------------------------------------

STA = f"""{GT}, ar as (select neuron, count(*) as area from gt group by 1), fg as (select t, pixel from vox where v > {LEVEL}),
ov as (select neuron, t, count(*) as overlap from gt join fg using (pixel) group by 1, 2),
grid as (select neuron, area, vec_id as t, label = neuron as active from ar, embeddings),
ok as (select grid.neuron, case when active then coalesce(overlap, 0) / area >= 0.2 else coalesce(overlap, 0) / area <= 0.8 end as ok
  from grid left join ov on ov.neuron = grid.neuron and ov.t = grid.t),
sta as (select neuron, avg(cast(ok as double)) as sta from ok group by 1)"""


@query(f"with {GT}, fg as (select t, pixel from vox where v > {LEVEL}) select neuron, t, count(*) as overlap from gt join fg using (pixel) group by 1, 2")
def sta_overlap(spark, d):
    return evaluate.activity_overlap(views.truth(spark, d), views.foreground(_vox(spark, d)))


def _sta(spark, d) -> DataFrame:
    return evaluate.temporal_accuracy(
        views.truth(spark, d), views.truth_active(spark, d), views.foreground(_vox(spark, d)), views.frames(spark, d).select("t")
    )


@query(f"with {STA} select neuron, round(sta, 6) as sta from sta")
def sta_accuracy(spark, d):
    return _rounded(_sta(spark, d), "sta")


@query(f"with {STA} select round(avg(sta), 6) as sta from sta")
def sta_mean(spark, d):
    return _rounded(_sta(spark, d).agg(F.avg("sta").alias("sta")), "sta")


@query("""with ev as (select user_id, event_id, cast(round(value * 100) as bigint) as cents, 1 + event_id % 3 as n from events)
select user_id, event_id, sum(cents * n) over w / sum(n) over w as "mean" from ev
window w as (partition by user_id order by event_id rows between unbounded preceding and current row)""")
def running_mean(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    events = views.read(spark, d, "events").select("user_id", "event_id", cents.alias("cents"), (1 + F.col("event_id") % 3).alias("n"))
    return evaluate.running_mean(events, "user_id", "event_id", "cents", "n")


@query()
def eval_jaccard(spark, d):
    tables = Tables(spark)
    found, truth = tables.keep(_cell_masks(spark, d)), tables.keep(_truth_masks(spark, d))
    return evaluate.scores(evaluate.match_jaccard(found, truth, 0.8, tables), found, truth)


@query(f"""with recursive {COM}, gt as (select cast(label as bigint) as neuron, pixel from vox join embeddings on t = vec_id
  group by 1, 2 having round(avg(v), 9) > 0.02),
a as (select mask_id, count(*) as n, round_even(avg(pixel // 8), 0) as h, round_even(avg(pixel % 8), 0) as w from cm group by 1),
b as (select neuron, count(*) as n, round_even(avg(pixel // 8), 0) as h, round_even(avg(pixel % 8), 0) as w from gt group by 1),
o as (select mask_id, neuron, count(*) as n from cm join gt using (pixel) group by 1, 2)
select mask_id as i, neuron as j, round(o.n / (a.n + b.n - o.n), 6) as iou from o join a using (mask_id) join b using (neuron)
where o.n / (a.n + b.n - o.n) > 0.2 and sqrt((a.h - b.h) * (a.h - b.h) + (a.w - b.w) * (a.w - b.w)) < 3""")
def euclid_edges(spark, d):
    return _rounded(evaluate.euclid_edges(_cell_masks(spark, d), _truth_masks(spark, d), W, 1.0, 0.2, 3.0), "iou")


@query()
def match_greedy(spark, d):
    tables = Tables(spark)
    found, truth = tables.keep(_cell_masks(spark, d)), tables.keep(_truth_masks(spark, d))
    return evaluate.match_greedy(evaluate.euclid_edges(found, truth, W, 1.0, 0.2, 3.0), tables)


@query()
def eval_euclid(spark, d):
    tables = Tables(spark)
    found, truth = tables.keep(_cell_masks(spark, d)), tables.keep(_truth_masks(spark, d))
    return evaluate.scores(evaluate.match_greedy(evaluate.euclid_edges(found, truth, W, 1.0, 0.2, 3.0), tables), found, truth)


@query("""with r as (select vec_id as t, row_number() over (order by md5(vec_id || ':11'), vec_id) - 1 as k, count(*) over () as n from embeddings),
p as (select t, unnest(range(k, (n + 6) // 7 * 7, n)) as k from r) select t, k % 7 as shard, k // 7 as place from p""")
def shard_sampler(spark, d):
    return evaluate.shards(views.frames(spark, d), "t", 7, 11, Tables(spark))


# -- maps and exports --------------------------------------------------------------------------


def _channel(k: int) -> str:
    return f"cast(sum(cast('0x' || md5(mask_id || ':{k}')[1:2] as bigint)) % 256 as bigint)"


@query(f"with {SM} select pixel, {_channel(0)} as r, {_channel(1)} as g, {_channel(2)} as b, cast(255 as bigint) as alpha from sm group by 1")
def colormap(spark, d):
    return view.colormap(views.counted_masks(spark, d), alpha=True)


@query(f"with {SM} select pixel, cast(sum(cast(floor(val * 255) as bigint) % 256) % 256 as bigint) as gray from sm group by 1")
def graymap(spark, d):
    return view.graymap(views.counted_masks(spark, d))


@query(f"with {FG} select distinct pixel from fg")
def summation_map(spark, d):
    return view.summation_map(views.foreground(_vox(spark, d)))


@query(f"with recursive {CM} select mask_id, string_agg((pixel // 8) || ':' || (pixel % 8), ',' order by pixel) as coords from cm group by 1")
def masks_nested(spark, d):
    nested = view.masks_nested(_cell_masks(spark, d), W)
    return nested.select("mask_id", F.array_join(F.transform("coords", lambda c: F.concat_ws(":", c["x"], c["y"])), ",").alias("coords"))


@query(f"with recursive {CM} select mask_id, pixel, cast(1 as double) as val from cm")
def masks_roundtrip(spark, d):
    return view.masks_from_nested(view.masks_nested(_cell_masks(spark, d), W), W)


def _files_back(spark, d, kind: str) -> DataFrame:
    """The video written as files of 100 frames and read back."""
    target = f"{Tables(spark).root}/{kind}"
    frames = views.frames(spark, d).select(F.lit("video").alias("path"), "t", F.lit(H).alias("h"), F.lit(W).alias("w"), F.col("v").cast("array<float>").alias("v"))
    sinks.write_volumes(frames, target, kind, most_frames=100)
    if kind == "tiff":
        got = tiff.read_tiff(spark, target)
    else:
        got = volumes.read_frames(spark, target, volumes.nifti_frames if kind == "nifti" else volumes.npz_frames("volume"))
    part = F.regexp_extract("path", r"-(\d+)\.\w+$", 1).cast("long")
    got = got.select((part * 100 + F.col("t")).alias("t"), F.posexplode("v").alias("pixel", "v"))
    return got.select("t", F.col("pixel").cast("long").alias("pixel"), F.col("v").cast("double").alias("v"))


@query(f"with {VOX} select t, pixel, v from vox")
def nifti_files(spark, d):
    return _files_back(spark, d, "nifti")


@query(f"with {VOX} select t, pixel, v from vox")
def npz_files(spark, d):
    return _files_back(spark, d, "npz")


@query(f"with {VOX} select t, pixel, v from vox")
def tiff_files(spark, d):
    return _files_back(spark, d, "tiff")


@query(f"""with {GT}, tr as (select neuron as mask_id, t, avg(v) as trace from gt join vox using (pixel) group by 1, 2)
select gt.neuron as mask_id, gt.pixel, n, round(total, 6) as total from gt
join (select mask_id, count(*) as n, sum(trace) as total from tr group by 1) on mask_id = gt.neuron""")
def mat_files(spark, d):
    """Masks with traces written as MAT files and read back: pixels, and each trace's length and sum."""
    target = f"{Tables(spark).root}/mat"
    of = traces.extract(_truth_masks(spark, d), _vox(spark, d))
    sinks.write_masks(_truth_masks(spark, d), target, W, of, stamp="", most=4)
    arrays = mat.read_mat(spark, target)
    ids = arrays.where("name = 'mask_id'").select("path", F.posexplode("v").alias("place", "id"))
    ids = ids.select("path", F.col("place").cast("long").alias("place"), F.col("id").cast("long").alias("id"))
    table = arrays.where("name = 'traces'").select("path", F.col("dims")[0].alias("rows"), F.posexplode("v").alias("k", "v")).where(~F.isnan("v"))
    sums = table.groupBy("path", (F.col("k") % F.col("rows")).alias("place")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    pixels = mat.masks(arrays, W).select("path", F.col("mask_id").alias("place"), "pixel")
    return _rounded(pixels.join(ids, ["path", "place"]).join(sums, ["path", "place"]).select(F.col("id").alias("mask_id"), "pixel", "n", "total"), "total")


@query(f"with recursive {CM} select mask_id, '{{\"mask_id\":' || mask_id || ',\"t\":' || t || ',\"pixel\":' || pixel || '}}' as json from cm")
def to_json(spark, d):
    return view.to_json(_cells(spark, d), "mask_id")
