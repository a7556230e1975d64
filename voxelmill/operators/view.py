"""Maps and exports of masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def colormap(masks: DataFrame, alpha: bool = False) -> DataFrame:
    """``pixel, r, g, b``: each mask adds a colour of its own to its pixels, modulo 256."""

    def channel(k: int):
        digest = F.md5(F.concat(F.col("mask_id").cast("string"), F.lit(f":{k}")))
        return F.conv(F.substring(digest, 1, 2), 16, 10).cast("long")

    out = masks.groupBy("pixel").agg(*[(F.sum(channel(k)) % 256).alias(c) for k, c in enumerate("rgb")])
    return out.withColumn("alpha", F.lit(255).cast("long")) if alpha else out


def graymap(masks: DataFrame) -> DataFrame:
    """``pixel, gray``: sum of 255 times the value, modulo 256 as 8-bit pixels wrap."""
    return masks.groupBy("pixel").agg((F.sum(F.floor(F.col("val") * 255).cast("long") % 256) % 256).alias("gray"))


def summation_map(foreground: DataFrame) -> DataFrame:
    """Pixels that are foreground at any time."""
    return foreground.select("pixel").distinct()


def masks_nested(masks: DataFrame, w: int) -> DataFrame:
    """``mask_id, coords``: rows x and columns y of each mask, in order; one mask is one image at most."""
    point = F.struct(F.call_function("div", "pixel", F.lit(w)).alias("x"), (F.col("pixel") % w).alias("y"))
    return masks.groupBy("mask_id").agg(F.sort_array(F.collect_list(point)).alias("coords"))


def masks_from_nested(nested: DataFrame, w: int) -> DataFrame:
    """Coordinate lists back to masks; repeated coordinates collapse, empty lists have no rows."""
    each = nested.select("mask_id", F.inline("coords").alias("x", "y"))
    return each.select("mask_id", (F.col("x") * w + F.col("y")).alias("pixel")).distinct().withColumn("val", F.lit(1.0))


def to_json(rows: DataFrame, key: str) -> DataFrame:
    """``key, json``: each row as a JSON object."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))
