"""Labelled rows to learn from: the held-out fold is left out, and the number is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._spark import thinned

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _known(labels: DataFrame, label: str) -> DataFrame:
    """``id, y``: labelled ids outside the held-out fold.

    Ids with several labels take the largest; null labels, and labels other than 0 and 1, don't count.
    """
    return (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )


def class_sizes(labels: DataFrame, label: str) -> dict[int, int]:
    """Labelled ids of either class outside the held-out fold."""
    return {r["y"]: r["count"] for r in _known(labels, label).groupBy("y").count().collect()}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``id, text, y``: about ``per_class`` labelled ids of either class outside the held-out fold, or all there are.

    Of each class those are taken whose hash of the id lies under a cut that follows from the class's
    count. An id with several rows has several here.
    """
    known, sizes = _known(labels, label), class_sizes(labels, label)
    picked = [thinned(known.where(F.col("y") == y), sizes.get(y, 0), per_class, "id") for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # about 2 * per_class rows
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id")).select("id", "text", "y")
