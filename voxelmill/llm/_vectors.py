"""Shared by the vector operators: usable vectors, whole-number components, chunks of rows in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole-number components lie within this bound, so that squared distances and products fit a long.
LIMIT = 1 << 27
#: Components in one chunk of rows, and rows at most.
CHUNK, CHUNK_ROWS = 1 << 20, 16_384


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of vectors of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), kept within ``LIMIT``."""
    return np.clip(np.floor(256.0 * x), -LIMIT, LIMIT).astype(np.int64)


def chunked(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[int, pa.Table]]:
    """Length and rows of chunks: consecutive rows of a task, parted by the length of their vectors."""

    def parted(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes = table[vector].combine_chunks().value_lengths().to_numpy()
        for dim in np.unique(sizes):
            rows = table.filter(pa.array(sizes == dim)) if (sizes != dim).any() else table
            step = int(np.clip(CHUNK // dim, 1, CHUNK_ROWS))
            for k in range(0, len(rows), step):
                yield int(dim), rows.slice(k, step).combine_chunks()

    held, size, n = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            lengths = np.cumsum(batch[vector].value_lengths().to_numpy())
            fit = min(max(1, int(np.searchsorted(lengths, CHUNK - size, "right"))), CHUNK_ROWS - n)
            held.append(batch.slice(0, fit))
            size, n = size + int(lengths[fit - 1]), n + fit
            batch = batch.slice(fit)
            if size >= CHUNK or n >= CHUNK_ROWS or batch.num_rows:
                yield from parted(held)
                held, size, n = [], 0, 0
    if held:
        yield from parted(held)


def single(rows: DataFrame) -> DataFrame:
    """``id, ..., vec`` with one row per id: repeated rows count once, and of several the least."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("least")).select("id", *[F.col("least")[c].alias(c) for c in rest])


def best(k: int, window: np.ndarray, score: np.ndarray, row_id: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window the ``k`` highest scores, ties to smaller ids."""
    order = np.lexsort((row_id, -score, window))
    sorted_ = window[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[rank < k]
    return tuple(x[order] for x in (window, score, row_id, *more))
