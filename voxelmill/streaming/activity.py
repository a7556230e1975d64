"""Online forms: windows over late events, and runs of activity as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Mean and count per key and window of event time; events later than ``late`` are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "mean", "n")


def _advance(run: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, length, done = state.get if state.exists else (-2, 0, False)
        hits = []
        for t in sorted({int(x) for batch in batches for x in batch["t"]}):
            if t <= last:
                continue
            length = length + 1 if t == last + 1 else 1
            last = t
            if length >= run and not done:
                done = True
                hits.append(t)
        state.update((last, length, done))
        yield pd.DataFrame({"mask_id": [key[0]] * len(hits), "t": hits}, dtype="int64")

    return step


def first_active(times: DataFrame, run: int) -> DataFrame:
    """``mask_id, t``: emitted once, when a mask has been seen in ``run`` consecutive frames.

    The state of a mask is its last frame and the length of its run. Frames arrive in order of
    batches; one that is older than a frame already taken is passed over.
    """
    return times.groupBy("mask_id").applyInPandasWithState(
        _advance(run), "mask_id long, t long", "last long, length long, done boolean", "append", "NoTimeout"
    )
