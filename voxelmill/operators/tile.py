"""Tiled inference: windows over a video, a user-supplied predictor, weighted overlap-add."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Shape = tuple[int, int, int]

#: Values (8 MB) of the frames that a task adds up at once.
AT_ONCE = 1 << 20

_IN_WORKER: dict[str, Callable] = {}


@dataclass(frozen=True)
class Loaded:
    """A predictor that each Python worker makes once, however many windows it sees.

    ``make(path)`` returns a function from a batch of windows (an array with one axis more) to a batch
    of predictions, or a tuple of them. The path is the worker's own copy of ``artefact``, None without one.
    """

    make: Callable[[str | None], Callable]
    artefact: str | None = None
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def get(self) -> Callable:
        if self.token not in _IN_WORKER:
            _IN_WORKER.clear()  # a worker holds one model at a time
            _IN_WORKER[self.token] = self.make(SparkFiles.get(self.artefact) if self.artefact else None)
        return _IN_WORKER[self.token]


def loaded(spark: SparkSession, make: Callable[[str | None], Callable], path: str | None = None) -> Loaded:
    """A predictor made from a file, which Spark copies to each executor once; files need different names."""
    if path:
        spark.sparkContext.addFile(path)
    return Loaded(make, path and os.path.basename(path))


def interval(size: int, roi: int, overlap: float) -> int:
    """Step from one window to the next along an axis."""
    return roi if roi == size else max(1, int(roi * (1 - overlap)))


def origins(size: int, roi: int, step: int) -> Column:
    """Window starts along one axis: every step, and one that ends at the border."""
    last = max(size - roi, 0)
    return F.array_union(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long")), F.array(F.lit(last).cast("long")))


def windows(spark: SparkSession, size: Shape, roi: Shape, overlap: Shape) -> DataFrame:
    """``t0, h0, w0``: all windows of a video that is at least as large as one."""
    out = spark.range(1)
    for name, s, r, o in zip(("t0", "h0", "w0"), size, roi, overlap, strict=True):
        out = out.withColumn(name, F.explode(origins(s, r, interval(s, r, o))))
    return out.select("t0", "h0", "w0")


def _starts(x: int, size: int, roi: int, overlap: float) -> list[int]:
    """Starts of the windows that hold a coordinate, by arithmetic."""
    step, last = interval(size, roi, overlap), max(size - roi, 0)
    steps = [k * step for k in range(max(-(-(x - roi + 1) // step), 0), min(x // step, last // step) + 1)]
    return steps if x < last or last in steps else [*steps, last]


def importance(roi: Shape, sigma_scale: float | None = None) -> np.ndarray:
    """Weight of a voxel by its place in the window: one, or a Gaussian around the window's middle."""
    out = np.ones(roi)
    for axis, r in enumerate(roi if sigma_scale is not None else ()):
        one = np.exp(-0.5 * ((np.arange(r) - (r - 1) / 2) / (sigma_scale * r)) ** 2)
        out *= one.reshape([-1 if k == axis else 1 for k in range(3)])
    return out


def frames_of(vox: DataFrame, pixels: int) -> DataFrame:
    """``t, v``: voxels as a row per frame; a frame is one image at most, and absent voxels are 0."""
    values = F.map_from_entries(F.collect_list(F.struct(F.col("pixel").cast("int"), F.col("v").cast("double"))))
    each = vox.groupBy("t").agg(values.alias("m"))
    return each.select("t", F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(0.0))).alias("v"))


def overlap_add(
    frames: DataFrame, size: Shape, roi: Shape, overlap: tuple[float, float, float], predictor: Callable | Loaded, sigma_scale: float | None = None,
    process: Callable | None = None, outputs: tuple[str, ...] = ("v",), out_roi: Shape | None = None, weight_map: np.ndarray | None = None,
    batch: int = 32,
) -> DataFrame:
    """``t, pixel`` and a column for each output: weighted means of the predictions of all windows that hold a voxel.

    ``predictor`` takes an array of the window's shape and returns one, or a tuple of them for
    several ``outputs``; a ``Loaded`` one takes ``batch`` windows at once, which a task holds.
    ``process(predictions, weights)`` may replace both after it. ``weight_map`` replaces the weights
    of a window. Videos smaller than a window are padded with zeros, half before
    and the odd one after. Frames ``t, v`` are cut to patches; a batch gathers its windows' patches, and a
    few frames the weighted patches of their windows, so a voxel travels as 8 bytes of an array.

    Predictions of another resolution have the shape ``out_roi``. A window that starts at x then
    starts at floor(x * out / in) of the output, whose size is floor(size * out / in); weights are
    those of the nearest voxel of the window. ``t`` and ``pixel`` count output frames and voxels.
    """
    out_roi = out_roi or roi
    pads = [max(r - s, 0) for s, r in zip(size, roi, strict=True)]
    full = [s + p for s, p in zip(size, pads, strict=True)]
    top, left = pads[1] // 2, pads[2] // 2
    base, k = importance(roi, sigma_scale) if weight_map is None else np.asarray(weight_map, np.float64), len(outputs)
    if base.shape != tuple(roi):
        raise ValueError("weights must have the window's shape")
    rows, cols = ([*range(0, max(s - r, 0) + 1, interval(s, r, o)), max(s - r, 0)] for s, r, o in zip(full[1:], roi[1:], overlap[1:], strict=True))
    rows, cols = sorted(set(rows)), sorted(set(cols))
    step, last = interval(full[0], roi[0], overlap[0]), max(full[0] - roi[0], 0)
    ratio = list(zip(out_roi, roi, strict=True))
    out_full = [s * o // r for s, (o, r) in zip(full, ratio, strict=True)]
    kept = [(round(p // 2 * o / r), round((p // 2 + s) * o / r)) for p, s, (o, r) in zip(pads, size, ratio, strict=True)]
    kept = [(a, min(b, n)) for (a, b), n in zip(kept, out_full, strict=True)]
    nearest = np.ix_(*[(2 * np.arange(o) + 1) * r // (2 * o) for o, r in ratio])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            out = []
            for t, v in zip(rows_["t"], rows_["v"], strict=True):
                image = np.zeros(full[1:])
                image[top : top + size[1], left : left + size[2]] = np.asarray(v, np.float64).reshape(size[1:])
                patches = [image[h0 : h0 + roi[1], w0 : w0 + roi[2]].tobytes() for h0 in rows for w0 in cols]
                for t0 in _starts(t + pads[0] // 2, full[0], roi[0], overlap[0]):
                    out += [(-(-t0 // step) * len(patches) + n, t, p) for n, p in enumerate(patches)]
            yield pd.DataFrame(out, columns=["win", "t", "patch"])

    def run(cubes: np.ndarray) -> np.ndarray:
        if isinstance(predictor, Loaded):
            got = predictor.get()(cubes)
            return np.stack([np.asarray(x, np.float64) for x in (got if isinstance(got, tuple) else (got,))], 1)
        got = [predictor(cube) for cube in cubes]
        return np.stack([[np.asarray(x, np.float64) for x in (g if isinstance(g, tuple) else (g,))] for g in got])

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        wins, of = np.unique(pdf["win"], return_inverse=True)
        starts = np.stack([np.minimum(wins // (len(rows) * len(cols)) * step, last), np.take(rows, wins // len(cols) % len(rows)), np.take(cols, wins % len(cols))])
        cubes, at_all = np.zeros((len(wins), *roi)), (pdf["t"] + pads[0] // 2).to_numpy() - starts[0][of]
        cubes[of, at_all] = np.frombuffer(b"".join(pdf["patch"]), np.float64).reshape(-1, *roi[1:])
        out = []
        for n, got in enumerate(run(cubes)):
            own, at = base, at_all[of == n]
            if process is not None:
                got, own = process(got, own)
            own = np.broadcast_to(own, roi)[nearest]
            summed = np.concatenate([got * own, own[None]])  # weighted outputs, and weights
            first = [int(x) * o // r for x, (o, r) in zip(starts[:, n], ratio, strict=True)]
            if out_roi[0] != roi[0]:
                at = np.arange(max(kept[0][0] - first[0], 0), min(kept[0][1] - first[0], out_roi[0]))
            out += [(first[0] + x - kept[0][0], *first[1:], summed[:, x].tobytes()) for x in at]
        return pd.DataFrame(out, columns=["t", "h0", "w0", "patch"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, of = np.unique(pdf["t"], return_inverse=True)
        total = np.zeros((len(ts), k + 1, *out_full[1:]))
        values = np.frombuffer(b"".join(pdf["patch"]), np.float64).reshape(-1, k + 1, *out_roi[1:])
        for n, h0, w0, patch in zip(of.tolist(), pdf["h0"].tolist(), pdf["w0"].tolist(), values):
            total[n, :, h0 : h0 + out_roi[1], w0 : w0 + out_roi[2]] += patch
        total = total[:, :, slice(*kept[1]), slice(*kept[2])]
        mean = (total[:, :k] / total[:, k:]).reshape(len(ts), k, -1)
        return pd.DataFrame({"t": ts} | {f"o{n}": list(mean[:, n]) for n in range(k)})

    patches = frames.select(F.col("t").cast("long").alias("t"), "v").mapInPandas(cut, "win long, t long, patch binary")
    got = patches.groupBy(F.call_function("div", "win", F.lit(batch)).alias("block")).applyInPandas(predict, "t long, h0 long, w0 long, patch binary")
    together = min(64, max(1, AT_ONCE // ((k + 1) * out_full[1] * out_full[2])))  # frames that a task adds up at once
    summed = got.groupBy(F.floor(F.col("t") / together).alias("block")).applyInPandas(add, "t long, " + ", ".join(f"o{n} array<double>" for n in range(k)))
    each = summed.select("t", F.posexplode(F.arrays_zip(*[f"o{n}" for n in range(k)])).alias("pixel", "o"))
    return each.select("t", F.col("pixel").cast("long").alias("pixel"), *[F.col(f"o.o{n}").alias(c) for n, c in enumerate(outputs)])


def logit_mask(logits: DataFrame, level: float = 0.0) -> DataFrame:
    """``t, pixel``: voxels whose foreground logit exceeds the background's by more than ``level``."""
    return logits.where(F.col("fg") - F.col("bg") > level).select("t", "pixel")
