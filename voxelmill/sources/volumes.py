"""Image volumes and file lists. Files are read by Spark, so any store that Spark reads will do.

Such a file is decoded in one task; videos of many files are read in parallel. TIFF stacks are read by
ranges of pages (``sources.tiff``). Frames are rows ``path, t, h, w, v``.
"""

from __future__ import annotations

import functools
import gzip
import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.sources.tiff import FRAMES, frame_rows

#: Files whose largest values are told to every executor; those of more are joined by a shuffle.
FEW_FILES = 200_000
#: Fixed values of the NIfTI-1 format: data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def nifti_frames(data: bytes) -> Iterator[np.ndarray]:
    """Planes along the last axis of a NIfTI-1 volume, gzipped or not, rows before columns."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    dims = struct.unpack_from(f"{order}8h", raw, 40)
    shape = dims[1 : 1 + dims[0]]
    dtype = np.dtype(order + NIFTI_TYPES[struct.unpack_from(f"{order}h", raw, 70)[0]])
    offset, slope, inter = struct.unpack_from(f"{order}3f", raw, 108)
    x = np.frombuffer(raw, dtype, int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    x = np.moveaxis(x.reshape(x.shape[0], x.shape[1], -1), 2, 0)
    for plane in x:
        yield plane.T.astype(np.float32) * (slope or 1) + inter


def npz_frames(key: str) -> Callable[[bytes], Iterator[np.ndarray]]:
    """Planes along the last axis of an array in an ``.npz`` file."""

    def decode(data: bytes) -> Iterator[np.ndarray]:
        x = np.load(io.BytesIO(data))[key]
        yield from np.moveaxis(x, -1, 0)

    return decode


def read_frames(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[np.ndarray]], rotate: int = 0) -> DataFrame:
    """Frames of all files that match a path, turned by quarter turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield from frame_rows(name, 0, decode(data), rotate)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, FRAMES)


def read_nifti(spark: SparkSession, path: str, rotate: int = 0) -> DataFrame:
    return read_frames(spark, path, nifti_frames, rotate)


def signed_offset(frames: DataFrame) -> DataFrame:
    """Take 32768 from all values of a video that has a value above 32767."""
    top = frames.groupBy("path").agg(F.max(F.array_max("v")).alias("top")).withColumnRenamed("path", "of")
    if top.count() <= FEW_FILES:
        top = F.broadcast(top)
    high = frames.join(top, F.col("path") == F.col("of")).drop("of")
    return high.withColumn("v", F.when(F.col("top") > 32767, F.transform("v", lambda x: x - F.lit(32768.0).cast("float"))).otherwise(F.col("v"))).drop("top")


def read_datalist(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """``split, image, label`` from a JSON object with lists of image and label paths, and a ``test`` list of images alone.

    Relative paths are taken from ``base``. Missing lists give no rows, and test images a null label.
    """
    pair = "array<struct<image: string, label: string>>"
    lists = spark.read.schema(f"training {pair}, validation {pair}, test array<string>").option("multiLine", True).json(path)
    test = F.transform("test", lambda x: F.struct(x.alias("image"), F.lit(None).cast("string").alias("label")))
    parts = [lists.select(F.lit(s).alias("split"), F.inline(c).alias("image", "label")) for s, c in (("training", "training"), ("validation", "validation"), ("test", test))]
    rows = functools.reduce(DataFrame.unionByName, parts)
    if base is None:
        return rows
    at = base.rstrip("/") + "/"
    whole = {c: F.when(F.col(c).rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.col(c)).otherwise(F.concat(F.lit(at), F.col(c))) for c in ("image", "label")}
    return rows.withColumns(whole)


def nifti_head(shape: tuple[int, int, int], dtype: np.dtype) -> bytes:
    """Header of a NIfTI-1 file of ``rows, columns, planes``; frames follow, rows before columns."""
    codes = {v: k for k, v in NIFTI_TYPES.items()}
    if max(shape) > 32767:
        raise ValueError("a NIfTI-1 axis has 32,767 places at most")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, shape[1], shape[0], shape[2], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, codes[dtype.str[1:]], dtype.itemsize * 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head)


def nifti_bytes(volume: np.ndarray) -> bytes:
    """A ``rows, columns, planes`` array as a NIfTI-1 file."""
    return nifti_head(volume.shape, volume.dtype) + np.moveaxis(volume, 0, 1).tobytes(order="F")


def roi_bytes(rows: np.ndarray, cols: np.ndarray) -> bytes:
    """A polygon region in the ImageJ format, from its border points in order."""
    top, left = int(rows.min()), int(cols.min())
    head = bytearray(64)
    struct.pack_into(">4sh2b", head, 0, b"Iout", 227, 0, 0)
    struct.pack_into(">5h", head, 8, top, left, int(rows.max()) + 1, int(cols.max()) + 1, len(rows))
    points = np.concatenate([cols - left, rows - top]).astype(">i2").tobytes()
    return bytes(head) + points


def rois(masks: DataFrame, h: int, w: int) -> DataFrame:
    """``name, roi``: the outer outlines of each mask, one after another, as region files."""
    from voxelmill.functions.raster import outline
    from voxelmill.operators.filters import image, nested, shapes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, pixels, vals in batch.itertuples(index=False):
                points = np.concatenate([outline(one) for one in shapes(image(pixels, vals, h, w) != 0)])
                rows.append((f"{key}.roi", roi_bytes(points[:, 0], points[:, 1])))
            yield pd.DataFrame(rows, columns=["name", "roi"])

    return nested(masks).mapInPandas(run, "name string, roi binary")
