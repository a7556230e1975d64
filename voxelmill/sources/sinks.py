"""Volumes, regions and masks as files, written by tasks and committed as a whole.

``spark.write.format("whole_files")`` takes rows ``file, entry, data`` in order and appends their bytes to
files; rows with an entry become members of a zip file. Tasks write into a folder of their job. Only
when all tasks are done are files moved into place, so a failed or repeated task leaves nothing.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from voxelmill.operators.view import masks_nested
from voxelmill.sources import tiff
from voxelmill.sources.mat import mat_bytes
from voxelmill.sources.volumes import nifti_head, rois

#: Frames of one file; longer videos are several files, each written by one task, frame by frame.
MOST_FRAMES = 4096
#: Regions of a zip file, and masks of a MAT file (which a task builds in memory), about.
MOST_REGIONS, MOST_MASKS = 10_000, 200
SCHEMA = "file string, entry string, data binary"


def store(path: str):
    """The file system of a path, and its name there."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: names below the target, and where the bytes lie."""

    files: list[tuple[str, str]]


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> WholeFilesWriter:
        return WholeFilesWriter(self.options["path"], overwrite)


class WholeFilesWriter(DataSourceWriter):
    """Two phases: tasks write under ``_job-<id>``, the driver moves what the last attempts wrote."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = store(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        done, at = [], {}
        current = entry = None
        raw = archive = member = None

        def close(whole: bool) -> None:
            nonlocal member, archive, raw
            if member is not None:
                member.close()
                member = None
            if whole and archive is not None:
                archive.close()
                archive = None
            if whole and raw is not None:
                raw.close()
                raw = None

        try:
            for row in iterator:
                if row.file != current:
                    close(True)
                    if row.file in at or not row.file or row.file.startswith(("/", "_job-")) or ".." in row.file.split("/"):
                        raise ValueError(f"rows of {row.file!r} aren't together, or it isn't a file below the target")
                    current, entry, at[row.file] = row.file, None, f"{folder}/{len(at)}"
                    raw = files.open_output_stream(at[current])
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) if row.entry is not None else None
                    done.append((current, at[current].removeprefix(f"{root}/")))
                if (row.entry is None) != (archive is None):
                    raise ValueError(f"{current!r} is a zip file in some rows only")
                if archive is None:
                    raw.write(bytes(row.data))
                    continue
                if row.entry != entry:
                    close(False)
                    info = zipfile.ZipInfo(row.entry)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    member, entry = archive.open(info, "w", force_zip64=True), row.entry
                member.write(bytes(row.data))
        finally:
            close(True)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = store(self.path)
        moves = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in moves]
        taken = [] if self.overwrite else [i.path for i in files.get_file_info([f"{root}/{n}" for n in names]) if i.type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or taken:
            self.abort(messages)
            raise ValueError(f"files were written by two tasks or are there already: {taken or sorted(n for n in set(names) if names.count(n) > 1)[:5]}")
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.base_name != self.job:
                    (files.delete_dir if old.type == fs.FileType.Directory else files.delete_file)(old.path)
        for name, place in moves:
            files.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            files.move(f"{root}/{place}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete the job's folder."""
        from pyarrow import fs

        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows ``file, entry, data`` in order, all rows of a file in one partition."""
    rows.sparkSession.dataSource.register(WholeFiles)
    rows.select("file", "entry", "data").write.format("whole_files").mode("overwrite" if overwrite else "append").save(path)


def _heads(kind: str, dtype: str, key: str):
    """Header of a file with n frames of h by w values."""

    def npz(n: int, h: int, w: int) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_2_0(out, {"descr": np.dtype(dtype).newbyteorder("<").str, "fortran_order": True, "shape": (h, w, n)})
        return out.getvalue()

    def stack(n: int, h: int, w: int) -> bytes:
        return tiff.directories(n, h, w, np.dtype(dtype))

    return {"nifti": lambda n, h, w: nifti_head((h, w, n), np.dtype(dtype)), "npz": npz, "tiff": stack}[kind]


def write_volumes(
    frames: DataFrame, path: str, kind: str = "nifti", dtype: str = "f4", key: str = "volume", name: Column | None = None,
    most_frames: int = MOST_FRAMES, overwrite: bool = False,
) -> None:
    """``path, t, h, w, v`` as files ``<name>-<part>`` of NIfTI-1, npz (one array of rows, columns, frames) or TIFF.

    ``name`` is the file's name without its ending unless given. Frames are shuffled once, to the task
    that writes their file; it holds one at a time. Headers come from counts of frames, as rows of
    their own. A part with absent or repeated frames or frames of several sizes is refused.
    """
    suffix = {"nifti": "nii", "npz": "npz", "tiff": "tif"}[kind]
    head, entry = _heads(kind, dtype, key), f"{key}.npy" if kind == "npz" else None
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1) if name is None else name
    part = F.call_function("div", "t", F.lit(most_frames))
    placed = frames.withColumn("file", F.format_string(f"%s-%05d.{suffix}", name, part))
    sizes = placed.groupBy("path", "file").agg(
        F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"), F.countDistinct("t").alias("times"),
        F.min("h").alias("h"), F.min("w").alias("w"), F.max("h").alias("h1"), F.max("w").alias("w1"),
    ).withColumn("paths", F.count("*").over(Window.partitionBy("file")))  # one row a video of that name

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.n != r.times or r.n != r.high - r.low + 1 or r.low % most_frames or (r.h, r.w) != (r.h1, r.w1):
                    raise ValueError(f"{r.file} has absent or repeated frames, or frames of several sizes")
                if r.paths > 1:
                    raise ValueError(f"{r.file} would hold several videos; give them names of their own")
            yield batch[["path", "file"]].assign(t=-1, data=[head(*map(int, x)) for x in batch[["n", "h", "w"]].itertuples(index=False)])

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for h, w, v in zip(batch["h"], batch["w"], batch["v"], strict=True):
                image = np.asarray(v, np.float64).reshape(h, w).astype(np.dtype(dtype).newbyteorder("<"))
                data.append(image.tobytes(order="F" if kind == "npz" else "C"))
            yield batch[["path", "file", "t"]].assign(data=data)

    columns = "path string, file string, t long, data binary"
    rows = sizes.mapInPandas(headers, columns).unionByName(placed.select("path", "file", "t", "h", "w", "v").mapInPandas(bodies, columns))
    rows = rows.repartition("path", "file").sortWithinPartitions("path", "file", "t")
    write_files(rows.select("file", F.lit(entry).cast("string").alias("entry"), "data"), path, overwrite)


def _dealt(rows: DataFrame, masks: DataFrame, most: int, name: str, suffix: str) -> DataFrame:
    """Rows with a file, about ``most`` masks in each."""
    parts = -(-max(masks.select("mask_id").distinct().count(), 1) // most)
    return rows.withColumn("file", F.format_string(f"{name}-%05d.{suffix}", F.pmod(F.xxhash64("mask_id"), F.lit(parts))))


def write_rois(masks: DataFrame, path: str, h: int, w: int, name: str = "regions", most: int = MOST_REGIONS, overwrite: bool = False) -> None:
    """Zip files ``<name>-<part>.zip`` with a region file for every mask."""
    regions = rois(masks, h, w).withColumn("mask_id", F.regexp_extract("name", r"^(-?\d+)", 1).cast("long"))
    rows = _dealt(regions, masks, most, name, "zip").repartition("file").sortWithinPartitions("file", "mask_id")
    write_files(rows.select("file", F.col("name").alias("entry"), F.col("roi").alias("data")), path, overwrite)


def write_masks(
    masks: DataFrame, path: str, w: int, traces: DataFrame | None = None, name: str = "masks", stamp: str | None = None,
    most: int = MOST_MASKS, overwrite: bool = False,
) -> None:
    """MAT files ``<name>-<part>.mat``: cells ``masks`` of rows x and columns y, ``mask_id``, and ``traces`` of masks by frames.

    ``traces`` are ``mask_id, t, trace``; absent values are NaN, and a mask without any has NaN only. Masks
    of a file are in ascending order of their ids.
    """
    stamp = datetime.now().strftime("%c") if stamp is None else stamp
    rows = masks_nested(masks, w)
    length, traced = 0, traces is not None
    if traced:
        length = (traces.agg(F.max("t")).first()[0] or 0) + 1
        series = F.sort_array(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), F.col("trace").cast("double").alias("v"))))
        rows = rows.join(traces.groupBy("mask_id").agg(series.alias("series")), "mask_id", "left")
    else:
        rows = rows.withColumn("series", F.lit(None).cast("array<struct<t: long, v: double>>"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mask_id")
        points = [np.array([(p["x"], p["y"]) for p in c], "i4").reshape(-1, 2) for c in pdf["coords"]]
        out = {"datetime": stamp, "masks": [{"x": p[:, 0], "y": p[:, 1]} for p in points], "mask_id": pdf["mask_id"].to_numpy("i8")}
        if traced:
            table = np.full((len(pdf), length), np.nan)
            for k, s in enumerate(pdf["series"]):
                for p in () if s is None else s:
                    table[k, p["t"]] = np.nan if p["v"] is None else p["v"]
            out["traces"] = table
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "entry": None, "data": [mat_bytes(out)]})

    rows = _dealt(rows.select("mask_id", "coords", "series"), masks, most, name, "mat")
    write_files(rows.groupBy("file").applyInPandas(build, SCHEMA), path, overwrite)
