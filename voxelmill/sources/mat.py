"""Level-5 MAT files as rows: one row for each array of numbers, however deep in cells and structs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: number types of data elements, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE = 1, 2, 3, 4, 5
#: Cells and structs inside each other, at most; deeper files are refused.
DEEPEST = 100
LEAVES = "path string, name string, leaf long, place array<string>, dims array<long>, at array<long>, v array<double>"


def _element(data: memoryview, at: int, order: str) -> tuple[int, memoryview, int]:
    """Type, content and end of the data element at a place; the small form has its content in the tag."""
    if at + 8 > len(data):
        raise ValueError("a data element ends beyond its file")
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if kind >> 16:
        kind, size, start, end = kind & 0xFFFF, kind >> 16, at + 4, at + 8
    else:
        start = at + 8
        end = start + size if kind == COMPRESSED else start + -(-size // 8) * 8
    if start + size > len(data):
        raise ValueError("a data element ends beyond its file")
    return kind, data[start : start + size], end


def _numbers(data: memoryview, at: int, order: str) -> tuple[np.ndarray, int]:
    kind, raw, end = _element(data, at, order)
    if kind not in NUMBERS:
        raise ValueError(f"no numbers in an element of type {kind}")
    return np.frombuffer(raw, np.dtype(order + NUMBERS[kind])), end


def _array(data: memoryview, order: str, depth: int = 0) -> tuple[str, Iterator[tuple]]:
    """Name of an array element, and its leaves: place inside it, dimensions, places of values, values."""
    flags, at = _numbers(data, 0, order)
    dims, at = _numbers(data, at, order)
    name, at = _numbers(data, at, order)
    kind, dims = int(flags[0]) & 255, [int(n) for n in dims]
    n = int(np.prod(dims, dtype=object))
    if depth > DEEPEST or min(dims, default=0) < 0:
        raise ValueError("an array is nested too deep or has a negative size")

    def inner(at: int, labels: list[str]) -> Iterator[tuple]:
        for label in labels:
            _, raw, at = _element(data, at, order)
            if len(raw):
                for place, *rest in _array(raw, order, depth + 1)[1]:
                    yield [label, *place], *rest
            else:  # an empty array may have no content
                yield [label], [0, 0], None, np.zeros(0)

    def leaves() -> Iterator[tuple]:
        place = at
        if kind == CELL:
            if n * 8 > len(data):
                raise ValueError("more cells than the file has room for")
            yield from inner(place, [str(k) for k in range(n)])
        elif kind in (STRUCT, OBJECT):
            if kind == OBJECT:
                _, place = _numbers(data, place, order)
            length, place = _numbers(data, place, order)
            names, place = _numbers(data, place, order)
            width = max(int(length[0]), 1)
            fields = [names[k : k + width].tobytes().split(b"\0")[0].decode("latin-1") for k in range(0, len(names), width)]
            if n * len(fields) * 8 > len(data):
                raise ValueError("more fields than the file has room for")
            yield from inner(place, [f"{k}.{f}" for k in range(n) for f in fields])
        elif kind == SPARSE:
            rows, place = _numbers(data, place, order)
            starts, place = _numbers(data, place, order)
            v, _ = _numbers(data, place, order)
            used = int(starts[-1]) if len(starts) else 0
            column = np.repeat(np.arange(len(starts) - 1), np.diff(np.minimum(starts.astype(np.int64), len(v))))
            where = column * dims[0] + rows[: len(column)]
            yield [], dims, where[:used].astype(np.int64), v[: len(where)].astype(np.float64)
        else:
            v, _ = _numbers(data, place, order) if n or place + 8 <= len(data) else (np.zeros(0), 0)
            if len(v) != n and kind != CHAR:
                raise ValueError("an array has another size than its dimensions")
            yield [], dims, None, v.astype(np.float64)

    return name.tobytes().decode("latin-1"), leaves()


def leaves(data: bytes) -> Iterator[tuple]:
    """Variable, number of the leaf in it, place, dimensions, places of values and values, in the file's order.

    Values are column by column, as in the file. A compressed variable grows to 1,032 times its size
    at most, as the method can't do more; all other sizes are checked against the file's.
    """
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level-5 MAT file")
    order = "<" if data[126:128] == b"IM" else ">"
    view, at = memoryview(data), 128
    while at + 8 <= len(view):
        kind, raw, at = _element(view, at, order)
        if kind == COMPRESSED:
            try:
                kind, raw, _ = _element(memoryview(zlib.decompress(raw)), 0, order)
            except zlib.error as e:
                raise ValueError("a compressed variable is broken") from e
        if kind == MATRIX and len(raw):
            name, found = _array(raw, order)
            for k, leaf in enumerate(found):
                yield name, k, *leaf


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, leaf, place, dims, at, v``: each array of numbers in each variable of all files at a path.

    ``place`` leads to the array: cell numbers, and ``number.field`` in structs, from 0 and column by
    column. ``v`` holds values column by column; for sparse arrays only stored ones, with their places in ``at``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "name", "leaf", "place", "dims", "at", "v"]
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for leaf in leaves(data):
                    rows.append((file, *leaf))
                    held += len(leaf[-1])
                    if held > 1_000_000 or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LEAVES)


def masks(arrays: DataFrame, w: int, name: str = "masks") -> DataFrame:
    """``path, mask_id, pixel, val`` from lists of masks, each with an array of rows and one of columns.

    How deep the lists are nested doesn't matter: two arrays in turn are one mask. Repeated coordinates collapse.
    """
    own = arrays.where(F.col("name") == name)
    half = lambda k: F.max(F.when(F.col("leaf") % 2 == k, F.col("v")))
    each = own.groupBy("path", F.call_function("div", "leaf", F.lit(2)).alias("mask_id")).agg(half(0).alias("x"), half(1).alias("y"))
    points = each.select("path", "mask_id", F.inline(F.arrays_zip("x", "y")).alias("x", "y"))
    return points.select("path", "mask_id", (F.col("x").cast("long") * w + F.col("y").cast("long")).alias("pixel")).distinct().withColumn("val", F.lit(1.0))


def volume_masks(arrays: DataFrame, name: str) -> DataFrame:
    """``path, mask_id, pixel, val`` from an array of rows by columns by masks; zeros have no rows, fractions are cut off."""
    own = arrays.where((F.col("name") == name) & F.col("at").isNull()).select("path", "dims", F.posexplode("v").alias("k", "v"))
    h, w = F.col("dims")[0], F.col("dims")[1]
    row, rest = F.col("k") % h, F.call_function("div", "k", h)
    out = own.select("path", F.call_function("div", rest, w).alias("mask_id"), (row * w + rest % w).alias("pixel"), F.col("v").cast("long").cast("double").alias("val"))
    return out.where("val != 0")


def cell_activity(arrays: DataFrame, name: str) -> DataFrame:
    """``path, mask_id, t`` from a cell array with a series for each mask: where it isn't zero."""
    own = arrays.where(F.col("name") == name).select("path", F.col("place")[0].cast("long").alias("mask_id"), F.posexplode("v").alias("t", "v"))
    return own.where("v != 0").select("path", "mask_id", F.col("t").cast("long").alias("t"))


def _tagged(kind: int, raw: bytes) -> bytes:
    if kind != MATRIX and len(raw) <= 4 and len(raw):
        return struct.pack("<HH", kind, len(raw)) + raw.ljust(4, b"\0")
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def _matrix(name: str, value) -> bytes:
    def head(kind: int, dims: tuple[int, ...]) -> bytes:
        sizes = np.array(dims, "<i4").tobytes()
        return _tagged(6, struct.pack("<II", kind, 0)) + _tagged(5, sizes) + _tagged(1, name.encode("latin-1"))

    if isinstance(value, str):
        return _tagged(MATRIX, head(CHAR, (1, len(value))) + _tagged(4, value.encode("utf-16-le")))
    if isinstance(value, list):
        return _tagged(MATRIX, head(CELL, (1, len(value))) + b"".join(_matrix("", v) for v in value))
    if isinstance(value, dict):
        width = max((len(k) for k in value), default=0) + 1
        names = b"".join(k.encode("latin-1").ljust(width, b"\0") for k in value)
        return _tagged(MATRIX, head(STRUCT, (1, 1)) + _tagged(5, struct.pack("<i", width)) + _tagged(1, names) + b"".join(_matrix("", v) for v in value.values()))
    v = np.atleast_2d(np.asarray(value))
    kind = {"f8": (6, 9), "f4": (7, 7), "i1": (8, 1), "u1": (9, 2), "i2": (10, 3), "u2": (11, 4), "i4": (12, 5), "u4": (13, 6), "i8": (14, 12), "u8": (15, 13)}[v.dtype.str[1:]]
    return _tagged(MATRIX, head(kind[0], v.shape) + _tagged(kind[1], v.astype(v.dtype.newbyteorder("<")).tobytes(order="F")))


def mat_bytes(variables: dict, compress: bool = False) -> bytes:
    """A level-5 MAT file of number arrays, strings, lists (cells) and dicts (structs)."""
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        raw = _matrix(name, value)
        if compress:
            raw = zlib.compress(raw)
            raw = struct.pack("<II", COMPRESSED, len(raw)) + raw
        out += raw
    return out
