"""TIFF stacks read by ranges of pages, so that one long video is many tasks.

A first job walks the chain of page directories of every file, reading only those; a second one decodes
ranges of pages. Files are opened by pyarrow, which reads local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FRAMES = "path string, t long, h int, w int, v array<float>"
#: Pages of one unit of work; a task takes several units.
PAGES = 16
#: Values of small pages that are passed on together (4 MB).
VALUES = 1_000_000
#: Fixed values of the TIFF format: struct codes of the integer field types, tags, and the most bytes a stored byte may hold.
FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
MOST_RATIO = 4096


def opened(path: str) -> BinaryIO:
    """A file of any store that pyarrow knows, open for reads at any place."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Stack:
    """The page directories of one open file: classic or big, either byte order."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.size = file, file.seek(0, 2)
        head = self.read(0, min(16, self.size))
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else 0
        if kind not in (42, 43) or (kind == 43 and len(head) < 16):
            raise ValueError("not a TIFF file")
        self.order, self.big = order, kind == 43
        self.count, self.offset = ("Q", "Q") if self.big else ("H", "I")
        self.entry = struct.Struct(f"{order}HH{self.offset}")
        self.first = struct.unpack_from(f"{order}{self.offset}", head, 8 if self.big else 4)[0]

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a TIFF field points outside its file")
        self.file.seek(at)
        return self.file.read(n)

    def numbers(self, code: str, at: int, n: int = 1) -> tuple[int, ...]:
        return struct.unpack(f"{self.order}{n}{code}", self.read(at, n * struct.calcsize(f"<{code}")))

    def _entries(self, at: int) -> tuple[int, int]:
        """Where a directory's entries begin, and how many there are."""
        return at + struct.calcsize(f"<{self.count}"), self.numbers(self.count, at)[0]

    def pages(self) -> Iterator[int]:
        """Places of all page directories in order; a chain that returns to itself is refused."""
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise ValueError("the TIFF pages form a cycle")
            seen.add(at)
            yield at
            start, n = self._entries(at)
            at = self.numbers(self.offset, start + n * (self.entry.size + struct.calcsize(f"<{self.offset}")))[0]

    def tags(self, at: int) -> dict[int, tuple[int, ...]]:
        """The integer fields of one directory."""
        start, n = self._entries(at)
        width = struct.calcsize(f"<{self.offset}")
        raw, step = self.read(start, n * (self.entry.size + width)), self.entry.size + width
        out = {}
        for k in range(n):
            tag, kind, many = self.entry.unpack_from(raw, k * step)
            if kind in FIELDS:
                place = start + k * step + self.entry.size
                if many * struct.calcsize(f"<{FIELDS[kind]}") > width:
                    place = self.numbers(self.offset, place)[0]
                out[tag] = self.numbers(FIELDS[kind], place, many)
        return out

    def page(self, at: int) -> np.ndarray:
        """One page of a single channel, from strips or tiles."""
        tags = self.tags(at)

        def one(tag: int, default: int | None = None) -> int:
            if not tags.get(tag) and default is None:
                raise ValueError(f"a TIFF page lacks field {tag}")
            return tags[tag][0] if tags.get(tag) else default

        h, w, bits = one(HEIGHT), one(WIDTH), one(BITS, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
        if one(SAMPLES, 1) != 1 or kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits == 8):
            raise ValueError("only single-channel TIFF pages of whole bytes are read")
        dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
        tiled = TILE_OFFSETS in tags
        th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
        places, lengths = (tags.get(tag, ()) for tag in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
        if not lengths and len(places) == 1 and one(COMPRESSION, PLAIN) == PLAIN:
            lengths = (h * w * dtype.itemsize,)
        if not h or not w:
            return np.zeros((h, w), dtype)
        if not th or not tw:
            raise ValueError("a TIFF page has empty tiles")
        down, across = -(-h // th), -(-w // tw)
        if min(len(places), len(lengths)) < down * across or h * w * dtype.itemsize > MOST_RATIO * self.size:
            raise ValueError("a TIFF page lacks data")
        out = np.zeros((h, w), dtype)
        for k in range(down * across):
            y, x = k // across * th, k % across * tw
            rows = th if tiled else min(th, h - y)
            if rows * tw * dtype.itemsize > MOST_RATIO * max(lengths[k], 1):
                raise ValueError("a TIFF page lacks data")
            raw = unpack(self.read(places[k], lengths[k]), one(COMPRESSION, PLAIN), rows * tw * dtype.itemsize)
            part = restored(raw, rows, tw, dtype, one(PREDICTOR, 1))
            out[y : y + rows, x : x + tw] = part[: h - y, : w - x]
        return out


def unpack(raw: bytes, method: int, size: int) -> bytes:
    """The first ``size`` bytes of a strip or tile."""
    if method == PLAIN:
        out = raw
    elif method in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as broken:
            raise ValueError("a broken TIFF strip") from broken
    elif method == PACKBITS:
        out = _packbits(raw, size)
    elif method == LZW:
        out = _lzw(raw, size)
    else:
        raise ValueError(f"TIFF compression {method} isn't read")
    if len(out) < size:
        raise ValueError("a TIFF strip ends early")
    return out[:size]


def _packbits(raw: bytes, size: int) -> bytes:
    """Runs of literal bytes and of repeated ones."""
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; they widen one code before the table is full."""
    clear, end = 256, 257
    singles = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits = singles[:], 9, 0, 0
    out, filled, last = [], 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == clear:
            table, width, last = singles[:], 9, None
            continue
        if code == end:
            break
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("a broken TIFF strip")
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            width = min(max(9, (len(table) + 1).bit_length()), 12)
        out.append(word)
        filled, last = filled + len(word), word
        if filled >= size:
            break
    return b"".join(out)


def restored(raw: bytes, h: int, w: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """Samples from differences along rows (2), or from differences of bytes by significance (3)."""
    if predictor == 1:
        return np.frombuffer(raw, dtype).reshape(h, w)
    if predictor == 2 and dtype.kind in "ui":
        return np.cumsum(np.frombuffer(raw, dtype).reshape(h, w), axis=1, dtype=dtype.newbyteorder("="))
    if predictor == 3 and dtype.kind == "f":
        planes = np.cumsum(np.frombuffer(raw, "u1").reshape(h, -1), axis=1, dtype="u1").reshape(h, dtype.itemsize, w)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{dtype.itemsize}")[..., 0]
    raise ValueError(f"TIFF predictor {predictor} isn't read")


def tiff_pages(data: bytes) -> Iterator[np.ndarray]:
    """All pages of a file in memory."""
    stack = Stack(io.BytesIO(data))
    for at in stack.pages():
        yield stack.page(at)


def page_ranges(spark: SparkSession, path: str, pages: int = PAGES) -> DataFrame:
    """``path, t, places``: runs of up to ``pages`` page directories of every file that matches a path."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with opened(name) as file:
                    run, t = [], 0
                    for at in Stack(file).pages():
                        run.append(at)
                        if len(run) == pages:
                            yield pd.DataFrame({"path": [name], "t": [t], "places": [run]})
                            run, t = [], t + pages
                    if run:
                        yield pd.DataFrame({"path": [name], "t": [t], "places": [run]})

    files = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    return files.mapInPandas(walk, "path string, t long, places array<long>")


def frame_rows(name: str, first: int, pages: Iterable[np.ndarray], rotate: int) -> Iterator[pd.DataFrame]:
    """Pages as frames, in batches of a page or of up to ``VALUES`` values."""
    rows, held = [], 0
    for t, page in enumerate(pages, first):
        page = np.rot90(page, rotate)
        if held + page.size > VALUES and rows:
            yield pd.DataFrame(rows, columns=["path", "t", "h", "w", "v"])
            rows, held = [], 0
        rows.append((name, t, *page.shape, page.astype(np.float32).ravel()))
        held += page.size
    if rows:
        yield pd.DataFrame(rows, columns=["path", "t", "h", "w", "v"])


def read_tiff(spark: SparkSession, path: str, rotate: int = 0, tasks: int | None = None, pages: int = PAGES) -> DataFrame:
    """Frames of all stacks that match a path, turned by quarter turns.

    Ranges of pages are dealt evenly to ``tasks`` (four for every core unless given), whatever files
    they come from. A task holds one large page, or a few small ones. Directories of a file are walked by one task.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first, places in batch[["path", "t", "places"]].itertuples(index=False):
                with opened(name) as file:
                    stack = Stack(file)
                    yield from frame_rows(name, first, (stack.page(int(at)) for at in places), rotate)

    return page_ranges(spark, path, pages).repartition(tasks or 4 * spark.sparkContext.defaultParallelism).mapInPandas(decode, FRAMES)


def directories(n: int, h: int, w: int, dtype: np.dtype) -> bytes:
    """The head of a little-endian file of n pages, whose uncompressed values follow page by page."""
    kind, page = {"u": 1, "i": 2, "f": 3}[dtype.kind], h * w * dtype.itemsize
    big = n * (page + 256) > 4_000_000_000
    offset, count, field = ("Q", "Q", 16) if big else ("I", "H", 4)
    width = struct.calcsize(f"<{offset}")
    head = struct.pack("<2s3HQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    size = struct.calcsize(f"<{count}") + 8 * (4 + 2 * width) + width
    out = bytearray(head if n else head[:-width] + bytes(width))
    for k in range(n):
        fields = [
            (WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, dtype.itemsize * 8), (COMPRESSION, 3, PLAIN), (STRIP_OFFSETS, field, len(head) + n * size + k * page),
            (ROWS_PER_STRIP, 4, h), (STRIP_BYTES, field, page), (SAMPLE_FORMAT, 3, kind),
        ]
        out += struct.pack(f"<{count}", len(fields))
        for tag, t, value in fields:
            out += struct.pack(f"<HH{offset}", tag, t, 1) + struct.pack(f"<{FIELDS[t]}", value).ljust(width, b"\0")
        out += struct.pack(f"<{offset}", len(head) + (k + 1) * size if k + 1 < n else 0)
    return bytes(out)


def tiff_bytes(pages: np.ndarray) -> bytes:
    """Pages of whole or floating values as an uncompressed TIFF."""
    return directories(*pages.shape, pages.dtype) + pages.astype(pages.dtype.newbyteorder("<")).tobytes()
