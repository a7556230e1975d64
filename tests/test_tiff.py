"""TIFF stacks written here in every layout and read by ranges of pages, and broken ones."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.sources import tiff


def packbits(raw):
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while at + n < len(raw) and n < 128 and raw[at + n] == raw[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, raw[at]])
        else:
            out += bytes([0, raw[at]])
        at += n
    return bytes(out)


def lzw(raw):
    """Codes widen when entry 511, 1023 or 2047 is in the table; it is cleared when entry 4093 is."""
    bits, width, table, word = [], 9, {bytes([k]): k for k in range(256)}, b""

    def put(code):
        bits.append(f"{code:0{width}b}")

    put(256)
    filled = 258
    for byte in raw:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], filled = filled, filled + 1
        word = bytes([byte])
        if filled in (512, 1024, 2048):
            width += 1
        elif filled == 4094:
            put(256)
            width, filled, table = 9, 258, {bytes([k]): k for k in range(256)}
    if word:
        put(table[word])
        filled += 1
        width += filled in (512, 1024, 2048)
    put(257)
    flat = "".join(bits)
    flat += "0" * (-len(flat) % 8)
    return int(flat, 2).to_bytes(len(flat) // 8, "big")


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: packbits}


def stack(pages, method=1, predictor=1, tile=None, strip=None, order="<", big=False):
    t, h, w = pages.shape
    offset, count, field = ("Q", "Q", 16) if big else ("I", "H", 4)
    width = struct.calcsize("<" + offset)
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHH", 43, 8, 0) if big else struct.pack(order + "H", 42))
    out, link = bytearray(head) + bytes(width), len(head)

    def encoded(part):
        part = part.astype(part.dtype.newbyteorder(order))
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(part.dtype)
        elif predictor == 3:
            b = part.astype(part.dtype.newbyteorder(">")).view("u1").reshape(*part.shape, -1).transpose(0, 2, 1).reshape(len(part), -1)
            part = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype("u1")
        return PACK[method](part.tobytes())

    for page in pages:
        if tile:
            padded = np.pad(page, ((0, -h % tile[0]), (0, -w % tile[1])))
            parts = [padded[y : y + tile[0], x : x + tile[1]] for y in range(0, h, tile[0]) for x in range(0, w, tile[1])]
        else:
            parts = [page[y : y + (strip or h)] for y in range(0, h, strip or h)]
        raw = [encoded(p) for p in parts]
        places = []
        for r in raw:
            places.append(len(out))
            out += r
        tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [page.dtype.itemsize * 8]), (259, 3, [method]), (277, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 3, [tile[1]]), (323, 3, [tile[0]]), (324, field, places), (325, field, [len(r) for r in raw])] if tile else []
        tags += [] if tile else [(273, field, places), (278, 3, [strip or h]), (279, field, [len(r) for r in raw])]
        tags.append((339, 3, [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]]))
        entries = b""
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"{order}{len(values)}{tiff.FIELDS[kind]}", *values)
            if len(value) > width:
                at, value = len(out), struct.pack(order + offset, len(out)) + value
                out += value[width:]
                value = value[:width]
            entries += struct.pack(order + "HH" + offset, tag, kind, len(values)) + value.ljust(width, b"\0")
        out[link : link + width] = struct.pack(order + offset, len(out))
        out += struct.pack(order + count, len(tags)) + entries
        link = len(out)
        out += bytes(width)
    return bytes(out)


LAYOUTS = [
    dict(), dict(strip=3, order=">"), dict(tile=(16, 16), big=True), dict(method=32773, strip=4), dict(method=5), dict(method=5, predictor=2, tile=(16, 32), order=">"),
    dict(method=8, predictor=2, strip=5, big=True, order=">"), dict(method=32946, tile=(16, 16)),
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "f4", "f8"])
def test_layouts(layout, dtype):
    rng = np.random.default_rng(7)
    pages = (rng.integers(0, 90, (3, 41, 37)) * rng.integers(0, 2, (3, 41, 37))).astype(dtype)
    if dtype[0] == "f":
        pages = (pages * 0.37).astype(dtype)
        layout = layout | ({"predictor": 3} if "predictor" in layout else {})
    got = list(tiff.tiff_pages(stack(pages, **layout)))
    assert len(got) == 3 and all((a == b).all() for a, b in zip(got, pages))


def test_codes_of_all_widths():
    rng = np.random.default_rng(8)
    for raw in (b"", b"a", bytes(70_000), rng.integers(0, 256, 20_000, "u1").tobytes(), rng.integers(0, 3, 60_000, "u1").tobytes()):
        assert tiff.unpack(lzw(raw), tiff.LZW, len(raw)) == raw
    # 7 7 7 8 8 7 7 6 6 as codes clear, 7, 258, 8, 8, 258, 6, 6, end, packed by hand
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)) + "0" * 7
    assert tiff.unpack(int(bits, 2).to_bytes(11, "big"), tiff.LZW, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_one_file_is_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(9)
    pages = rng.integers(0, 60_000, (1000, 6, 5)).astype("u2")
    data = stack(pages, method=8, strip=2)
    (tmp_path / "a video.tif").write_bytes(data)
    (tmp_path / "b.tif").write_bytes(stack(pages[:1].astype("f4"), big=True))
    assert tiff.page_ranges(spark, str(tmp_path / "*.tif")).count() == 64
    got = tiff.read_tiff(spark, str(tmp_path / "*.tif"), tasks=16).withColumn("task", F.spark_partition_id()).toPandas()
    long = got[got["h"].eq(6) & got["path"].str.contains("a video")].sort_values("t")
    assert long["task"].nunique() == 16 and long["task"].value_counts().max() <= 6 * tiff.PAGES
    assert long["t"].tolist() == list(range(1000)) and len(got) == 1001
    assert (np.stack(long["v"]) == np.stack([p.ravel() for p in tiff.tiff_pages(data)])).all()
    turned = tiff.read_tiff(spark, str(tmp_path / "b.tif"), rotate=1).first()
    assert (turned["h"], turned["w"]) == (5, 6) and turned["v"] == np.rot90(pages[0]).ravel().tolist()


def test_broken_stacks_are_refused_without_cost():
    import tracemalloc

    rng, tried = random.Random(3), 0
    good = [stack(np.arange(600, dtype="u2").reshape(2, 20, 15), **layout) for layout in LAYOUTS]
    tracemalloc.start()
    for k in range(800):
        data = bytearray(good[k % len(good)])
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(2, len(data))] = rng.randrange(256)
        try:
            tried += len(list(tiff.tiff_pages(bytes(data)[: rng.choice([len(data), rng.randrange(len(data))])])))
        except ValueError:
            pass
    assert tried and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    loop = bytearray(stack(np.zeros((1, 2, 2), "u1")))
    loop[-4:] = loop[4:8]
    for data in (b"", b"II", b"no image", bytes(loop)):
        with pytest.raises(ValueError):
            list(tiff.tiff_pages(data))
