"""ISO media containers as columns: walk nested boxes, decode sample tables, never the payload.

``media_columns`` reads any table of container bytes. ``text_media`` stores texts as containers of
8-bit samples first, which makes a lossless round trip over a table of texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
#: Samples from one keyframe to the next, and samples in a chunk, of the containers written here.
KEY_EVERY, CHUNK = 16, 8
RATE = 8000
#: Fixed values of the format: boxes that hold boxes.
NESTED = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"dinf"])
TRACK_SCHEMA = (
    "codec string, handler string, timescale long, duration long, n_samples long, n_keyframes long, "
    "payload_bytes long, keyframes array<struct<offset: long, length: long>>"
)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def write_container(payload: bytes) -> bytes:
    """A container with one track of ``UNIT``-byte samples; the payload must be a multiple of that."""
    n = len(payload) // UNIT
    full_chunks, rest = divmod(n, CHUNK)
    runs = [(1, CHUNK, 1)] if full_chunks else []
    if rest:
        runs.append((full_chunks + 1, rest, 1))
    chunks = full_chunks + bool(rest)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
        wide = chunks and places[-1] >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * UNIT, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n * UNIT), bytes(80))
        return _box(b"moov", mvhd, _box(b"trak", _box(b"mdia", mdhd, hdlr, _box(b"minf", stbl))))

    first = len(head) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(first) + _box(b"mdat", payload)


def boxes(data: memoryview) -> Iterator[tuple[bytes, bool, int, int, int]]:
    """Kind, whether inside a track, start, body start and body end of every box, outer boxes first.

    A level stops at a broken size. Boxes may be nested to any depth.
    """
    open_levels = [(0, len(data), False)]
    while open_levels:
        start, end, inside = open_levels.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        inside_own = inside or kind == b"trak"
        yield kind, inside_own, start, start + head, start + size
        if start + size < end:
            open_levels.append((start + size, end, inside))
        if kind in NESTED:
            open_levels.append((start + head, start + size, inside_own))


def _table(data: memoryview, at: int, end: int, dtype: str, columns: int, skip: int = 8) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + skip - 4)[0]
    n = min(n, (end - at - skip) // (np.dtype(dtype).itemsize * columns))
    return np.frombuffer(data, dtype, n * columns, at + skip).astype(np.int64).reshape(n, columns)


class Samples:
    """How many more samples a file may claim without a table entry for each: as many as it has bytes, in all its tracks and fragments."""

    def __init__(self, left: int) -> None:
        self.left = left

    def take(self, n: int) -> int:
        n = min(n, self.left)
        self.left -= n
        return n


def _sizes(data: memoryview, at: int, end: int, kind: bytes, samples: Samples) -> np.ndarray:
    """Sample sizes of a plain or a compact table."""
    fixed, n = struct.unpack_from(">II", data, at + 4)
    if kind == b"stsz":
        return np.full(samples.take(n), fixed, np.int64) if fixed else _table(data, at, end, ">u4", 1, 12)[:, 0]
    bits = fixed & 255
    raw = np.frombuffer(data, np.uint8, min(-(-n * bits // 8), end - at - 12), at + 12)
    if bits == 4:
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return raw[: len(raw) // 2 * 2].view(">u2").astype(np.int64) if bits == 16 else raw.astype(np.int64)


#: Fixed values of the format: flags of fragment boxes.
_BASE, _ENTRY, _DURATION, _SIZE, _FLAGS = 1, 2, 8, 16, 32
_RUN_OFFSET, _RUN_FIRST, _RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT = 1, 4, 256, 512, 1024, 2048
_NOT_SYNC = 0x10000


def _optional(data: memoryview, at: int, flags: int, fields: tuple[tuple[int, str], ...]) -> tuple[dict, int]:
    """The fields whose flags are set, in order, and where they end."""
    out = {}
    for flag, kind in fields:
        if flags & flag:
            (out[flag],) = struct.unpack_from(kind, data, at)
            at += struct.calcsize(kind)
    return out, at


def _run(data: memoryview, at: int, end: int, f: dict, samples: Samples) -> None:
    """Append the samples of one run of a fragment to its track."""
    flags, n = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    head, at = _optional(data, at + 8, flags, ((_RUN_OFFSET, ">i"), (_RUN_FIRST, ">I")))
    names = [x for x in (_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT) if flags & x]
    n = min(n, (end - at) // (4 * len(names))) if names else samples.take(n)
    rows = np.frombuffer(data, ">u4", n * len(names), at).reshape(n, len(names)).astype(np.int64)

    def column(name: int, default: int) -> np.ndarray:
        return rows[:, names.index(name)] if name in names else np.full(n, default, np.int64)

    sizes, marks = column(_RUN_SIZE, f["size"]), column(_RUN_FLAGS, f["flags"]).copy()
    if n and _RUN_FIRST in head:
        marks[0] = head[_RUN_FIRST]
    start = f["base"] + head[_RUN_OFFSET] if _RUN_OFFSET in head else f["next"]
    f["next"] = start + int(sizes.sum())
    t = f["track"]
    t["more"].append((start + np.cumsum(sizes) - sizes, sizes, (marks & _NOT_SYNC) == 0, int(column(_RUN_DURATION, f["duration"]).sum())))


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, duration and sample places, from its tables and fragments alone.

    ``offsets`` and ``sizes`` have an entry for each sample, ``keys`` the numbers of sync samples
    from 0 (all samples where the track has no sync table). Samples that have no entry of their own in
    a table (all of one size, or runs without fields) are no more than the file's bytes over all
    tracks and fragments together, so time and memory stay in proportion to the file's size.
    """
    view, found, known, extends, fragment = memoryview(data), [], {}, {}, None
    moof, samples = 0, Samples(len(data))
    for kind, inside, start, at, end in boxes(view):
        if kind == b"trak":
            found.append({"codec": None, "handler": None, "timescale": 0, "duration": 0, "more": []})
        elif kind == b"trex":
            number, _, duration, size, flags = struct.unpack_from(">5I", view, at + 4)
            extends[number] = (duration, size, flags)
        elif kind == b"moof":
            moof = start
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", view, at)
            got, _ = _optional(view, at + 8, flags, ((_BASE, ">Q"), (_ENTRY, ">I"), (_DURATION, ">I"), (_SIZE, ">I"), (_FLAGS, ">I")))
            duration, size, marks = extends.get(number, (0, 0, 0))
            base = got.get(_BASE, moof)
            fragment = {"track": known.get(number), "base": base, "next": base}
            fragment |= {"duration": got.get(_DURATION, duration), "size": got.get(_SIZE, size), "flags": got.get(_FLAGS, marks)}
        elif kind == b"trun" and fragment and fragment["track"] is not None:
            _run(view, at, end, fragment, samples)
        if not inside:
            continue
        t = found[-1]
        if kind == b"tkhd":
            (number,) = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))
            known[number] = t
        elif kind == b"mdhd":
            wide = view[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", view, at + (20 if wide else 12))
        elif kind == b"hdlr":
            t["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and end - at >= 16:
            t["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stsc":
            t["runs"] = _table(view, at, end, ">u4", 3)
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(view, at, end, kind, samples)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(view, at, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
        elif kind == b"stss":
            t["keys"] = _table(view, at, end, ">u4", 1)[:, 0] - 1
    for t in found:
        _place(t)
    return found


def _place(t: dict) -> None:
    """Offsets of the samples from the tables of chunks, then the samples of fragments."""
    sizes = t.pop("sizes", np.zeros(0, np.int64))
    runs, chunks = t.pop("runs", np.zeros((0, 3), np.int64)), t.pop("chunks", np.zeros(0, np.int64))
    keys = t.pop("keys", None)
    # runs start at ascending chunks; one that doesn't starts where the one before it does
    run = np.searchsorted(np.maximum.accumulate(runs[:, 0]), np.arange(1, len(chunks) + 1), "right") - 1
    per_chunk = np.where(run >= 0, np.minimum(runs[run, 1], len(sizes)), 0) if len(runs) else np.zeros(len(chunks), np.int64)
    filled = np.minimum(np.cumsum(per_chunk), len(sizes))  # samples up to the end of each chunk
    of_chunk = np.repeat(np.arange(len(chunks)), np.diff(filled, prepend=0))
    sizes = sizes[: len(of_chunk)]
    before = np.cumsum(sizes) - sizes
    starts = np.concatenate([[0], filled])[:-1][of_chunk] if len(of_chunk) else of_chunk
    offsets = chunks[of_chunk] + before - before[starts] if len(sizes) else before
    keys = np.arange(len(sizes)) if keys is None else keys[(keys >= 0) & (keys < len(sizes))]
    parts = [(offsets, sizes, keys)]
    n = len(sizes)
    for more, own, sync, duration in t.pop("more"):
        parts.append((more, own, np.flatnonzero(sync) + n))
        n += len(own)
        t["duration"] += duration
    t["offsets"], t["sizes"], t["keys"] = (np.concatenate(p) for p in zip(*parts, strict=True))


def _row(t: dict) -> dict:
    return {
        "codec": t["codec"],
        "handler": t["handler"],
        "timescale": t["timescale"],
        "duration": t["duration"],
        "n_samples": len(t["sizes"]),
        "n_keyframes": len(t["keys"]),
        "payload_bytes": int(t["sizes"].sum()),
        "keyframes": [{"offset": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["keys"]],
    }


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id, track, codec, ...``: one row per track of every container in ``media_col``.

    Null, empty or broken bytes and containers without tracks give one row with a null track, so no
    input row is lost. Long payloads are passed over, not read. Repeated rows give repeated results,
    an empty table gives no rows; other columns, whatever their names, are ignored.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TRACK_SCHEMA.split(", ") if ":" not in c] + ["keyframes"]
        for batch in batches:
            rows = []
            for key, data in zip(batch["id"], batch["media"], strict=True):
                try:
                    found = tracks(data) if data else []
                except (struct.error, ValueError, IndexError, OverflowError):
                    found = []
                rows += [{"id": key, "track": k, **_row(t)} for k, t in enumerate(found)] or [{"id": key}]
            yield pd.DataFrame(rows, columns=["id", "track", *dict.fromkeys(names)]).astype(object).where(lambda x: x.notna(), None)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(walk, f"id {kind}, track int, {TRACK_SCHEMA}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its bytes with spaces up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


RESULT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, duration_s double, n_samples long, n_keyframes long, "
    "keyframes array<struct<offset: long, length: long>>"
)


def _digest(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = write_container(payload)
    (t,) = tracks(media)
    view, starts = memoryview(media), t["offsets"]
    joined = np.flatnonzero(starts[1:] != starts[:-1] + t["sizes"][:-1])
    first, last = np.concatenate([[0], joined + 1]), np.concatenate([joined, [len(starts) - 1]])
    back = b"".join(view[starts[a] : starts[b] + t["sizes"][b]] for a, b in zip(first, last, strict=True))
    row = _row(t)
    ranges = np.stack([starts[t["keys"]], t["sizes"][t["keys"]]], 1).astype(">i8").tobytes()
    seconds = t["duration"] / t["timescale"]
    feature = f"{t['codec'].strip()};{seconds:.3f}s;samples={len(starts)};keys={len(t['keys'])};ranges={zlib.crc32(ranges):08x}"
    return (
        n,
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-16:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        feature,
        row["codec"].strip(),
        seconds,
        row["n_samples"],
        row["n_keyframes"],
        row["keyframes"],
    )


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text through a container: sizes and digests, and what its tables say.

    Codec, duration and the byte ranges of keyframes are decoded from the stored bytes; ``feature``
    names them in one string, with a checksum of the ranges. Null and empty texts are one unit of
    spaces; texts are stored whole, however long. Repeated rows give repeated results, null ids stay
    null, an empty table gives no rows, and other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ") if ":" not in c] + ["keyframes"]
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.iloc[k : k + 512]
                out = pd.DataFrame([_digest(x) for x in part["text"]], columns=list(dict.fromkeys(names))[1:])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, RESULT)
