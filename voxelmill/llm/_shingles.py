"""Word shingles of whole texts as 64-bit digests, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once, unless a single word is longer.
PIECE = 1 << 20
_ODD, _INVERSE_BITS = 0x9E3779B97F4A7C15, 64
_Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BYTE = mix(_LOWER + np.uint64(_ODD))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, PIECE + 1)
        base, inverse = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << _INVERSE_BITS))
        for name, b in (("up", base), ("down", inverse)):
            steps = np.full(size, b)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of the words at the given places: a polynomial over bytes, shifted to start at power 0."""
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digest and start of each word of ASCII-lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(raw) <= PIECE:
        return _hash_piece(raw, starts, ends), starts
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        at = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        out[k:stop] = _hash_piece(raw[at : ends[stop - 1]], starts[k:stop] - at, ends[k:stop] - at)
        k = stop
    return out, starts


def shingles(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct digests of its ``width``-word shingles.

    A text of fewer words has its whole sequence as one; a null text or one without words has none.
    """
    batch: list[bytes] = []
    held = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if batch and held + len(raw) > PIECE:
            yield from _shingles(batch, width)
            batch, held = [], 0
        batch.append(raw)
        held += len(raw) + 1
    if batch:
        yield from _shingles(batch, width)


def _shingles(batch: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, starts = word_hashes(b"\n".join(batch))
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in batch])])
    bounds = np.searchsorted(starts, first)
    n = len(words) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    power = np.array([pow(_Q, j, 1 << 64) for j in range(width)], np.uint64)
    for j in range(width if n > 0 else 0):
        total += words[j : j + n] * power[j]
    total = mix(total + np.uint64(width))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(total[a : b - width + 1])
        elif b > a:
            whole = (words[a:b] * power[: b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mix(whole + np.array([b - a], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
