"""Numpy kernels on lists of masks at pixels: lists are dealt to tasks, and a task adds up its pairs of masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: What one task is sent at once: lists of lengths ``n_i`` and ``n_j``, in order of ids. Members of ``i`` with values ``x``
#: meet those of ``j`` (``y``) that have higher ids.
PARTS = ("n_i", "n_j", "i", "x", "j", "y")
SENT = ", ".join(["task int", *[f"{c} binary" for c in PARTS]])
#: Ids that are cut or pairs of rows that are multiplied at once, and rows of a batch.
AT_ONCE, ROWS = 2_000_000, 200_000

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All whole numbers from each start to its stop, one range after another."""
    n = stop - start
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(start - ends + n, n)


def borders(ids: np.ndarray, weights: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids that cut weighted ones to groups of about ``most``, and the number of tasks for each group, more where one id exceeds it."""
    order = np.argsort(ids, kind="stable")
    ids, sums = ids[order], np.cumsum(weights[order])
    groups = max(1, int(np.ceil(sums[-1] / most))) if len(ids) else 1
    cuts = np.unique(ids[np.searchsorted(sums, np.arange(1, groups) * sums[-1] / groups)]) if groups > 1 else ids[:0]
    held = np.bincount(np.searchsorted(cuts, ids, "right"), weights[order], len(cuts) + 1)
    return cuts, np.maximum(1, (held / (2 * most)).round().astype(np.int64))


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as their range needs, others as they are; bytes of one place together."""
    low = 0
    with np.errstate(invalid="ignore"):
        whole = v.astype(np.int64)
    if (whole == v).all():
        low = int(whole.min())
        v = (whole - low).astype(np.min_scalar_type(int(whole.max()) - low))
    return v.dtype.char.encode() + low.to_bytes(8, "little", signed=True) + v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    kind, low = np.dtype(chr(data[0])), int.from_bytes(data[1:9], "little", signed=True)
    v = np.frombuffer(data, np.uint8, offset=9).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()
    return v if kind.kind == "f" else v.astype(np.int64) + low


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _ranks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as small numbers in their order, and the id of each number; sorted only if they lie far apart."""
    low, span = int(v.min()), int(v.max()) - int(v.min()) + 1
    if span <= 4 * len(v):
        return v - low, np.arange(low, low + span)
    ids, rank = np.unique(v, return_inverse=True)
    return rank, ids


def _above(i: np.ndarray, row_i: np.ndarray, j: np.ndarray, row_j: np.ndarray, size: int) -> np.ndarray:
    """For each rank i, where the ranks above it begin in the list of j of its row."""
    return np.searchsorted(row_j * size + j, row_i * size + i, "right")


def _dealt(i: np.ndarray, x: np.ndarray, at: np.ndarray, other: tuple | None, cuts: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The lists ``i[at[k]:at[k + 1]]`` to tasks, with the ``other`` lists ``(j, y, at)`` that they meet, themselves if None.

    A group's members in a list go together, so their task gets the rest of the list once and not once for each. Of a group
    of several tasks each gets a share of the others.
    """
    j, y, at_j = other or (i, x, at)
    row, group, rows = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.searchsorted(cuts, i, "right"), np.arange(len(at) - 1)
    begin = _heads(row, group)
    end, stop = np.append(begin[1:], len(i)), at_j[row[begin] + 1]
    if other:
        rank, ids = _ranks(np.concatenate([i[begin], j]))
        low = _above(rank[: len(begin)], row[begin], rank[len(begin) :], np.repeat(rows, np.diff(at_j)), len(ids))
    else:
        low = begin + 1
    some = stop > low
    begin, end, low, stop, group = begin[some], end[some], low[some], stop[some], group[begin[some]]
    done, k = _ends(stop - low), 0
    while k < len(begin):
        to = max(k + 1, int(np.searchsorted(done, done[k] + AT_ONCE)))
        runs = k + np.argsort(group[k:to], kind="stable")
        others, n_j, k = ranges(low[runs], stop[runs]), stop[runs] - low[runs], to
        task, each = first[group[runs]], first[group[runs] + 1] - first[group[runs]]
        if (each > 1).any():
            run, task, each = (np.repeat(v, n_j) for v in (np.arange(len(runs)), task, each))
            task = task + (j[others].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % each
            order = np.lexsort((run, task))
            others, run, task = others[order], run[order], task[order]
            head = _heads(run, task)
            runs, task, n_j = runs[run[head]], task[head], np.diff(np.append(head, len(others)))
        n_i, members = end[runs] - begin[runs], ranges(begin[runs], end[runs])
        parts = dict(zip(PARTS, (n_i, n_j, i[members], x[members], j[others], y[others]), strict=True))
        cut = np.append(_heads(task), len(task))
        at_i, at_others = _ends(n_i)[cut], _ends(n_j)[cut]
        where = dict(zip(PARTS, (cut, cut, at_i, at_i, at_others, at_others), strict=True))
        sent = {c: [packed(parts[c][a:b]) for a, b in zip(where[c][:-1], where[c][1:], strict=True)] for c in PARTS}
        yield pa.RecordBatch.from_pydict({"task": pa.array(task[cut[:-1]].astype(np.int32))} | {c: pa.array(v, pa.binary()) for c, v in sent.items()})


def _column(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b[name].to_numpy(zero_copy_only=False) for b in batches])


def own_lists(cuts: np.ndarray, shares: np.ndarray) -> Kernel:
    """Rows ``pixel, j, y``, and ``part`` if pixels have parts, each list whole in one partition, as ``SENT``."""
    first = _ends(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if len(batch)]
        if rows:
            keys = [_column(rows, c) for c in ("pixel", "part") if c in rows[0].schema.names]
            j, y = _column(rows, "j"), _column(rows, "y")
            order = np.lexsort((j, *keys))
            yield from _dealt(j[order], y[order], np.append(_heads(*[k[order] for k in keys]), len(j)), None, cuts, first)

    return run


def crossed_lists(cuts: np.ndarray, shares: np.ndarray) -> Kernel:
    """Rows ``i, x, j, y`` of lists that meet each other, as ``SENT``."""
    first = _ends(shares)

    def lists(batch: pa.RecordBatch, ids: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch[ids].value_lengths().to_numpy(zero_copy_only=False)
        return *(batch[c].flatten().to_numpy(zero_copy_only=False) for c in (ids, values)), _ends(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from _dealt(*lists(batch, "i", "x"), lists(batch, "j", "y"), cuts, first)

    return run


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values."""
    low, span = int(key.min()), int(key.max()) - int(key.min()) + 1
    if span <= 4 * len(key):
        found = np.flatnonzero(np.bincount(key - low, minlength=span))
        return found + low, np.bincount(key - low, value, span)[found]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = _heads(key)
    return key[head], np.add.reduceat(value[order], head)


def added_up(both: bool) -> Kernel:
    """``i, j, overlap`` of the pairs that one task was sent, in order of (i, j); if ``both``, each the other way round after that.

    A task is sent all meetings of its pairs. About ``AT_ONCE`` of them are multiplied at once, so besides lists only sums are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = {c: [] for c in PARTS}
        for batch in batches:
            for c in PARTS:
                sent[c] += [unpacked(v) for v in batch[c].to_pylist()]
        if not sent["i"]:
            return
        n_i, n_j, i, x, j, y = (np.concatenate(sent.pop(c)) for c in PARTS)
        rows, at = np.arange(len(n_j)), _ends(n_j)
        rank, ids = _ranks(np.concatenate([i, j]))
        size, x, y = len(ids), x.astype(np.float64), y.astype(np.float64)
        i, j, row = rank[: len(i)], rank[len(i) :], np.repeat(rows, n_i)
        begin, end = _above(i, row, j, np.repeat(rows, n_j), size), at[row + 1]
        order = np.argsort(i, kind="stable")
        i, x, begin, end = i[order], x[order], begin[order], end[order]
        done, found, k = _ends(end - begin), [], 0
        while k < len(i) and done[k] < done[-1]:
            to = max(k + 1, int(np.searchsorted(done, done[k] + AT_ONCE)))
            n, others = end[k:to] - begin[k:to], ranges(begin[k:to], end[k:to])
            if len(others):
                found.append(_sums(np.repeat(i[k:to] * size, n) + j[others], np.repeat(x[k:to], n) * y[others]))
            k = to
        if not found:
            return
        key, overlap = (np.concatenate(c) for c in zip(*found, strict=True))
        if (key[1:] <= key[:-1]).any():  # a mask's meetings were cut
            key, overlap = _sums(key, overlap)
        for way in (("i", "j"), ("j", "i"))[: 1 + both]:
            for k in range(0, len(key), ROWS):
                pair = dict(zip(way, (ids[key[k : k + ROWS] // size], ids[key[k : k + ROWS] % size]), strict=True))
                yield pa.RecordBatch.from_pydict({"i": pair["i"], "j": pair["j"], "overlap": overlap[k : k + ROWS]})

    return run
