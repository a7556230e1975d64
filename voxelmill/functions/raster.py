"""Numpy kernels on single frames and masks: components, morphology, contours."""

from __future__ import annotations

import numpy as np


def label_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reached from each of n points by the links a-b."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def components(on: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Flat indices of set pixels in raster order, and for each the first pixel of its component."""
    flat = np.flatnonzero(on)
    place = np.full(on.shape, -1)
    place.ravel()[flat] = np.arange(len(flat))
    pairs = [(place[:-1], place[1:]), (place[:, :-1], place[:, 1:])]
    if diagonal:
        pairs += [(place[:-1, :-1], place[1:, 1:]), (place[:-1, 1:], place[1:, :-1])]
    a = np.concatenate([x[(x >= 0) & (y >= 0)] for x, y in pairs])
    b = np.concatenate([y[(x >= 0) & (y >= 0)] for x, y in pairs])
    return flat, flat[label_edges(len(flat), a, b)] if len(flat) else flat


def ellipse(size: int) -> np.ndarray:
    """An elliptical structuring element of ``size`` by ``size``."""
    r = size // 2
    rows = np.arange(size) - r
    out = np.zeros((size, size), bool)
    for k, dy in enumerate(rows):
        if r and abs(dy) <= r:
            dx = int(round(r * np.sqrt(max(r * r - dy * dy, 0) / (r * r))))
            out[k, max(r - dx, 0) : min(r + dx + 1, size)] = True
        elif not r:
            out[k] = True
    return out


def disk(radius: float) -> list[tuple[int, int]]:
    """Offsets within a radius."""
    r = int(radius)
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= radius * radius]


def _reduce(x: np.ndarray, kernel: np.ndarray, outside, best) -> np.ndarray:
    r = kernel.shape[0] // 2
    padded = np.pad(x, r, constant_values=outside)
    out = np.full(x.shape, outside, x.dtype)
    for dy, dx in zip(*np.nonzero(kernel), strict=True):
        out = best(out, padded[dy : dy + x.shape[0], dx : dx + x.shape[1]])
    return out


def dilate(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Greatest value under the kernel; pixels outside the image don't count."""
    return _reduce(x, kernel[::-1, ::-1], 0, np.maximum)


def erode(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Least value under the kernel; pixels outside the image don't count."""
    return _reduce(x, kernel, np.iinfo(x.dtype).max, np.minimum)


def close(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return erode(dilate(x, kernel), kernel)


def opening(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return dilate(erode(x, kernel), kernel)


#: Clockwise neighbours in image coordinates (row, column), from east.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outline(on: np.ndarray) -> np.ndarray:
    """Border pixels of one 8-connected shape in walking order (Moore tracing from its first pixel)."""
    start = tuple(int(k) for k in np.argwhere(on)[0])

    def is_set(p):
        return 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p]

    def step(p, came):
        for k in range(1, 9):
            d = (came + k) % 8
            q = (p[0] + AROUND[d][0], p[1] + AROUND[d][1])
            if is_set(q):
                return q, d
        return None, 0

    p, d = step(start, 4)
    if p is None:
        return np.array([start])
    first, points = (p, d), [start]
    while True:
        points.append(p)
        q, e = step(p, (d + 4) % 8)
        if p == start and (q, e) == first:
            return np.array(points[:-1])
        p, d = q, e


def fill(on: np.ndarray) -> np.ndarray:
    """A shape with its holes filled: what the outside, 4-connected, doesn't reach."""
    padded = np.pad(~on, 1, constant_values=True)
    flat, first = components(padded)
    outside = np.zeros(padded.size, bool)
    outside[flat[first == 0]] = True
    return ~outside.reshape(padded.shape)[1:-1, 1:-1]


def polygon_area(p: np.ndarray) -> float:
    y, x = p[:, 0].astype(float), p[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def polygon_length(p: np.ndarray) -> float:
    return float(np.sqrt(((p - np.roll(p, -1, 0)) ** 2).sum(1)).sum())


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise."""
    pts = sorted(map(tuple, np.unique(p, axis=0)))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def least_rectangle(p: np.ndarray) -> tuple[float, float]:
    """Sides of the smallest rectangle, at any angle, around points."""
    q = hull(p)
    if len(q) < 2:
        return 0.0, 0.0
    edges = np.roll(q, -1, 0) - q
    edges = edges[np.abs(edges).sum(1) > 0] / np.sqrt((edges[np.abs(edges).sum(1) > 0] ** 2).sum(1, keepdims=True))
    sides = [(np.ptp(q @ e), np.ptp(q @ np.array([-e[1], e[0]]))) for e in edges]
    return min(sides, key=lambda s: s[0] * s[1])


def is_compact(points: np.ndarray, bounds: tuple[float, float, float, float]) -> bool:
    """Form factor and aspect ratio of an outline within open bounds; shapes without area are not."""
    area, length = polygon_area(points), polygon_length(points)
    if not area or not length:
        return False
    a, b = sorted(least_rectangle(points))
    form, aspect = 4 * np.pi * area / length**2, (b / a if a else np.inf)
    return bool(bounds[0] < form < bounds[1] and bounds[2] < aspect < bounds[3])
