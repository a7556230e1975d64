"""Numpy kernels against brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelmill.functions import raster
from voxelmill.operators.evaluate import assign
from voxelmill.operators.merge import GONE, _fold
from voxelmill.sources import tiff, volumes


def flood(on, diagonal):
    h, w = on.shape
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    label = {}
    for p in np.argwhere(on):
        p = tuple(p)
        if p in label:
            continue
        stack, label[p] = [p], p
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                q = (y + dy, x + dx)
                if 0 <= q[0] < h and 0 <= q[1] < w and on[q] and q not in label:
                    label[q] = p
                    stack.append(q)
    return {y * w + x: a * w + b for (y, x), (a, b) in label.items()}


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(diagonal):
    rng = np.random.default_rng(1)
    for _ in range(60):
        on = rng.random((9, 7)) < rng.random()
        flat, first = raster.components(on, diagonal)
        assert dict(zip(flat.tolist(), first.tolist(), strict=True)) == flood(on, diagonal)


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(80):
        n, m = sorted(rng.integers(1, 6, 2).tolist())
        cost = rng.random((n, m)).round(1)
        cols = assign(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(cols)) == n and np.isclose(cost[np.arange(n), cols].sum(), best)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=48, max_size=48))
def test_morphology_is_ordered(bits):
    x = np.array(bits, np.uint8).reshape(6, 8)
    k = raster.ellipse(3)
    assert (raster.erode(x, k) <= x).all() and (x <= raster.dilate(x, k)).all()
    assert (raster.opening(x, k) <= x).all() and (x <= raster.close(x, k)).all()
    assert (raster.fill(x > 0) >= (x > 0)).all()


def test_shapes():
    square = np.zeros((9, 9), bool)
    square[2:7, 2:7] = True
    p = raster.outline(square)
    assert len(p) == 16 and raster.polygon_area(p) == 16 and raster.polygon_length(p) == 16
    assert sorted(raster.least_rectangle(p)) == [4, 4] and raster.is_compact(p, (0.5, 1.2, 0.5, 2))
    line = np.zeros((9, 9), bool)
    line[4, 1:8] = True
    assert not raster.is_compact(raster.outline(line), (0, 9, 0, 99))
    assert raster.ellipse(3).sum() == 5 and len(raster.disk(2.5)) == 21


def plain_fold(n, metric, area, limit, threshold):
    group = [-1] * n
    for i in range(n):
        for j in range(n):
            if i == j or metric[i, j] < threshold:
                continue
            if area[i] != area[j] and max(area[i], area[j]) > limit:
                group[i if area[i] > area[j] else j] = -2
            elif group[i] == group[j] == -1:
                group[i] = group[j] = i
            elif -1 in (group[i], group[j]):
                group[i] = group[j] = max(group[i], group[j]) if -2 not in (group[i], group[j]) else -2
            else:
                group = [group[i] if g == group[j] else g for g in group] if group[i] != group[j] else group
    return [k if g == -1 else g for k, g in enumerate(group)]


def test_containment_fold():
    import pandas as pd

    rng = np.random.default_rng(4)
    for _ in range(200):
        n = 6
        metric, area = rng.random((n, n)).round(1), rng.integers(1, 4, n)
        rows = [(i, j, area[i], area[j]) for i in range(n) for j in range(n) if i != j and metric[i, j] >= 0.8]
        got = {k: k for k in range(n)}
        if rows:
            size, labels = int(rng.integers(1, len(rows) + 1)), {}
            for k in range(0, len(rows), size):  # slices of the pairs, with the labels of their masks
                pairs = pd.DataFrame(rows[k : k + size], columns=["i", "j", "area_i", "area_j"]).assign(group=0)
                met = [m for m in {*pairs["i"], *pairs["j"]} if m in labels]
                out = _fold(2)(pairs, pd.DataFrame({"mask_id": met, "label": [labels[m] for m in met]}))
                moved = {int(r.key): int(r.label) for r in out.itertuples() if r.renamed}
                labels = {m: moved.get(x, x) for m, x in labels.items()} | {int(r.key): int(r.label) for r in out.itertuples() if not r.renamed}
            got |= {m: -2 if x == GONE else x for m, x in labels.items()}
        assert [got[k] for k in range(n)] == plain_fold(n, metric, area, 2, 0.8)


def test_volume_files_round_trip(tmp_path):
    rng = np.random.default_rng(5)
    for kind in ("u1", "u2", "f4"):
        x = (rng.random((3, 5, 7)) * 200).astype(kind)
        assert all((a == b).all() for a, b in zip(tiff.tiff_pages(tiff.tiff_bytes(x)), x, strict=True))
    x = (rng.random((5, 7, 3)) * 100).astype("i2")
    got = list(volumes.nifti_frames(volumes.nifti_bytes(x)))
    assert len(got) == 3 and all((g == x[:, :, k]).all() for k, g in enumerate(got))
    with pytest.raises(ValueError):
        list(tiff.tiff_pages(b"no image"))
