"""MAT files written here and read back, in either nesting, compressed or not, and broken ones."""

import random
import struct

import numpy as np
import pytest

from voxelmill.sources import mat


@pytest.mark.parametrize("compress", [False, True])
def test_leaves_of_nested_arrays(compress):
    x, y = np.arange(6.0).reshape(2, 3), np.array([[7, -8]], "i2")
    data = mat.mat_bytes({"a": x, "c": [y, [x, np.zeros((0, 0))], {"f": np.uint8([[3]]), "long_field": y}], "e": []}, compress)
    got = [(n, k, place, dims, v.tolist()) for n, k, place, dims, _, v in mat.leaves(data)]
    column = x.ravel(order="F").tolist()
    assert got == [
        ("a", 0, [], [2, 3], column), ("c", 0, ["0"], [1, 2], [7, -8]), ("c", 1, ["1", "0"], [2, 3], column), ("c", 2, ["1", "1"], [0, 0], []),
        ("c", 3, ["2", "0.f"], [1, 1], [3]), ("c", 4, ["2", "0.long_field"], [1, 2], [7, -8]),
    ]


def test_sparse_arrays_and_the_other_byte_order():
    def tag(kind, raw, order):
        return struct.pack(f"{order}II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)

    for order, mark in (("<", b"IM"), (">", b"MI")):
        body = tag(6, struct.pack(f"{order}II", mat.SPARSE, 3), order) + tag(5, struct.pack(f"{order}ii", 4, 3), order) + tag(1, b"s", order)
        body += tag(5, struct.pack(f"{order}3i", 1, 3, 0), order) + tag(5, struct.pack(f"{order}4i", 0, 2, 2, 3), order) + tag(9, struct.pack(f"{order}3d", 5, 6, 7), order)
        data = b"x" * 124 + struct.pack(f"{order}H", 0x100) + mark + tag(mat.MATRIX, body, order)
        ((name, _, place, dims, at, v),) = mat.leaves(data)
        assert (name, place, dims, at.tolist(), v.tolist()) == ("s", [], [4, 3], [1, 3, 8], [5, 6, 7])


def test_broken_files_are_refused_without_cost():
    import tracemalloc

    good = mat.mat_bytes({"masks": [[np.arange(4.0), np.arange(4.0)] for _ in range(20)]})
    rng = random.Random(5)
    tracemalloc.start()
    for k in range(300):
        data = bytes(rng.randrange(256) if i >= 128 and rng.random() < 0.01 else x for i, x in enumerate(good)) if k else good[:-9]
        try:
            list(mat.leaves(data))
        except (ValueError, IndexError):
            pass
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    deep = np.zeros(1)
    for _ in range(200):
        deep = [deep]
    for data in (b"", b"x" * 200, mat.mat_bytes({"d": deep})):
        with pytest.raises(ValueError):
            list(mat.leaves(data))


def test_masks_and_activity_from_files(spark, tmp_path):
    rng, h, w = np.random.default_rng(2), 6, 9
    coords = [(rng.integers(0, h, (1, n)).astype(float), rng.integers(0, w, (1, n)).astype(float)) for n in (4, 1, 0, 7)]
    flat = [[x, y] for x, y in coords]
    nested = [[{"pair": [x, y]}] for x, y in coords]
    volume = (rng.random((h, w, 3)) < 0.3).astype(np.uint8)
    pulses = [(rng.random((1, 12)) < 0.4).astype(float) for _ in range(3)]
    (tmp_path / "a.mat").write_bytes(mat.mat_bytes({"masks": flat, "ideal": volume, "pulse": pulses}))
    (tmp_path / "b.mat").write_bytes(mat.mat_bytes({"masks": [nested]}, compress=True))
    arrays = mat.read_mat(spark, str(tmp_path / "*.mat")).cache()
    want = {(k, int(a) * w + int(b)) for k, (x, y) in enumerate(coords) for a, b in zip(x[0], y[0])}
    for file in ("a.mat", "b.mat"):
        got = mat.masks(arrays.where(f"path like '%{file}'"), w).collect()
        assert {(r["mask_id"], r["pixel"]) for r in got} == want and len(got) == len(want)
    got = mat.volume_masks(arrays, "ideal").collect()
    assert {(r["mask_id"], r["pixel"]) for r in got} == {(int(n), int(y * w + x)) for y, x, n in np.argwhere(volume)} and len(got) == volume.sum()
    got = mat.cell_activity(arrays, "pulse").collect()
    assert {(r["mask_id"], r["t"]) for r in got} == {(k, int(t)) for k, p in enumerate(pulses) for t in np.flatnonzero(p[0])}
