"""Operators on Spark against serial loops, and their edge cases."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import meetings, raster
from voxelmill.functions.graph import connected, greedy_seeds
from voxelmill.functions.tables import Tables
from voxelmill.jobs import footprints
from voxelmill.operators import evaluate, filters, merge, morph, overlap, pairs, pre, segment, tile, traces
from voxelmill.sources import tiff, volumes
from voxelmill.streaming import activity


def masks_of(spark, rows):
    return spark.createDataFrame([(i, p, float(v)) for i, p, v in rows], "mask_id long, pixel long, val double")


def vox_of(spark, x):
    t, h, w = x.shape
    return spark.createDataFrame([(k, p, float(v)) for k in range(t) for p, v in enumerate(x[k].ravel())], "t long, pixel long, v double")


def test_seeds_and_components(spark):
    rng = np.random.default_rng(0)
    n = 60
    edges = {tuple(sorted(e)) for e in rng.integers(0, n, (70, 2)).tolist() if e[0] != e[1]}
    near = {k: {a + b - k for a, b in edges if k in (a, b)} for k in range(n)}
    group = {}
    for k in range(n):
        if k not in group:
            group |= {m: k for m in near[k] | {k} if m not in group}
    df, nodes = spark.createDataFrame(list(edges), "i long, j long"), spark.range(n).withColumnRenamed("id", "node")
    tables = Tables(spark)
    for rounds, most in ((4, 500_000), (1, 0), (1, 3), (2, 60)):
        got = greedy_seeds(df, nodes, tables, rounds, most).collect()
        assert {r["node"]: r["group"] for r in got} == group and len(got) == n
    label = {k: k for k in range(n)}
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["group"] for r in connected(df, nodes, tables).collect()} == label


def test_intersections_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    mask = rng.integers(0, 4, (6, 9)) * (rng.random((6, 9)) < 0.6)
    own, other = ([(i, p, x[i, p]) for i, p in np.argwhere(x).tolist()] for x in (mask, mask[::-1]))
    want = {(i, j, p, float(x * y)) for i, p, x in own for j, q, y in own if i < j and p == q}
    assert {tuple(r) for r in pairs.intersections(masks_of(spark, own)).collect()} == want and len({w[:2] for w in want}) > 10
    want = {(i, j, p, float(x * y)) for i, p, x in own for j, q, y in other if p == q}
    assert {tuple(r) for r in pairs.intersections(masks_of(spark, own), masks_of(spark, other)).collect()} == want


def test_crowded_pixels_are_cut_into_blocks(spark, monkeypatch):
    """One pixel that all masks share, one of two masks, and repeated values, against the plain join."""
    rng = np.random.default_rng(31)
    rows = [(i, 7, 1 + i % 3) for i in range(60)] + [(i, int(p), 1) for i in range(60) for p in rng.integers(8, 40, 3)]
    rows = [(i, p, v) for (i, p), v in {(i, p): v for i, p, v in rows}.items()]
    own, other = masks_of(spark, rows), masks_of(spark, [r for r in rows if r[0] % 3])
    want = {(i, j, p, float(x * y)) for i, p, x in rows for j, q, y in rows if i < j and p == q}
    across = {(i, j, p, float(x * y)) for i, p, x in rows for j, q, y in rows if j % 3 and p == q}
    for few in (100, 0):
        monkeypatch.setattr(pairs, "FEW_PIXELS", few)
        for crowd in (1, 7, 1000):
            for right, expected in ((None, want), (other, across)):
                got = pairs._meet(own, right, crowd).selectExpr("i", "j", "pixel", "x * y").collect()
                assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    cells = pairs._meet(own, None, 7).where("pixel = 7").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in cells) == 60 * 59 // 2


def test_proposals(spark):
    rng = np.random.default_rng(1)
    iou = rng.integers(0, 6, (7, 6)) / 5
    edges = [(i, j, float(iou[i, j])) for i in range(7) for j in range(6) if iou[i, j] > 0.2]
    match, closed = {}, set()
    while True:
        offers = {}
        for i in range(7):
            best = [(-v, j) for a, j, v in edges if a == i and j not in closed]
            if i not in match and best:
                offers.setdefault(min(best)[1], []).append((min(best)[0], i))
        if not offers:
            break
        for j, who in offers.items():
            match[min(who)[1]] = j
            closed.add(j)
    for rounds, most in ((4, 500_000), (1, 0), (1, 500_000), (1, 4)):
        got = evaluate.match_greedy(spark.createDataFrame(edges, "i long, j long, iou double"), Tables(spark), rounds, most).collect()
        assert {r["i"]: r["j"] for r in got} == match and len(got) == len(match)


def test_lines_take_few_rounds(spark):
    """A line of 10,000 nodes in ascending order, and 80 proposers who all want the same."""
    n, tables = 10_000, Tables(spark)
    line = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    got = greedy_seeds(line, spark.range(n).withColumnRenamed("id", "node"), tables).collect()
    assert sorted((r["node"], r["group"]) for r in got) == [(k, k - k % 2) for k in range(n)]
    first, tables = tables.written, Tables(spark)
    n = 80
    chain = [(i, j, 1 - j / 100) for i in range(n) for j in range(n)]  # all want the same j, one closes a round
    got = evaluate.match_greedy(spark.createDataFrame(chain, "i long, j long, iou double"), tables).collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(i, i) for i in range(n)]
    assert first < 60 and tables.written < 60


def test_sliding_windows_match_numpy(spark):
    x = np.random.default_rng(2).random((23, 1, 2))
    for width in (1, 4, 5):
        got = pre.sliding(vox_of(spark, x), width, F.avg, chunk=6).toPandas().pivot(index="t", columns="pixel", values="v").to_numpy()
        padded = np.pad(x[:, 0], ((8, 8), (0, 0)), mode="symmetric")
        back = (width - 1) // 2
        want = np.array([padded[8 + t - back : 8 + t - back + width].mean(0) for t in range(23)])
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        pre.sliding(vox_of(spark, x), 24, F.avg)


def test_overlap_add_of_identity_is_the_input(spark):
    x = np.random.default_rng(3).random((5, 6, 7))
    for roi in ((4, 3, 3), (8, 6, 9)):
        frames = tile.frames_of(vox_of(spark, x), 42)
        got = tile.overlap_add(frames, (5, 6, 7), roi, (0.5, 0.3, 0.3), lambda c: c, 0.125).toPandas().sort_values(["t", "pixel"])
        assert np.allclose(got["v"].to_numpy().reshape(x.shape), x)
        got = tile.overlap_add(
            frames, (5, 6, 7), roi, (0.5, 0.3, 0.3), lambda c: (c, c * c), process=lambda p, w: (p + 1, w * (1 + p[0])), outputs=("a", "b")
        )
        got = got.toPandas().sort_values(["t", "pixel"])
        assert np.allclose(got["a"].to_numpy().reshape(x.shape), x + 1) and np.allclose(got["b"].to_numpy().reshape(x.shape), x * x + 1)


def test_overlap_add_at_another_resolution(spark):
    """Padded axes, origins that don't divide evenly, and a weight map, against a plain loop."""
    rng = np.random.default_rng(21)
    x, size, roi = rng.random((9, 5, 6)), (9, 5, 6), (4, 6, 3)
    weight = rng.random(roi) + 0.5
    for out_roi in ((8, 12, 6), (2, 3, 1), (4, 6, 9)):
        pick = [(2 * np.arange(o) + 1) * r // (2 * o) for o, r in zip(out_roi, roi)]

        def predictor(cube, pick=pick):
            return cube[np.ix_(*pick)] + cube.sum()

        padded = np.pad(x, ((0, 0), (0, 1), (0, 0)))
        starts = [sorted({*range(0, n - r + 1, tile.interval(n, r, 0.5)), n - r}) for n, r in zip(padded.shape, roi)]
        total = np.zeros((2, *[n * o // r for n, o, r in zip(padded.shape, out_roi, roi)]))
        for at in np.ndindex(*map(len, starts)):
            at = [s[k] for s, k in zip(starts, at)]
            own = weight[np.ix_(*pick)]
            place = tuple(slice(a * o // r, a * o // r + o) for a, o, r in zip(at, out_roi, roi))
            cube = padded[tuple(slice(a, a + r) for a, r in zip(at, roi))]
            total[(slice(None), *place)] += [predictor(cube) * own, own]
        want = (total[0] / total[1])[:, : round(5 * out_roi[1] / 6)]
        got = tile.overlap_add(tile.frames_of(vox_of(spark, x), 30), size, roi, (0.5,) * 3, predictor, out_roi=out_roi, weight_map=weight)
        got = got.toPandas().sort_values(["t", "pixel"])
        assert len(got) == want.size and np.allclose(got["v"].to_numpy(), want.ravel())


def test_overlap_add_with_a_model_made_once_a_worker(spark, tmp_path):
    """The factory runs once in each worker process, batches hold several windows, results don't depend on their size."""
    (tmp_path / "weights.txt").write_text("3")
    made = tmp_path / "made"
    made.mkdir()

    def make(path):
        import os
        import uuid

        factor, sizes = float(open(path).read()), []
        (made / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def predict(cubes):
            sizes.append(len(cubes))
            return cubes * factor, cubes + len(cubes) * 0

        return predict

    x = np.random.default_rng(33).random((23, 5, 6))
    frames = tile.frames_of(vox_of(spark, x), 30)
    model = tile.loaded(spark, make, str(tmp_path / "weights.txt"))
    for batch in (1, 5, 1000):
        got = tile.overlap_add(frames, (23, 5, 6), (4, 3, 4), (0.5, 0.3, 0.3), model, 0.125, outputs=("a", "b"), batch=batch).toPandas()
        got = got.sort_values(["t", "pixel"])
        assert np.allclose(got["a"].to_numpy().reshape(x.shape), 3 * x) and np.allclose(got["b"].to_numpy().reshape(x.shape), x)
    pids = [f.name.split("-")[0] for f in made.iterdir()]
    assert pids and len(set(pids)) == len(pids)


def test_median_matches_numpy(spark):
    x = np.random.default_rng(4).random((2, 5, 6))
    frames = spark.createDataFrame([(k, f.ravel().tolist()) for k, f in enumerate(x)], "t long, v array<double>")
    got = {r["t"]: np.array(r["v"]).reshape(5, 6) for r in pre.median_filter(frames, 3, 5, 6).collect()}
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    for k in range(2):
        assert np.allclose(got[k], [[np.median(padded[k, i : i + 3, j : j + 3]) for j in range(6)] for i in range(5)])


def test_activity_runs(spark):
    rows = [(1, t) for t in (1, 2, 3)] + [(2, t) for t in (1, 2, 4)] + [(3, 9)]
    times = spark.createDataFrame(rows, "mask_id long, t long")
    assert {r["mask_id"] for r in filters.active(times, 3).collect()} == {1}
    assert {r["mask_id"] for r in filters.active(times, 1).collect()} == {1, 2, 3}


def test_shape_filters_and_edges(spark):
    rows = [(1, 9, 1)] + [(2, 8 + k, 1) for k in range(3)] + [(3, 8 * a + b, 1) for a in (1, 2) for b in (1, 2)]
    m = masks_of(spark, rows)
    assert {r["mask_id"] for r in filters.filter_ratio(m, 2, 8).select("mask_id").distinct().collect()} == {1, 3}
    assert morph.erode(morph.dilate(m, 3, 8, 8), 3, 8, 8).count() >= m.count()
    empty = m.limit(0)
    tables = Tables(spark)
    for df in (filters.filter_ratio(empty, 2, 8), morph.open_close(empty, 3, 3, 8, 8), overlap.cancel(empty), traces.background_rings(empty, 8, 8)):
        assert df.count() == 0
    assert merge.merge_iou(empty, 0.7, 0.2, tables)[0].count() == 0
    assert merge.merge_consume(empty, 0.85, 0.2, 9, tables)[0].count() == 0
    assert pre.normalize_minmax(vox_of(spark, np.ones((2, 1, 2)))).where("v is not null").count() == 0


def test_single_precision_threshold(spark):
    # overlap 7 of a union of 10: the ratio 0.7 is above the single-precision threshold
    m = masks_of(spark, [(1, p, 1) for p in range(8)] + [(2, p, 1) for p in range(1, 10)])
    assert {r["group_id"] for r in merge.groups_by_iou(m, 0.7, Tables(spark)).collect()} == {1}


def test_scores_without_matches(spark):
    a, b = masks_of(spark, [(1, 0, 1)]), masks_of(spark, [(1, 5, 1)])
    tables = Tables(spark)
    row = evaluate.scores(evaluate.match_jaccard(a, b, 0.5, tables), a, b).first()
    assert (row["tp"], row["f1"]) == (0, 0.0)
    row = evaluate.scores(evaluate.match_jaccard(a, a, 0.5, tables), a, a).first()
    assert (row["tp"], row["f1"]) == (1, 1.0)


def test_shared_pixels_follow_correlation(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 1, 5)) * 0.1
    x[:, 0, 0] += np.sin(np.arange(40))
    x[:, 0, 1] += np.sin(np.arange(40))
    x[:, 0, 2] += np.sin(np.arange(40))
    x[:, 0, 3] += np.cos(np.arange(40))
    x[:, 0, 4] += np.cos(np.arange(40))
    m = masks_of(spark, [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1)])
    got = {(r["mask_id"], r["pixel"]) for r in overlap.assign_by_correlation(m, vox_of(spark, x), 0.9).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 3), (2, 4)}


def test_flagship_on_a_small_video(spark):
    frame = np.zeros((6, 8, 8))
    frame[:4, 1:3, 1:3] = 1
    frame[2:, 5:7, 5:7] = 1
    frames = spark.createDataFrame([(k, f.ravel().tolist()) for k, f in enumerate(frame)], "t long, v array<double>")
    got = footprints.footprints(frames).toPandas()
    assert got.groupby("mask_id")["pixel"].apply(sorted).tolist() == [[9, 10, 17, 18], [45, 46, 53, 54]]
    assert got.groupby("mask_id")["n_frames"].first().tolist() == [4, 4]
    assert segment.slice_connect(frames.limit(0), 0.5, 8, 8, 2).count() == 0


def test_flagship_report_from_frames_to_scores(spark):
    """Two neurons found, a line filtered, a true mask missed; peaks against numpy."""
    rng, side = np.random.default_rng(41), 16
    x = rng.random((12, side, side)) * 0.05
    x[:6, 2:6, 2:6] += 1
    x[4:, 9:13, 9:13] += 2
    x[:4, 14, 1:9] += 1
    frames = spark.createDataFrame([(k, f.ravel().tolist()) for k, f in enumerate(x)], "t long, v array<double>")
    square = {1: (2, 2), 2: (9, 9)}
    truth = masks_of(spark, [(n, (a + i) * side + b + j, 1) for n, (a, b) in square.items() for i in range(4) for j in range(4)] + [(3, 15 * side + 15, 1)])
    p = footprints.Params(h=side, w=side, ratio=4)
    got = {r["neuron"]: r.asDict() for r in footprints.report(frames, truth, p).collect()}
    assert set(got) == {1, 2, 3} and got[3]["part_id"] is None and got[3]["area"] is None
    masks = footprints.cleaned(frames, p, Tables(spark))[0]
    rings = traces.background_rings(masks, side, side).toPandas().groupby("mask_id")["pixel"].apply(list)
    flat = x.reshape(12, -1)
    for n, (a, b) in square.items():
        row = got[n]
        own = [(a + i) * side + b + j for i in range(4) for j in range(4) if not (i in (0, 3) and j in (0, 3))]
        clean = flat[:, own].mean(1) - 0.7 * flat[:, rings[row["part_id"]]].mean(1)
        assert (row["area"], row["n_frames"], row["mask_id"] * side * side) == (12, 6 if n == 1 else 8, row["part_id"])
        assert np.allclose([row["iou"], row["peak"], row["snr"]], [0.75, clean.max(), clean.max() / clean.std()])
        assert np.allclose([row["precision"], row["recall"], row["f1"]], [1, 2 / 3, 0.8])
    none = footprints.report(frames.limit(0), truth, p).collect()
    assert sorted(r["neuron"] for r in none) == [1, 2, 3] and {r["f1"] for r in none} == {0.0}
    alone = footprints.report(frames, truth.limit(0), p).collect()
    assert len(alone) == 2 and all(r["neuron"] is None and r["recall"] == 0.0 for r in alone)


def flooded(pixels, w, around):
    """The shapes of a set of (row, column), in order of their first pixels, by a plain flood."""
    left, out = set(pixels), []
    while left:
        shape, todo = set(), [min(left)]
        while todo:
            q = todo.pop()
            if q in left:
                left.remove(q)
                shape.add(q)
                todo += [(q[0] + y, q[1] + x) for y, x in around]
        out.append(shape)
    return out


CROSS = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
ROUND = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]


def test_shapes_filters_and_opening_row_by_row(spark):
    rng, h, w, bounds = np.random.default_rng(43), 10, 11, (0.3, 2.0, 0.5, 2.0)
    m = {i: {(int(y), int(x)) for y, x in np.argwhere(rng.random((h, w)) < share)} for i, share in enumerate([0.3, 0.4, 0.5, 0.6, 0.7, 0.8] * 4)}
    box = {(y, x) for y in range(2, 7) for x in range(2, 7)}
    m |= {100: box - {(4, 4)}, 101: {(5, x) for x in range(1, 9)}, 102: {(3, 3)}, 103: {(y, x) for y in range(4) for x in range(4)} | {(9, x) for x in range(11)}, 104: box}
    df = masks_of(spark, [(i, y * w + x, 1) for i, own in m.items() for y, x in own])

    def inside(q):
        return 0 <= q[0] < h and 0 <= q[1] < w

    def compact(shape):
        on = np.zeros((h, w), bool)
        on[tuple(zip(*shape))] = True
        points = raster.outline(on)
        return len(points), len(points) > 1 and raster.is_compact(points, bounds)

    def filled(shape):
        rest = {(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1)} - shape
        return {(y, x) for y in range(h) for x in range(w)} - next(s for s in flooded(rest, w, CROSS) if (-1, -1) in s)

    def grow(s):
        return {q for y, x in s for q in ((y + a, x + b) for a, b in CROSS) if inside(q)}

    def shrink(s):
        return {(y, x) for y in range(h) for x in range(w) if all((y + a, x + b) in s for a, b in CROSS if inside((y + a, x + b)))}

    kept, split, parts = set(), {}, set()
    for i, own in m.items():
        found = flooded(own, w, ROUND)
        kept |= {(i, y * w + x) for s in found if compact(s)[1] for y, x in filled(s)}
        longest = max(found, key=lambda s: compact(s)[0])
        if compact(longest)[0] > 1:
            split[i] = compact(longest)[1]
        for k, s in enumerate(flooded(grow(shrink(shrink(grow(own)))), w, ROUND)):
            parts |= {(i, k, y * w + x) for y, x in shrink(grow(s))}
    got = filters.filter_ellipse(df, bounds, h, w).collect()
    assert {(r["mask_id"], r["pixel"]) for r in got} == kept and len(got) == len(kept)
    assert {p for i, p in kept if i == 100} == {y * w + x for y, x in box} and not {i for i, _ in kept} & {101, 102}
    assert {p for i, p in kept if i == 103} == {y * w + x for y in range(4) for x in range(4)}
    assert {r["mask_id"]: r["compact"] for r in filters.ellipse_split(df, bounds, h, w).collect()} == split
    assert split[100] and not split[101] and not split[103] and 102 not in split and len(set(split.values())) == 2
    got = morph.open_close(df, 3, 3, h, w).collect()
    assert {(r["mask_id"], r["part"], r["pixel"]) for r in got} == parts and len(got) == len(parts) and max(k for _, k, _ in parts) > 0
    between = {i for i, own in m.items() if 24 < len(own) < 60}
    want = {r for r in parts if r[0] in between} | {(i, 0, y * w + x) for i, own in m.items() if i not in between for y, x in own}
    got = morph.open_close_between(df, 24, 60, 3, 3, h, w).collect()
    assert {(r["mask_id"], r["part"], r["pixel"]) for r in got} == want and len(got) == len(want) and 24 == len(m[100]) and 100 not in between


def test_shards_are_equal_and_cover_all(spark):
    got = evaluate.shards(spark.range(45), "id", 7, 3, Tables(spark)).toPandas()
    assert len(got) == 49 and set(got["id"]) == set(range(45))
    assert all(sorted(g["place"]) == list(range(7)) for _, g in got.groupby("shard"))
    assert evaluate.shards(spark.range(0), "id", 7, 3, Tables(spark)).count() == 0


def test_few_rows_fill_all_shards(spark):
    for n in (1, 2, 7, 8):
        got = evaluate.shards(spark.range(n), "id", 7, 3, Tables(spark)).toPandas()
        sizes = got.groupby("shard").size()
        assert len(sizes) == 7 and sizes.nunique() == 1 and set(got["id"]) == set(range(n))


def test_running_mean_across_parts(spark):
    rng = np.random.default_rng(13)
    rows = [(int(k % 3 > 0), n, int(x), int(w)) for n, (k, x, w) in enumerate(rng.integers(1, 50, (400, 3)))]
    df = spark.createDataFrame(rows, "k long, n long, x long, w long").repartition(4)
    got = {(r["k"], r["n"]): r["mean"] for r in evaluate.running_mean(df, "k", "n", "x", "w").collect()}
    sums = {0: [0, 0], 1: [0, 0]}
    for k, n, x, w in rows:
        sums[k][0] += x * w
        sums[k][1] += w
        assert got[k, n] == sums[k][0] / sums[k][1]


def test_correlation_and_distances_in_blocks(spark):
    rng = np.random.default_rng(14)
    x = rng.random((9, 50)) + 100
    rows = [(i, t, float(x[i, t])) for i in range(9) for t in range(50) if (i + t) % 5]
    df = spark.createDataFrame(rows, "mask_id long, t long, trace double")
    got = {(r["i"], r["j"]): r["corr"] for r in traces.correlation(df, block=2, chunk=7).collect()}
    assert len(got) == 36
    for (i, j), c in got.items():
        shared = [t for t in range(50) if (i + t) % 5 and (j + t) % 5]
        assert abs(c - np.corrcoef(x[i, shared], x[j, shared])[0, 1]) < 1e-9
    points = spark.createDataFrame([(k, float(h), float(w)) for k, (h, w) in enumerate(rng.random((25, 2)))], "mask_id long, com_h double, com_w double")
    a, b = (pairs.distance_to(points, points, 2.0, block=n).orderBy("i", "j").collect() for n in (4, 10_000))
    c = pairs.distance_to(points, points, 2.0, block=4, share=6).orderBy("i", "j").collect()
    assert a == b == c and len(a) == 625


def test_merges_against_serial_loops(spark):
    rng, w = np.random.default_rng(15), 8
    rows = []
    for i in range(40):
        y, x = rng.integers(0, 5, 2)
        rows += [(i, int((y + a) * w + x + b), int(rng.integers(1, 4))) for a in range(3) for b in range(3) if rng.random() < 0.8]
    m = {i: {p: v for k, p, v in rows if k == i} for i in {r[0] for r in rows}}
    df, tables = masks_of(spark, rows), Tables(spark)

    def centroid(pixels):
        return np.mean([p // w for p in pixels]), np.mean([p % w for p in pixels])

    def greedy(centres, distance):
        group = {}
        for i in sorted(centres):
            if i not in group:
                near = [j for j in sorted(centres) if j not in group and np.hypot(*np.subtract(centres[i], centres[j])) <= distance + 1e-12]
                group |= dict.fromkeys(near, i)
        return group

    refined = {i: {p for p, v in own.items() if v >= max(own.values()) * 0.5} for i, own in m.items()}
    for got, of, distance in ((merge.merge_com(df, w, 0.93, tables), m, 0.93), (merge.refine_merge(df, w, 0.71, 0.5, tables), refined, 0.71)):
        want = greedy({i: centroid(own) for i, own in of.items()}, distance)
        assert {r["mask_id"]: r["group_id"] for r in got.collect()} == want and len(set(want.values())) < len(want)


def test_centroids_merge_in_single_precision_with_sums_and_times(spark):
    """Thirds one apart, where double precision falls short of the distance; masks that aren't valid; all that a merge yields."""
    h = {1: 4 / 3, 2: 7 / 3, 3: 0.3, 4: 0.4, 5: 0.3, 6: 20.0}
    assert 7 / 3 - 4 / 3 > 1 and 0.4 - 0.3 > 0.1
    df = spark.createDataFrame([(k, c, 0.0) for k, c in h.items()], "mask_id long, com_h double, com_w double")

    def groups(distance, valid=None, **sizes):
        got = merge.groups_by_centroid(df, distance, Tables(spark), valid=valid, **sizes)
        return {r["mask_id"]: r["group_id"] for r in got.collect()}

    assert groups(1.0) == {1: 1, 2: 1, 3: 3, 4: 1, 5: 3, 6: 6}  # 2 alone before
    assert groups(0.1) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6}  # 4 alone before
    assert groups(1.0, spark.createDataFrame([(2,), (3,), (4,)], "mask_id long")) == {2: 2, 3: 3, 4: 3}
    third = np.random.default_rng(3).integers(0, 30, (120, 2)) / np.array([3, 6])
    place, want = third.astype(np.float32), {}
    for k in range(120):
        if k not in want:
            dh, dw = (place - place[k]).T
            want |= {j: k for j in np.flatnonzero(dh * dh + dw * dw <= np.float32(1)).tolist() if j not in want}
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(third.tolist())], df.schema)
    assert groups(1.0) == groups(1.0, rounds=1, most=500) == groups(1.0, rounds=1, most=1) == want

    masks = masks_of(spark, [(7, 0, 1), (7, 1, 1), (9, 1, 2), (9, 2, 1), (12, 40, 1)])
    times = spark.createDataFrame([(7, 3), (9, 3), (9, 5), (12, 3)], "mask_id long, t long")
    rows = merge.merged(masks, times, merge.merge_com(masks, 8, 1.0, Tables(spark))).collect()
    assert sorted((r["group_id"], r["mask_id"], r["t"]) for r in rows if r["pixel"] is None) == [(7, 7, 3), (7, 9, 3), (7, 9, 5), (12, 12, 3)]
    assert sorted((r["group_id"], r["pixel"], r["val"]) for r in rows if r["t"] is None) == [(7, 0, 1.0), (7, 1, 3.0), (7, 2, 1.0), (12, 40, 1.0)]


def test_own_overlap_by_lists_against_a_plain_product(spark):
    """Crowded pixels, wide masks and copies of pairs; no join of rows with rows, whatever the size."""
    rng = np.random.default_rng(31)
    x = rng.integers(1, 5, (40, 50)) * (rng.random((40, 50)) < 0.2)
    x[:, 7], x[5] = 2, 3  # a pixel of all masks, a mask of all pixels
    m = masks_of(spark, [(int(k) * 3 - 20, int(p), int(x[k, p])) for k, p in zip(*np.nonzero(x), strict=True)])
    want = {(i * 3 - 20, j * 3 - 20): float(x[i] @ x[j]) for i in range(40) for j in range(i + 1, 40) if x[i] @ x[j]}
    for crowd, wide, meets in ((1_000, 100_000, 1_000_000), (6, 100_000, 500), (1_000, 9, 500), (6, 9, 10_000)):
        df = pairs.overlap(m, None, crowd, wide, meets)
        rows = df.collect()
        assert {(r["i"], r["j"]): r["overlap"] for r in rows} == want and len(rows) == len(want)
    plain = pairs.overlap(m)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()  # rows met rows before, and each pair was shuffled
    assert pairs.overlap(m.limit(0)).count() == 0 and pairs.containment(m.limit(0)).count() == 0
    area = (x * x).sum(1)
    both = want | {(j, i): o for (i, j), o in want.items()}
    own = {(i, j): o / area[(i + 20) // 3] for (i, j), o in both.items()}
    assert {(r["i"], r["j"]): r["ratio"] for r in pairs.containment(m).collect()} == own
    assert {(r["j"], r["i"]): r["ratio"] for r in pairs.overlap_ratio(m).collect()} == own
    assert {(r["i"], r["j"]): r["iou"] for r in pairs.iou(m).collect()} == {
        (i, j): o / (area[(i + 20) // 3] + area[(j + 20) // 3] - o) for (i, j), o in want.items()
    }


def shuffled(spark, df):
    """Rows of a frame, and the bytes that its tasks shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    return df.collect(), written() - before


def test_containment_shuffles_lists_once_and_gives_rows_in_order(spark):
    """Masks of near ids at many pixels: the list of a pixel goes to a task, not to each mask; one way after the other."""
    rng = np.random.default_rng(5)
    x = (rng.random((120, 500)) < 0.5) * rng.integers(1, 3, (120, 500))
    m = masks_of(spark, [(int(k) + 700, int(p), int(x[k, p])) for k, p in zip(*np.nonzero(x), strict=True)])
    meets, (rows, size) = sum(n * (n - 1) // 2 for n in (x > 0).sum(0)), shuffled(spark, pairs.containment(m))
    assert meets > 800_000 and size < meets  # 3,032,362 bytes before, for 895,870 meetings
    area = (x * x).sum(1)
    got = [(r["i"] - 700, r["j"] - 700, r["ratio"]) for r in rows]
    upper = [(i, j) for i in range(120) for j in range(i + 1, 120)]
    assert got == [(i, j, (x[i] @ x[j]) / area[i]) for i, j in upper + [(j, i) for i, j in upper]]


def test_overlap_ratio_gives_rows_in_order(spark):
    """One way after the other, each in order of pairs; both ways of a pair came together before."""
    rng = np.random.default_rng(7)
    x = (rng.random((30, 80)) < 0.5) * rng.integers(1, 4, (30, 80))
    m, area = masks_of(spark, [(int(k), int(p), int(x[k, p])) for k, p in zip(*np.nonzero(x), strict=True)]), (x * x).sum(1)
    upper = [(i, j) for i in range(30) for j in range(i + 1, 30) if x[i] @ x[j]]
    got = [(r["i"], r["j"], r["ratio"]) for r in pairs.overlap_ratio(m).collect()]
    assert got == [(i, j, (x[i] @ x[j]) / area[j]) for i, j in upper + [(j, i) for i, j in upper]]


def test_meetings_dealt_to_groups_and_shares(spark):
    """Kernels alone: values and ids of any size, a heavy mask in several tasks, lists that meet each other, against a plain product."""
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (60, 90)) * np.where(rng.random((60, 90)) < 0.5, 0.5, 1)
    x[rng.random((60, 90)) < 0.6], x[11] = 0, 2.0**60
    for ids in (np.arange(60) - 7, np.sort(rng.integers(-(2**63), 2**63 - 1, 60)), np.append(np.arange(59), 2**63 - 1)):
        k, p = np.nonzero(x)
        batch = pa.RecordBatch.from_pydict({"pixel": p, "j": ids[k], "y": x[k, p]})
        order = rng.permutation(len(p))
        batches = [batch.take(pa.array(order[:1000])), batch.take(pa.array(order[1000:]))]
        weights = np.where(k == 11, 50.0, 1.0)
        for most in (1e9, 400, 60):
            cuts, shares = meetings.borders(ids[k], weights, most)
            assert (most < 1e9) == (len(cuts) > 0) and (most == 1e9 or shares.max() > 1)
            sent = pa.Table.from_batches(meetings.own_lists(cuts, shares)(iter(batches)))
            assert set(sent["task"].to_pylist()) <= set(range(shares.sum()))
            found = {}
            for task in set(sent["task"].to_pylist()):
                own = sent.filter(pc.equal(sent["task"], task)).to_batches()
                for r in pa.Table.from_batches(meetings.added_up(False)(iter(own))).to_pylist():
                    assert (r["i"], r["j"]) not in found
                    found[r["i"], r["j"]] = r["overlap"]
            both = (x != 0).astype(int) @ (x != 0).T
            assert set(found) == {(ids[i], ids[j]) for i in range(60) for j in range(i + 1, 60) if both[i, j]}
            assert all(np.isclose(found[ids[i], ids[j]], (x[i] * x[j]).sum()) for i in range(60) for j in range(i + 1, 60) if both[i, j])
    for v in (np.array([0.5, 1.0]), np.array([np.nan, np.inf]), np.array([2.0**70, 1.0]), np.array([-(2**63), 2**63 - 1, 5]), np.array([3, 3])):
        assert np.array_equal(meetings.unpacked(meetings.packed(v)), v, equal_nan=True)


class Counted(Tables):
    """Kept tables, with the number of rows of the largest."""

    most = 0

    def keep(self, df):
        out = super().keep(df)
        self.most = max(self.most, out.count())
        return out


def test_crowded_centroids_keep_no_table_of_pairs(spark):
    """Copies, crowds and a line in ascending order, by rounds and by the serial loop; tables stay as long as the masks."""
    rng = np.random.default_rng(8)
    crowd = [(float(h), float(w)) for h, w in rng.integers(0, 40, (500, 2)) / 16]
    centres = dict(enumerate(crowd + crowd[:60] + [(9.0, 0.75 * k - 3) for k in range(12)]))
    centres = {int(k): c for k, c in zip(rng.permutation(560).tolist() + list(range(560, 572)), centres.values(), strict=True)}
    ids = sorted(centres)
    place, group = np.array([centres[k] for k in ids]), {}
    for k, near in zip(ids, ((place[:, None] - place) ** 2).sum(2) <= 1, strict=True):
        if k not in group:
            group |= {ids[j]: k for j in np.flatnonzero(near) if ids[j] not in group}
    df = spark.createDataFrame([(k, *c) for k, c in centres.items()], "mask_id long, com_h double, com_w double").repartition(3)
    for rounds, most in ((4, 500_000), (2, 9)):
        tables = Counted(spark)
        got = {r["mask_id"]: r["group_id"] for r in merge.groups_by_centroid(df, 1.0, tables, rounds, most).collect()}
        assert got == group and 8 < len(set(group.values())) < 40
        assert tables.most <= len(ids)  # 40,000 pairs and more before
    lost = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 0.0, 0.0), (4, 0.5, 0.0)], df.schema)
    assert {r["mask_id"]: r["group_id"] for r in merge.groups_by_centroid(lost, 1.0, Tables(spark)).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def consumed(edges, areas, most):
    """The literal loop over all pairs in order, component by component: a mask's group, None if deleted."""
    group = {}
    for i, j in edges:
        if areas[i] != areas[j] and max(areas[i], areas[j]) > most:
            group[i if areas[i] > areas[j] else j] = None
        elif i not in group and j not in group:
            group[i] = group[j] = i
        elif i not in group:
            group[i] = group[j]
        elif j not in group:
            group[j] = group[i]
        else:
            old, new = group[j], group[i]
            group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_containment_in_slices_against_the_serial_loop(spark):
    revived = deleted = 0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        areas = {k: int(rng.choice([3] + [8] * 9)) for k in range(60)}
        edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (20, 2)) if a != b} | {(int(a) + 30, int(b) + 30) for a, b in rng.integers(0, 30, (40, 2)) if a != b})
        rows = [(i // 30, i, j, areas[i], areas[j]) for i, j in edges]
        df = spark.createDataFrame(rows, "group long, i long, j long, area_i long, area_j long").repartition(3)
        want = {}
        for g in (0, 1):
            want |= consumed([e for e in edges if e[0] // 30 == g], areas, 6)
        ever = {k for i, j in edges for k in (i, j) if areas[i] != areas[j] and max(areas[i], areas[j]) > 6 and areas[k] == max(areas[i], areas[j])}
        revived += sum(want[k] is not None for k in ever)
        deleted += sum(g is None for g in want.values())
        for n in (7, 10_000):
            got = merge.fold_pairs(df, 6, Tables(spark), n).collect()
            assert {r["mask_id"]: r["group_id"] for r in got} == want and len(got) == len(want)
    assert deleted and revived  # some deleted masks are united again
    assert merge.fold_pairs(df.limit(0), 6, Tables(spark)).count() == 0


def test_merge_consume_against_the_serial_loop(spark):
    rng, w = np.random.default_rng(15), 8
    rows = []
    for i in range(40):
        y, x = rng.integers(0, 5, 2)
        rows += [(i, int((y + a) * w + x + b), int(rng.integers(1, 4))) for a in range(3) for b in range(3) if rng.random() < 0.8]
    m = {i: {p: v for k, p, v in rows if k == i} for i in {r[0] for r in rows}}
    refined = {i: {p for p, v in own.items() if v >= max(own.values()) * 0.5} for i, own in m.items()}
    areas = {i: len(p) for i, p in refined.items()}
    edges = [(i, j) for i in sorted(refined) for j in sorted(refined) if i != j and len(refined[i] & refined[j]) / areas[i] >= 0.8]
    part = {i: i for i in refined}
    for i, j in edges * 40:
        part[i] = part[j] = min(part[i], part[j])
    want = {i: i for i in refined}
    for g in set(part.values()):
        want |= consumed([e for e in edges if part[e[0]] == g], areas, 5)
    assert None in want.values()
    masks = masks_of(spark, rows)
    for n in (4, 10_000):
        merged, groups = merge.merge_consume(masks, 0.8, 0.5, 5, Tables(spark), n)
        assert {r["mask_id"]: r["group_id"] for r in groups.collect()} == want
    kept = {g: sum(g2 == g for g2 in want.values()) for g in set(want.values()) - {None}}
    assert {r["mask_id"] for r in merged.select("mask_id").distinct().collect()} == set(kept)


def test_windowed_mean_of_late_events(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:10' as ts, 1 as k, 2.0D as v union all select timestamp'2024-01-01 00:00:50', 1, 4.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k int, v double").parquet(str(tmp_path / "in"))
    q = activity.windowed_mean(stream, "ts", "k", "v", "1 minute", "10 minutes").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["k"], r["mean"], r["n"]) for r in spark.table("means").collect()] == [(1, 3.0, 2)]


def test_files(spark, tmp_path):
    x = np.arange(2 * 3 * 4, dtype="u2").reshape(2, 3, 4) + 40_000
    (tmp_path / "a.tif").write_bytes(tiff.tiff_bytes(x))
    rows = volumes.signed_offset(tiff.read_tiff(spark, str(tmp_path / "*.tif"))).orderBy("t").collect()
    assert [r["v"] for r in rows] == [[float(v) - 32768 for v in p.ravel()] for p in x]
    (tmp_path / "d.json").write_text('{"training": [{"image": "a", "label": "b"}],\n "validation": []}')
    assert [tuple(r) for r in volumes.read_datalist(spark, str(tmp_path / "d.json")).collect()] == [("training", "a", "b")]
    (tmp_path / "e.json").write_text('{"training": [{"image": "a", "label": "/b"}], "test": ["c", "s3a://k/d"]}')
    got = [tuple(r) for r in volumes.read_datalist(spark, str(tmp_path / "e.json"), "/data/").collect()]
    assert got == [("training", "/data/a", "/b"), ("test", "/data/c", None), ("test", "s3a://k/d", None)]
    m = masks_of(spark, [(1, 8 * a + b, 1) for a in (1, 2) for b in (1, 2)])
    assert volumes.rois(m, 8, 8).first()["roi"][:4] == b"Iout"


def test_streams(spark, tmp_path):
    rows = [(1, t) for t in (1, 2, 3, 4)] + [(2, t) for t in (1, 3, 5)]
    spark.createDataFrame(rows, "mask_id long, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mask_id long, t long").parquet(str(tmp_path / "in"))
    q = activity.first_active(stream, 3).writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("runs").collect()] == [(1, 3)]


def test_auction_finds_the_least_cost(spark):
    """Small blocks force several rounds; ties, single pairs and empty tables are there too."""
    for seed, (n, m, block) in enumerate([(14, 9, 60), (40, 30, 200)]):
        rng = np.random.default_rng(seed)
        near = {(i, int(np.clip(i * m // n + d, 0, m - 1))) for i in range(n) for d in rng.integers(-3, 4, 3)}
        cost = {e: round(float(rng.integers(0, 12)) / 16, 6) for e in near} | {(1000, 1000): 0.5}
        rows = [(i, j, c) for (i, j), c in cost.items()]
        edges = spark.createDataFrame(rows, "i long, j long, distance double")
        got = evaluate.match_least(edges, Tables(spark), most_cells=0, block_arcs=block, unit=16).collect()
        assert len({r["i"] for r in got}) == len({r["j"] for r in got}) == len(got)
        assert all(cost[r["i"], r["j"]] == r["distance"] for r in got)
        by_kernel = evaluate.match_least(edges, Tables(spark)).collect()
        dense = np.full((n + 1, m + 1), 2.0)
        for (i, j), c in cost.items():
            dense[min(i, n), min(j, m)] = c
        full = dense.T[np.arange(m + 1), evaluate.assign(dense.T)].sum()
        for matches in (got, by_kernel):
            assert round(2 * (m + 1) - sum(2 - r["distance"] for r in matches), 9) == round(full, 9)
    assert evaluate.match_least(edges.limit(0), Tables(spark), most_cells=0).count() == 0


def test_assignment_kernel_against_all_permutations():
    import itertools

    rng = np.random.default_rng(11)
    for n, m in ((1, 1), (3, 3), (4, 6)):
        for _ in range(20):
            cost = rng.integers(0, 6, (n, m)).astype(float)
            cols = evaluate.assign(cost)
            assert cost[np.arange(n), cols].sum() == min(sum(cost[k, c] for k, c in enumerate(p)) for p in itertools.permutations(range(m), n))
