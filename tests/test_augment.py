"""Percentiles against numpy, and crops of videos without foreground, without background, and with neither."""

import numpy as np
from pyspark.sql import functions as F

from voxelmill.functions.tables import Tables
from voxelmill.operators import augment


def frames_of(spark, videos):
    rows = [(k, t, v.ravel().tolist(), y.ravel().tolist()) for k, (x, m) in videos.items() for t, (v, y) in enumerate(zip(x, m))]
    return spark.createDataFrame(rows, "video long, t long, v array<double>, label array<int>").repartition(4)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    videos = {k: (np.round(rng.random((n, 3, 4)), 1 + k), np.zeros((n, 3, 4), int)) for k, n in enumerate((1, 7, 30))}
    df, tables = frames_of(spark, videos), Tables(spark)
    for at in ([0, 100], [0, 3.7, 50, 99, 100]):
        for r in augment.percentiles(df, at, tables).collect():
            assert np.allclose([r[f"p{k}"] for k in range(len(at))], np.percentile(videos[r["video"]][0], at))
    flat = frames_of(spark, {0: (np.full((2, 1, 2), 7.0), np.zeros((2, 1, 2), int))})
    assert {x for r in augment.scale_percentiles(flat, tables).collect() for x in r["v"]} == {0.0}
    loose = {r["t"]: r["v"] for r in augment.scale_percentiles(df, tables, 20, 80, -1, 1, clip=False).where("video = 1").collect()}
    lo, hi = np.percentile(videos[1][0], [20, 80])
    assert np.allclose([loose[t] for t in range(7)], (videos[1][0].reshape(7, -1) - lo) / (hi - lo) * 2 - 1)


def test_crops_around_both_kinds(spark):
    rng = np.random.default_rng(2)
    h, w, roi = 6, 5, (3, 3, 3)
    label = (rng.random((9, h, w)) < 0.1).astype(int)
    videos = {
        0: (rng.random((9, h, w)) + 0.1, label), 1: (rng.random((4, h, w)) + 0.1, np.zeros((4, h, w), int)),
        2: (rng.random((3, h, w)), np.ones((3, h, w), int)), 3: (np.zeros((5, h, w)), np.zeros((5, h, w), int)),
    }
    df, tables = frames_of(spark, videos), Tables(spark)
    drawn = augment.centres(df, 40, 5, tables, pos=3, neg=1).collect()
    assert {(r["video"], r["sample"]) for r in drawn} == {(k, s) for k in range(3) for s in range(40)} and len(drawn) == 120
    marked = [label[r["t"]].ravel()[r["pixel"]] for r in drawn if r["video"] == 0]
    assert 20 <= sum(marked) < 40 and len({(r["t"], r["pixel"]) for r in drawn if r["video"] == 1}) > 20
    assert all(r["t"] < 4 for r in drawn if r["video"] == 1)
    places = {(r["video"], r["sample"]): (r["t0"], r["h0"], r["w0"]) for r in augment.crops(df, (h, w), roi, 4, 5, tables).collect()}
    got = augment.sample_crops(df, (h, w), roi, 5, tables, 4).collect()
    plain = augment.sample_crops(df, (h, w), roi, 5, tables, 4, flips=0, turns=0, intensity=0).collect()
    assert len(got) == len(plain) == 3 * 4 * 3
    for r in plain:
        t0, h0, w0 = places[r["video"], r["sample"]]
        x, m = videos[r["video"]]
        assert r["v"] == x[t0 + r["t"], h0 : h0 + 3, w0 : w0 + 3].ravel().tolist() and r["label"] == m[t0 + r["t"], h0 : h0 + 3, w0 : w0 + 3].ravel().tolist()
    assert sorted((r["video"], r["sample"], r["t"], sum(r["label"])) for r in got) == sorted((r["video"], r["sample"], r["t"], sum(r["label"])) for r in plain)
    assert got != plain
    again = {(r["video"], r["sample"], r["t"]): r["v"] for r in augment.sample_crops(df.repartition(7), (h, w), roi, 5, tables, 4).collect()}
    assert again == {(r["video"], r["sample"], r["t"]): r["v"] for r in got}
    holes = df.withColumn("v", F.transform("v", lambda x: F.when(x > 0.2, x))).withColumn("label", F.transform("label", lambda x: F.when(x > 0, x)))
    assert len(augment.crops(holes, (h, w), roi, 2, 5, tables).collect()) == 6
    assert not augment.sample_crops(df.limit(0), (h, w), roi, 5, tables).collect()
    long = augment.sample_crops(df, (h, w), (4, 3, 3), 5, tables, flips=0, turns=0, intensity=0).where("video = 2").collect()
    assert sorted((r["sample"], r["t"]) for r in long) == [(s, t) for s in range(2) for t in range(3)]  # a short video gives all its frames
