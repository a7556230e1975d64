"""Files written by tasks are read back equal, and a failed job leaves none."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.sources import mat, sinks, tiff, volumes


def frames_of(spark, videos):
    rows = [(f"file:/in/{name}.tif", t, *p.shape, p.ravel().astype(float).tolist()) for name, x in videos.items() for t, p in enumerate(x)]
    return spark.createDataFrame(rows, "path string, t long, h int, w int, v array<float>").repartition(5)


@pytest.mark.parametrize("kind, dtype", [("nifti", "f4"), ("nifti", "i2"), ("npz", "i2"), ("npz", "f4"), ("tiff", "u2"), ("tiff", "f4")])
def test_volumes_round_trip(spark, tmp_path, kind, dtype):
    rng = np.random.default_rng(1)
    videos = {"a b": rng.integers(0, 9, (7, 3, 4)), "c": rng.integers(0, 9, (3, 5, 2))}
    target = str(tmp_path / "out")
    sinks.write_volumes(frames_of(spark, videos), target, kind, dtype, key="mask", most_frames=3)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    suffix = {"nifti": "nii", "npz": "npz", "tiff": "tif"}[kind]
    assert names == [f"a b-0000{k}.{suffix}" for k in range(3)] + [f"c-00000.{suffix}"]
    read = {"nifti": volumes.read_nifti, "tiff": tiff.read_tiff, "npz": lambda s, p: volumes.read_frames(s, p, volumes.npz_frames("mask"))}[kind]
    got = read(spark, f"{target}/*").toPandas()
    part = got["path"].str.extract(r"(\d+)\.\w+$")[0].astype(int)
    video = got["path"].str.extract(r"([^/]+)-\d+\.\w+$")[0]
    found = {(n, p * 3 + t): (h, w, list(v)) for n, p, t, h, w, v in zip(video, part, got["t"], got["h"], got["w"], got["v"])}
    assert found == {(n, t): (*p.shape, p.ravel().tolist()) for n, x in videos.items() for t, p in enumerate(x)}
    if kind == "npz":
        assert np.load(tmp_path / "out" / names[0])["mask"].tolist() == np.moveaxis(videos["a b"][:3], 0, 2).tolist()


def test_failed_jobs_leave_no_files(spark, tmp_path):
    target = tmp_path / "out"
    good = spark.createDataFrame([("x/a.bin", None, b"12"), ("x/a.bin", None, b"3"), ("b.zip", "e", b"4")], sinks.SCHEMA).coalesce(1)
    broken = F.udf(lambda d: 1 / (d != b"9"), "double")
    bad = spark.createDataFrame([(f"{k}.bin", None, b"%d" % k) for k in range(12)], sinks.SCHEMA).repartition(4, "file").where(broken("data") > 0)
    with pytest.raises(Exception, match="division by zero"):
        sinks.write_files(bad, str(target))
    assert not list(target.rglob("*.bin")) and not list(target.glob("_job*"))
    sinks.write_files(good, str(target))
    assert {str(p.relative_to(target)): p.stat().st_size for p in target.rglob("*") if p.is_file()}.keys() == {"x/a.bin", "b.zip"}
    assert (target / "x/a.bin").read_bytes() == b"123"
    for rows in ([("x/a.bin", None, b"new")], [("../c", None, b"")], [("d", None, b"1"), ("e", None, b""), ("d", None, b"2")], [("f", None, b""), ("f", "e", b"")]):
        with pytest.raises(Exception, match="isn't a file below|are there already|some rows only"):
            sinks.write_files(spark.createDataFrame(rows, sinks.SCHEMA).coalesce(1), str(target))
    with pytest.raises(Exception, match="by two tasks"):
        sinks.write_files(spark.createDataFrame([("g", None, b"1")] * 2, sinks.SCHEMA).repartition(2), str(target))
    assert (target / "x/a.bin").read_bytes() == b"123" and sorted(p.name for p in target.iterdir()) == ["b.zip", "x"]
    sinks.write_files(spark.createDataFrame([("h", None, b"1")], sinks.SCHEMA), str(target), overwrite=True)
    assert [p.name for p in target.iterdir()] == ["h"]


def test_volumes_with_gaps_are_refused(spark, tmp_path):
    x = frames_of(spark, {"a": np.ones((4, 2, 2))})
    for df in (x.where("t != 1"), x.unionByName(x.where("t = 2")), x.where("t > 0"), x.withColumn("h", F.when(F.col("t") == 3, 1).otherwise(2)).withColumn("w", F.lit(2))):
        with pytest.raises(Exception, match="absent or repeated frames|cannot reshape"):
            sinks.write_volumes(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="several videos"):
        sinks.write_volumes(x.unionByName(x.withColumn("path", F.lit("other/a.tif"))), str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.nii"))
    sinks.write_volumes(x.limit(0), str(tmp_path / "out"))


def test_masks_with_traces_and_regions(spark, tmp_path):
    rng, h, w = np.random.default_rng(4), 9, 11
    rows = [(k * 3 - 6, int(p), 1.0) for k in range(14) for p in {y * w + x for y in (k % 6, k % 6 + 1) for x in (k % 8, k % 8 + 1)}]
    masks = spark.createDataFrame(rows, "mask_id long, pixel long, val double")
    series = [(i, int(t), float(rng.random())) for i in sorted({r[0] for r in rows})[1:] for t in range(5) if (i + t) % 4]
    sinks.write_masks(masks, str(tmp_path / "m"), w, spark.createDataFrame(series, "mask_id long, t long, trace double"), stamp="now", most=5)
    seen, traced, times = set(), {}, 0
    for file in sorted((tmp_path / "m").iterdir()):
        found = {(n, k): v for n, k, *_, v in mat.leaves(file.read_bytes())}
        ids = found["mask_id", 0].tolist()
        assert ids == sorted(ids)
        traces = found["traces", 0].reshape(len(ids), -1, order="F")
        for n, i in enumerate(ids):
            seen |= {(i, int(y * w + x)) for y, x in zip(found["masks", 2 * n], found["masks", 2 * n + 1])}
            traced |= {(i, t): v for t, v in enumerate(traces[n]) if not np.isnan(v)}
        times += 1
    assert seen == {r[:2] for r in rows} and traced == {r[:2]: r[2] for r in series} and times > 1
    sinks.write_rois(masks, str(tmp_path / "r"), h, w, most=6)
    files = list((tmp_path / "r").iterdir())
    got = {n: z.read(n) for f in files for z in [zipfile.ZipFile(io.BytesIO(f.read_bytes()))] for n in z.namelist()}
    assert got == {r["name"]: bytes(r["roi"]) for r in volumes.rois(masks, h, w).collect()} and len(got) == 14 and len(files) > 1
