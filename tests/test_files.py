import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from voxelloom.sources import files, text, volumes

A = np.arange(20 * 6 * 5, dtype="i2").reshape(20, 6, 5)


def made(tmp_path):
    (tmp_path / "a.nii").write_bytes(volumes.nifti_bytes(A, compressed=False))
    (tmp_path / "b.mha").write_bytes(volumes.metaimage_bytes(A.astype("f4"), compressed=False))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.nii.gz").write_bytes(volumes.nifti_bytes(A))
    (tmp_path / "d.hr2").write_bytes(volumes.hr2_bytes(A.astype(float)))
    (tmp_path / "e.nrrd").write_bytes(b"NRRD0004\ntype: short\ndimension: 3\nsizes: 5 6 20\nencoding: raw\nendian: little\n\n" + A.astype("<i2").tobytes())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    return str(tmp_path)


def test_slabs_of_all_kinds(spark, tmp_path):
    whole = files.read_slabs(spark, made(tmp_path), slab_bytes=200)
    assert whole.rdd.getNumPartitions() > 5
    for condition, zs in (("z BETWEEN 3 AND 7", range(3, 8)), ("z = 19", [19]), ("z IN (2, 5) AND x < 2", [2, 5]), ("z > 30", []), ("true", range(20))):
        got = {}
        rows = files.read_slabs(spark, str(tmp_path), slab_bytes=200, push=True).filter(condition)
        assert sorted(rows.collect()) == sorted(whole.filter(condition).collect())
        for r in rows.collect():
            got.setdefault(r.volume_id.rsplit("/", 1)[1], {})[r.z, r.y, r.x] = r.v
        want = {(z, y, x): float(A[z, y, x]) for z in zs for y in range(6) for x in range(2 if "x <" in condition else 5)}
        assert got == ({n: want for n in ("a.nii", "b.mha", "c.nii.gz", "d.hr2", "e.nrrd")} if want else {})
    for push in (False, True):
        assert files.read_slabs(spark, str(tmp_path), push=push).filter(F.col("volume_id") == f"{tmp_path}/sub/c.nii.gz").count() == A.size
    bounded = files.read_slabs(spark, str(tmp_path), slab_bytes=200, z=(4, 6))
    assert {(r.z, r.v) for r in bounded.filter("x = 1 AND y = 2").collect()} == {(z, float(A[z, 2, 1])) for z in (4, 5, 6)}
    assert files.read_slabs(spark, str(tmp_path), glob="*.nii").count() == A.size


@pytest.mark.parametrize("name,item", [("a.nii", 2), ("b.mha", 4), ("e.nrrd", 2)])
def test_only_the_slices_asked_for_are_read(tmp_path, monkeypatch, name, item):
    monkeypatch.setattr(files, "HEAD_BYTES", 512)
    made(tmp_path)
    reader = files.PushedReader(str(tmp_path / name), slab_bytes=150)
    other = In(("z",), [4, 5])
    assert list(reader.pushFilters([GreaterThanOrEqual(("z",), 4), LessThan(("z",), 9), other, EqualTo(("x",), 1)])) == [other, EqualTo(("x",), 1)]
    parts = reader.partitions()
    before = reader.bytes_read
    found = [b for p in parts for b in reader.read(p)]
    assert sorted({z for b in found for z in b.column("z").to_pylist()}) == [4, 5]
    assert reader.bytes_read - before == 2 * 30 * item + 512 * len(parts)


def test_broken_and_missing_files(spark, tmp_path):
    whole = volumes.nifti_bytes(A, compressed=False)
    (tmp_path / "short.nii").write_bytes(whole[:-100])
    with pytest.raises(Exception, match="end early"):
        files.read_slabs(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="nowhere"):
        files.read_slabs(spark, str(tmp_path / "nowhere")).count()


def test_files_are_written_all_or_none(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(40).select(F.format_string("d%d/f%d.txt", F.col("id") % 3, "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content")).repartition(5)
    files.write_files(rows, str(out))
    there = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()}
    assert there == {f"d{i % 3}/f{i}.txt": str(i).encode() for i in range(40)}
    fails = rows.withColumn("content", F.when(F.col("name") == "d1/f31.txt", F.raise_error(F.lit("no more"))).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="no more"):
        files.write_files(fails, str(out))
    for wrong in (rows.unionByName(rows.limit(1)), rows.withColumn("name", F.lit("../x")).limit(1)):
        with pytest.raises(Exception, match="name"):
            files.write_files(wrong, str(out))
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == there and not list(out.glob("_staged*"))
    files.write_files(rows.limit(1), str(out), overwrite=True)
    assert len([p for p in out.rglob("*") if p.is_file()]) == 1


def test_text_files(spark, tmp_path):
    rois = spark.createDataFrame([(v, i, i, 1, 2, 3, 4, 5) for v in "ab" for i in range(12)], "volume_id string, roi_id long, x0 long, y0 long, z0 long, sx long, sy long, sz long").repartition(4)
    files.write_files(files.text_files(text.roi_lines(rois), F.concat("volume_id", F.lit("1.ROIInfo"))), str(tmp_path))
    assert (tmp_path / "a1.ROIInfo").read_text() == "".join(f"[{i}, 1, 2][3, 4, 5]\n" for i in range(12))
    back = text.read_rois(spark, [f"{tmp_path}/b1.ROIInfo"]).drop("volume_id").orderBy("roi_id").collect()
    assert [tuple(r) for r in back] == [(i, i, 1, 2, 3, 4, 5) for i in range(12)]
