import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators.stencil import FEATURES
from voxelloom.plans import saving, tools
from voxelloom.sources import text, volumes
from voxelloom.sources.pixels import jpeg_bytes, jpeg_values, packed, unpacked
from voxelloom.streaming import arrivals

A = np.arange(24.0).reshape(2, 3, 4)


def grid(df):
    rows = df.collect()
    out = np.zeros((max(r.z for r in rows) + 1, max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.z, r.y, r.x] = r.v
    return out


def test_volume_files(spark, tmp_path):
    (tmp_path / "a.hr2").write_bytes(volumes.hr2_bytes(A, (1.5, 2, 3), (0.5, 0.5, 1)))
    (tmp_path / "b.nii.gz").write_bytes(volumes.nifti_bytes(A.astype("i2"), (0.5, 1, 2), (1, 2, 3)))
    values = "\n".join(str(A[z, y, x]) for z in range(2) for x in range(4) for y in range(3))
    (tmp_path / "c.txt").write_text(f"# Created by x\n# name: v\n# type: matrix\n# ndims: 3\n 4 3 2\n{values}\n")
    assert np.array_equal(grid(volumes.read_hr2(spark, str(tmp_path / "a.hr2"))), A)
    assert np.array_equal(grid(volumes.read_nifti(spark, str(tmp_path / "b.nii.gz"))), A)
    assert np.array_equal(grid(volumes.read_octave(spark, str(tmp_path / "c.txt"))), A)
    g = volumes.hr2_geometry(spark, str(tmp_path / "a.hr2")).first()
    assert (g.dim, g["size"], g.origin, g.spacing) == (3, [4, 3, 2], [1.5, 2.0, 3.0], [0.5, 0.5, 1.0])
    again = volumes.nifti_files(volumes.read_nifti(spark, str(tmp_path / "b.nii.gz"))).first()
    assert np.array_equal(volumes.parse_nifti(bytes(again.content))[1], A)
    volumes.write_volumes(volumes.read_hr2(spark, str(tmp_path / "a.hr2")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


@pytest.mark.parametrize("data", [b"", b"HR3", b"HR2", volumes.hr2_bytes(A)[:-9], volumes.hr2_bytes(A).replace(b"ZLib", b"None"), volumes.hr2_bytes(A).replace(b"4 3 2", b"4 3 3"), volumes.hr2_bytes(A).replace(b"float", b"short")])
def test_broken_hr2(data):
    with pytest.raises((ValueError, IndexError)):
        volumes.parse_hr2(data)


def test_char_pixels_and_long_fields():
    b = np.arange(-60, 60).reshape(4, 5, 6)
    assert np.array_equal(volumes.parse_hr2(volumes.hr2_bytes(b, kind="char"))[1], b)
    assert volumes.inflated(__import__("zlib").compress(b"x" * 100_000), 7) == b"x" * 100_000


def test_text_files(spark, tmp_path):
    (tmp_path / "r").write_text("index size\n[1, 2, 3][4, 5, 6]\n\n[-1,0,2][1,1,1]")
    assert [tuple(r)[1:] for r in text.read_rois(spark, str(tmp_path / "r")).orderBy("roi_id").collect()] == [(0, 1, 2, 3, 4, 5, 6), (1, -1, 0, 2, 1, 1, 1)]
    assert text.roi_lines(text.read_rois(spark, str(tmp_path / "r"))).first().line == "[1, 2, 3][4, 5, 6]"
    (tmp_path / "bad").write_text("[1, 2, 3][4, 5, 6]\nno\n")
    with pytest.raises(Exception, match="no region"):
        text.read_rois(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "p").write_text("i.nii, m.nii\n\n a,b,c\n")
    assert [(r.first, r.second) for r in text.read_pairs(spark, str(tmp_path / "p")).orderBy("line").collect()] == [("i.nii", "m.nii"), ("a", "b,c")]
    (tmp_path / "q").write_text("nothing\n")
    with pytest.raises(Exception, match="no separator"):
        text.read_pairs(spark, str(tmp_path / "q")).collect()
    (tmp_path / "m").write_text("1,2.5\n\n3,4e1\n")
    assert [r["values"] for r in text.read_matrix(spark, str(tmp_path / "m")).orderBy("row").collect()] == [[1.0, 2.5], [3.0, 40.0]]
    (tmp_path / "n").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="another length"):
        text.read_matrix(spark, str(tmp_path / "n")).collect()
    assert [r.features for r in text.read_bags(spark, [str(tmp_path / "m")]).orderBy("roi_id").collect()] == [[1.0, 2.5], [3.0, 40.0]]


def test_specification(spark, tmp_path):
    spec = spark.createDataFrame([(i, [i / 3, i + 1.0]) for i in range(8)], "hist_idx int, edges array<double>")
    text.write_lines(text.spec_lines(spec, [0.5]), str(tmp_path / "s"), ["hist_idx"])
    part = next((tmp_path / "s").glob("part-*"))
    assert part.read_text().splitlines()[0] == "# " + ",".join(FEATURES)
    got = {r.hist_idx: r.edges for r in text.read_spec(spark, str(part), [0.5]).collect()}
    assert all(np.allclose(got[i], [i / 3, i + 1], rtol=1e-5) for i in range(8))
    with pytest.raises(ValueError):
        text.read_spec(spark, str(part), [0.5, 1.0])


def test_arriving_volumes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0, z, float(z)) for z in range(10)], "volume_id string, x long, y long, z long, v double")
    rows.write.parquet(str(tmp_path / "in"))
    source = arrivals.arriving_voxels(spark, str(tmp_path / "in"), rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    arrivals.ingest(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    q = arrivals.running_histogram(source, [2.0, 5.0]).writeStream.outputMode("complete").format("memory").queryName("h").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.bin, r.n) for r in spark.table("h").collect()} == {(0, 3), (1, 3), (2, 4)}


def test_geometry_of_written_files(spark, tmp_path):
    for i, step in enumerate([(0.5, 1.0, 2.0), (1.0, 1.0, 3.0)]):
        (tmp_path / f"{i}.nii.gz").write_bytes(volumes.nifti_bytes(A.astype("f4") + i, step, (1, 2, 3 + i)))
    path = str(tmp_path / "*.nii.gz")
    geometry = volumes._geometry(spark, path, volumes.parse_nifti)
    files = {r.volume_id[-8:]: bytes(r.content) for r in volumes.nifti_files(volumes.read_nifti(spark, path), geometry=geometry).collect()}
    head, values = volumes.parse_nifti(files["1.nii.gz"])
    assert head["spacing"] == [1.0, 1.0, 3.0] and head["origin"] == [1.0, 2.0, 4.0] and np.array_equal(values, A + 1)
    assert volumes.parse_nifti(files["0.nii.gz"])[0]["spacing"] == [0.5, 1.0, 2.0]


def test_pairs_of_files(spark, tmp_path):
    mask = (A % 3).astype("u1")
    for name, values in (("i1", A), ("i2", A + 1), ("m1", mask), ("m2", mask + 1)):
        (tmp_path / f"{name}.nii.gz").write_bytes(volumes.nifti_bytes(values.astype("f4")))
    lines = [f"{tmp_path}/i{k}.nii.gz, {tmp_path}/m{k}.nii.gz" for k in (1, 2)]
    (tmp_path / "pairs.txt").write_text("\n".join(lines) + "\n")
    got = volumes.pair_voxels(spark, text.read_pairs(spark, str(tmp_path / "pairs.txt"))).collect()
    assert len(got) == 48
    for r in got:
        k = int(r.volume_id[-8])
        assert r.v == A[r.z, r.y, r.x] + k - 1 and r.m == mask[r.z, r.y, r.x] + k - 1


def test_dicom(spark, tmp_path):
    for i, (z, uid, explicit) in enumerate([(3.0, "1.2.3", True), (1.0, "1.2.3", False), (2.0, "1.2.3", True), (5.0, "1.2.9", True)]):
        (tmp_path / f"s{i}.dcm").write_bytes(volumes.dicom_bytes(A[0] - 7 + z * 100, uid, "20200131", z, explicit, 2.0, -1.0))
    got = volumes.read_dicom(spark, str(tmp_path / "*.dcm")).collect()
    one = sorted((r.z, r.y, r.x, r.v) for r in got if r.volume_id == "1.2.3_20200131")
    assert len(got) == 48 and [r.z for r in got if r.volume_id == "1.2.9_20200131"] == [0] * 12
    assert one == [(z, y, x, (A[0, y, x] - 7 + (z + 1) * 100) * 2 - 1) for z in range(3) for y in range(3) for x in range(4)]
    made = {r.volume_id: volumes.parse_nifti(bytes(r.content)) for r in tools.convert_dicom(spark, str(tmp_path / "*.dcm")).collect()}
    head, values = made["1.2.3_20200131"]
    assert head["origin"] == [0.0, 0.0, 1.0] and head["spacing"] == [1.0, 1.0, 1.0] and values[2, 1, 3] == (A[0, 1, 3] + 293) * 2 - 1
    # A sequence of undefined length with another series in it comes first.
    item = b"\x20\x00\x0e\x00UI\x04\x009.9\x00"
    nested = b"\x08\x00\x15\x11SQ\x00\x00\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + item + b"\xfe\xff\x0d\xe0\x00\x00\x00\x00" + b"\xfe\xff\x00\xe0" + len(item).to_bytes(4, "little") + item + b"\xfe\xff\xdd\xe0\x00\x00\x00\x00"
    data = volumes.dicom_bytes(A[0], "1.2.3", "20200131", 4.0)
    at = data.index(b"\x20\x00\x0e\x00UI")
    assert volumes.parse_dicom(data[:at] + nested + data[at:])["series_uid"] == "1.2.3"
    for broken in (b"", data[:200], data.replace(b"1.2.840.10008.1.2.1", b"1.2.840.10008.1.2.5")):
        with pytest.raises(ValueError):
            volumes.parse_dicom(broken)


def test_columns_across_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("5,6,7\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/b.csv  {tmp_path}/a.csv\n")
    listed = {r.bag_idx: r.path for r in text.bag_paths(text.numbered_lines(spark, str(tmp_path / "list.txt"))).collect()}
    assert [listed[i][-5:] for i in (0, 1)] == ["b.csv", "a.csv"]
    assert text.read_bags(spark, [str(tmp_path / "a.csv")]).count() == 2
    with pytest.raises(Exception, match="different numbers of columns"):
        text.read_bags(spark, list(listed.values())).collect()


def test_names_and_lines(spark):
    assert spark.range(1).select(text.scale_file(F.lit("/a/"), F.lit("x_"), F.lit(0.6))).first()[0] == "/a/x_scale_0.600000.nii.gz"
    row = spark.range(1).selectExpr("'v' AS volume_id", "1L AS roi_id", "array(1.0D, 0.5D, 1234567.0D) AS values")
    assert text.sample_lines(row).first().line == "1,0.5,1.23457e+06"


def test_lines_of_whole_numbers(spark):
    row = spark.range(1).selectExpr("'v' AS volume_id", "1L AS roi_id", "array(0L, -7L, 999999L, 1000000L, 1234567L, 9007199254740993L) AS values")
    assert text.sample_lines(row).first().line == "0,-7,999999,1000000,1234567,9007199254740993"


def test_saved_tables_can_go(spark):
    before = saving.written()
    one, two = saving.saved(spark.range(5)), saving.saved(spark.range(7))
    assert one.count() == 5 and saving.written() == before + 2
    saving.drop_saved(spark, before, but_last=True)
    assert two.count() == 7 and saving.written() == before + 1
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(one.inputFiles()[0]).count()
    saving.drop_saved(spark, before)
    assert saving.written() == before


def test_images_of_any_kind(spark, tmp_path):
    head = "NRRD0004\n# made here\ntype: short\ndimension: 3\nsizes: 4 3 2\nencoding: gzip\nendian: little\nspace directions: (0.5,0,0) (0,1,0) (0,0,3)\nspace origin: (1,2,3)\n\n"
    files = {
        "a.hr2": volumes.hr2_bytes(A, (1, 2, 3), (0.5, 1, 3)),
        "b.nii.gz": volumes.nifti_bytes(A.astype("i2"), (0.5, 1, 3), (1, 2, 3)),
        "c.mha": volumes.metaimage_bytes(A.astype("i2"), (0.5, 1, 3), (1, 2, 3)),
        "d.mha": volumes.metaimage_bytes(A, (0.5, 1, 3), (1, 2, 3), compressed=False),
        "e.nrrd": head.encode() + gzip.compress(A.astype("<i2").tobytes()),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    for name in files:
        assert np.array_equal(grid(volumes.read_images(spark, str(tmp_path / name))), A)
    for g in volumes.image_geometry(spark, str(tmp_path / "*")).collect():
        assert (g["size"], g.origin, g.spacing) == ([4, 3, 2], [1.0, 2.0, 3.0], [0.5, 1.0, 3.0])
    for r in tools.convert_images(spark, str(tmp_path / "*")).collect():
        made, values = volumes.parse_nifti(bytes(r.content))
        assert made["spacing"] == [0.5, 1.0, 3.0] and np.array_equal(values, A)
    for broken in (head.encode().replace(b"short", b"block"), files["c.mha"].replace(b"LOCAL", b"x.raw"), files["d.mha"][:-9]):
        with pytest.raises(ValueError):
            volumes.parse_image(broken)


SYNTAXES = ["1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70"]


def test_pixels_of_every_transfer_syntax(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.integers(-900, 1200, (7, 9, 11))
    values[:, :3] = -1000
    for z, syntax in enumerate(SYNTAXES):
        # Slices lie along the first axis, the other way round, in planes of the other two.
        more = {"orientation": "0\\1\\0\\0\\0\\1", "patient": " P7 ", "study_date": "20200130", "kernel": "B.70f", "spacing": "0.5\\0.75", "number": str(z)}
        (tmp_path / f"s{z}.dcm").write_bytes(volumes.dicom_bytes(values[z], "1.2.9", "20200131", [-2.5 * z, 4.0, 5.0], syntax=syntax, **more))
    got = grid(volumes.read_dicom(spark, str(tmp_path / "*.dcm")))
    assert np.array_equal(got, values[::-1])
    made = tools.convert_dicom(spark, str(tmp_path / "*.dcm")).collect()
    assert [(r.volume_id, r.name) for r in made] == [("1.2.9_20200131", "P7_20200130_B.70f_2_500000")]
    header, back = volumes.parse_nifti(bytes(made[0].content))
    assert header == {"size": [11, 9, 7], "origin": [-15.0, 4.0, 5.0], "spacing": [0.75, 0.5, 2.5]} and np.array_equal(back, values[::-1])


def test_character_sets_of_text():
    data = volumes.dicom_bytes(A[0], "1.2", "20200131", 4.0, patient="Ä中", kernel="é")
    assert [volumes.parse_dicom(data)[k] for k in ("patient", "kernel")] == ["Ä中", "é"]
    assert b"ISO_IR" not in volumes.dicom_bytes(A[0], "1.2", "20200131", 4.0, patient="A")
    greek = volumes.dicom_bytes(A[0], "1.2", "20200131", 4.0, patient="Äb").replace(b"ISO_IR 192", b"ISO_IR 126").replace("Ä".encode(), b"\xe1\xe2")
    assert volumes.parse_dicom(greek)["patient"] == "αβb"


def test_broken_compressed_pixels():
    whole = volumes.dicom_bytes(A[0], "1", "2", 3.0, syntax=SYNTAXES[6])
    for broken, why in ((whole.replace(b"\xff\xc3", b"\xff\xc2"), "lossless"), (volumes.dicom_bytes(A[0], "1", "2", 3.0, syntax="1.2.840.10008.1.2.4.50"), "isn't read")):
        with pytest.raises(ValueError, match=why):
            volumes.parse_dicom(broken)
    stream = jpeg_bytes(np.arange(300, dtype=np.uint16).reshape(20, 15))
    with pytest.raises(ValueError, match="end early|isn't known"):
        jpeg_values(stream[:-120])


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg(predictor):
    rng = np.random.default_rng(predictor)
    for shape in ((1, 1), (3, 5), (17, 9)):
        for values in (rng.integers(0, 65536, shape), rng.integers(0, 40, shape) + 32750, np.zeros(shape), np.full(shape, 65535)):
            v = values.astype(np.uint16)
            assert np.array_equal(jpeg_values(jpeg_bytes(v, predictor)), v) and np.array_equal(jpeg_values(jpeg_bytes(v, predictor, 2)), v)


def test_run_lengths():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"aab", b"a" * 129, bytes(rng.integers(0, 3, 1000).astype(np.uint8)), bytes(range(256)) * 2 + b"z" * 300):
        assert unpacked(packed(data)) == data
    # An example of the public description of the scheme.
    assert unpacked(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("compressed", [True, False])
def test_nrrd_round_trip(compressed):
    head, values = volumes.parse_image(volumes.nrrd_bytes(A.astype("f4"), (0.5, 1.0, 2.0), (1.0, 2.0, 3.0), compressed))
    assert head == {"size": [4, 3, 2], "origin": [1.0, 2.0, 3.0], "spacing": [0.5, 1.0, 2.0]} and np.array_equal(values, A)
