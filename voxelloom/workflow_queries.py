"""More queries over the lattices of ``queries``: components, summed volumes, recursive smoothing, files and whole workflows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from voxelloom.functions import tables
from voxelloom.operators import bag, brick_tables, components, roi, stencil
from voxelloom.operators.lattice import KEYS
from voxelloom.operators.resample import index_map
from voxelloom.plans import saving, tools
from voxelloom.queries import _DENSE, _LONG_VOX, _TIED_SQL, DIGITS, EDGES, FEATURES, SCALES, SIZE, _as_files, _bin_sql, _dense, _edges_sql, _features_sql, _long_vox, _random_sql, _read, _rounded, _vox, query, vox
from voxelloom.sources import files, text, volumes
from voxelloom.streaming import edges


def _components_sql(mask: str, near: str, select: str) -> str:
    """Components by reaching from every voxel over all its neighbours."""
    return _vox(select, f"""on_ AS (SELECT x, y, z, (z * 8 + y) * 16 + x AS place FROM vox WHERE {mask}),
near AS (SELECT a.place AS a, b.place AS b FROM on_ a JOIN on_ b ON {near} AND a.place <> b.place),
reached AS (SELECT place, place AS root FROM on_ UNION SELECT near.b, reached.root FROM reached JOIN near ON near.a = reached.place),
least AS (SELECT place, min(root) AS root FROM reached GROUP BY 1),
numbered AS (SELECT on_.*, dense_rank() OVER (ORDER BY root) AS label FROM on_ JOIN least USING (place))""").replace("WITH ", "WITH RECURSIVE ", 1)


_OBJECTS = "SELECT 'all' AS volume_id, label, count(*) AS n_voxels, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM numbered GROUP BY label"
_FACES = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"
_CORNERS_TOO = "greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) = 1"


@query(_components_sql("m = 1", _FACES, _OBJECTS))
def component_objects_faces(spark, sf_dir):
    """Bricks of four voxels, so that components go through many."""
    return components.component_objects(vox(spark, sf_dir).filter("m = 1"), neighbours=6, side=4)


@query(_components_sql("CAST(v AS BIGINT) % 9 = 1", _CORNERS_TOO, _OBJECTS))
def component_objects_corners(spark, sf_dir):
    return components.component_objects(vox(spark, sf_dir).withColumn("m", (F.col("v").cast("long") % 9 == 1).cast("int")), neighbours=26, side=4)


@query(_components_sql("m = 2", _FACES, "SELECT v.volume_id, v.x, v.y, v.z, coalesce(label, 0) AS label FROM vox v LEFT JOIN numbered USING (x, y, z)"))
def components_labelled(spark, sf_dir):
    """Links are contracted in rounds here, whatever their number."""
    v = vox(spark, sf_dir).withColumn("on", (F.col("m") == 2).cast("int"))
    return components.labelled_components(v, "on", 6, side=4, few=0).select("volume_id", "x", "y", "z", "label")


@query(_vox(f"""SELECT r.volume_id, r.roi_id, CAST(s.i AS INTEGER) AS bin, CAST(count(v.x) AS BIGINT) AS n FROM rois r CROSS JOIN range({len(EDGES) + 1}) s(i)
LEFT JOIN (SELECT *, {_bin_sql("v", EDGES)} AS bin FROM vox WHERE m <> 0) v ON v.bin = s.i AND v.x >= r.x0 AND v.x < r.x0 + r.sx AND v.y >= r.y0 AND v.y < r.y0 + r.sy AND v.z >= r.z0 AND v.z < r.z0 + r.sz GROUP BY 1, 2, 3""",
    "rois AS (SELECT volume_id, (z * 8 + y) * 16 + x AS roi_id, x - 2 AS x0, y - 3 AS y0, z - 1 AS z0, 1 + x AS sx, 2 + y AS sy, 1 + z + x % 3 AS sz FROM vox WHERE m = 1)"))
def bag_intensity_boxes(spark, sf_dir):
    """Boxes of many sizes, some partly outside of the lattice."""
    v = vox(spark, sf_dir)
    boxes = v.filter("m = 1").selectExpr("volume_id", "(z * 8 + y) * 16 + x AS roi_id", "x - 2 AS x0", "y - 3 AS y0", "z - 1 AS z0", "1 + x AS sx", "2 + y AS sy", "1 + z + x % 3 AS sz")
    return bag.intensity_bag(boxes, v, EDGES, by_sums=True).select("volume_id", "roi_id", "bin", "n")


@query(_vox("""SELECT volume_id, roi_id, CAST(arg_max(label, n * 1000 - label) AS INTEGER) AS label FROM (SELECT r.volume_id, r.roi_id, v.m AS label, count(*) AS n FROM rois r JOIN vox v ON v.x >= r.x0 AND v.x < r.x0 + r.sx AND v.y >= r.y0 AND v.y < r.y0 + r.sy AND v.z >= r.z0 AND v.z < r.z0 + r.sz GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "rois AS (SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY z, y, x) - 1 AS roi_id, x - 1 AS x0, y - 1 AS y0, z - 1 AS z0, 3 AS sx, 3 AS sy, 3 AS sz FROM vox WHERE m <> 0 AND x >= 1 AND x <= 14 AND y >= 1 AND y <= 6 AND z >= 1 AND z <= 5)"))
def roi_labels_joined(spark, sf_dir):
    """Labels of boxes by the join, as for few boxes."""
    v = vox(spark, sf_dir)
    return roi.labels(_dense(v), v, by_sums=False)


#: Boxes of 41 voxels along the lattice that grows.
_WIDE = (41, 5, 5)


def _moving(columns: list[str]) -> str:
    """Sums of columns over the wide boxes around every place, by moving frames along one axis after the other."""
    out, last = [], "s"
    for a, b in zip("xyz", _WIDE, strict=True):
        others = ", ".join(o for o in "xyz" if o != a)
        sums = ", ".join(f"CAST(sum({c}) OVER (PARTITION BY {others} ORDER BY {a} ROWS BETWEEN {b // 2} PRECEDING AND {b // 2} FOLLOWING) AS BIGINT) AS {c}" for c in columns)
        out.append(f"s{a} AS (SELECT x, y, z, m, {sums} FROM {last})")
        last = f"s{a}"
    return ",\n".join(out)


_WIDE_FITS = "m <> 0 AND x >= 20 AND x + 20 <= (SELECT max(x) FROM sz) AND y BETWEEN 2 AND 5 AND z BETWEEN 2 AND 4"


@query(f"""WITH {_LONG_VOX}, s AS (SELECT *, {", ".join(f"CASE WHEN m = {k} THEN 1 ELSE 0 END AS n{k}" for k in range(3))} FROM vox),
{_moving(["n0", "n1", "n2"])},
b AS (SELECT CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS label FROM sz WHERE {_WIDE_FITS})
SELECT CAST(label AS INTEGER) AS label, count(*) AS boxes FROM b GROUP BY 1""")
def roi_labels_growing(spark, sf_dir):
    """How many boxes, 41 voxels long, have each label."""
    v, n = _long_vox(spark, sf_dir)
    found = roi.labels(roi.dense_rois(v, _WIDE, (n, 8, 7), by_place=True), v)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("boxes"))


@query(f"""WITH {_LONG_VOX}, s AS (SELECT *, {", ".join(f"CASE WHEN m <> 0 AND {_bin_sql('v', [10.0, 40.0])} = {k} THEN 1 ELSE 0 END AS n{k}" for k in range(3))} FROM vox),
{_moving(["n0", "n1", "n2"])}
SELECT y, z, count(*) AS boxes, {", ".join(f"CAST(sum(n{k}) AS BIGINT) AS n{k}" for k in range(3))} FROM sz WHERE {_WIDE_FITS} GROUP BY 1, 2""")
def bag_intensity_growing(spark, sf_dir):
    """Sums by line of the bag of boxes that are 41 voxels long."""
    v, n = _long_vox(spark, sf_dir)
    found = bag.intensity_bag(roi.dense_rois(v, _WIDE, (n, 8, 7), by_place=True), v, [10.0, 40.0])
    y, z = F.expr(f"roi_id div {n} % 8"), F.expr(f"roi_id div {n * 8}")
    return found.groupBy(y.alias("y"), z.alias("z")).agg(F.count_distinct("roi_id").alias("boxes"), *[F.sum(F.when(F.col("bin") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(3)])


def _recursive_matrix(n: int, sigma: float) -> np.ndarray:
    """What the recursive filter makes of a line of n voxels whose ends repeat, from its impulse response."""
    kernel = np.array(stencil.recursive_kernel(sigma, least=1e-14))
    radius, out = len(kernel) // 2, np.zeros((n, n))
    for i in range(n):
        np.add.at(out[i], np.clip(np.arange(i - radius, i + radius + 1), 0, n - 1), kernel)
    return out


def _recursive_sql(source: str, columns: list[str], sigma: float, name: str) -> str:
    """Columns smoothed along all axes as products with the response's matrices."""
    out, last = [], source
    for a, n in zip("xyz", SIZE, strict=True):
        weights = ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for i, row in enumerate(_recursive_matrix(n, sigma)) for j, w in enumerate(row))
        others = ", ".join(f"s.{o}" for o in "xyz" if o != a)
        sums = ", ".join(f"sum(w.w * s.{c}) AS {c}" for c in columns)
        out.append(f"{name}w{a}(i, j, w) AS (VALUES {weights}), {name}{a} AS (SELECT {others}, CAST(w.i AS BIGINT) AS {a}, {sums} FROM {last} s JOIN {name}w{a} w ON w.j = s.{a} GROUP BY {others}, w.i)")
        last = f"{name}{a}"
    return ",\n".join(out)


@query(_vox("SELECT x, y, z, round(v, 4) + 0.0 AS v FROM rz", _recursive_sql("vox", ["v"], 2.5, "r")))
def gauss_recursive(spark, sf_dir):
    return stencil.gaussian_smooth(vox(spark, sf_dir), ["v"], 2.5, recursive=True).select("x", "y", "z", _rounded("v", 4))


_TWO = [(0.75, 0), (3.0, 1)]


@query(_vox(" UNION ALL ".join(f'SELECT v.x, v.y, v.z, CAST({s!r} AS DOUBLE) AS scale, round(CASE WHEN v.m <> 0 THEN r.cv / r.cc ELSE 0.0 END, 3) + 0.0 AS "GaussianBlur" FROM vox v JOIN r{i}z r USING (x, y, z)' for s, i in _TWO),
    "certain AS (SELECT *, CASE WHEN m <> 0 THEN v ELSE 0.0 END AS cv, CASE WHEN m <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cc FROM vox),\n" + ",\n".join(_recursive_sql("certain", ["cv", "cc"], s, f"r{i}") for s, i in _TWO)))
def norm_conv_recursive(spark, sf_dir):
    """Two scales in the same passes; at the wider one each voxel takes from the whole lattice."""
    return tools.masked_normalized_convolution(vox(spark, sf_dir), [s for s, _ in _TWO], recursive=True).select("x", "y", "z", "scale", _rounded("GaussianBlur", 3))


_SYNTAXES = ["1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2"]


def _dicom_files(spark, sf_dir):
    """Every slice of each flag's lattice as a DICOM file, in a syntax of its own; slices lie across the first axis.

    Files keep neither blanks at a text's ends nor nulls: flags stand in angle brackets there, and a null flag is an empty text.
    """

    def written(frame):
        import pandas as pd

        z, flag = int(frame["z"].iloc[0]), frame["volume_id"].iloc[0]
        marked = "" if flag is None else f"<{flag}>"
        # Remainders have their dividend's sign, as SQL's have.
        grid = np.fmod(frame.pivot(index="y", columns="x", values="v").to_numpy(), 1000)
        more = {"orientation": "0\\1\\0\\0\\0\\1", "patient": f" {marked}{np.fmod(frame['v'].sum(), 7)} ", "study_date": "19990102", "kernel": "B70f"}
        content = volumes.dicom_bytes(grid, marked, "20200101", [1.25 * z, 3.0, 4.0], syntax=_SYNTAXES[z], **more)
        return pd.DataFrame({"path": [f"{marked}-{z}"], "content": [content]})

    v = vox(spark, sf_dir, by_flag=True).withColumn("v", F.rint("v").cast("long"))
    return v.groupBy("volume_id", "z").applyInPandas(written, "path string, content binary")


def _unmarked(name: str):
    """Names that begin with a flag in angle brackets, without these; null if they don't."""
    return F.when(F.col(name).startswith("<"), F.regexp_replace(name, "(?s)^<(.*)>", "$1")).alias(name)


_BY_FLAG = """cells AS (
  SELECT l_returnflag AS volume_id, l_partkey % 16 AS x, l_suppkey % 8 AS y, CAST(l_linenumber - 1 AS BIGINT) AS z, CAST(sum(l_quantity) AS DOUBLE) AS v, CAST(CAST(sum(l_quantity) AS BIGINT) % 3 AS INTEGER) AS m FROM lineitem GROUP BY 1, 2, 3, 4),
vox AS (
  SELECT g.volume_id, CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z, coalesce(v, 0.0) AS v, coalesce(m, 0) AS m
  FROM (SELECT DISTINCT volume_id FROM cells) g CROSS JOIN range(16) a(i) CROSS JOIN range(8) b(i) CROSS JOIN range(7) c(i)
  LEFT JOIN cells ON cells.volume_id = g.volume_id AND cells.x = a.i AND cells.y = b.i AND cells.z = c.i)"""


@query(f"WITH {_BY_FLAG} SELECT volume_id || '_20200101' AS volume_id, x, y, z, CAST(CAST(v AS BIGINT) % 1000 AS DOUBLE) AS v FROM vox")
def dicom_compressed(spark, sf_dir):
    """Run lengths, both lossless JPEGs, big-endian, deflated and plain slices of one series assembled."""
    return volumes.series_volumes(volumes.dicom_slices(_dicom_files(spark, sf_dir))).withColumn("volume_id", _unmarked("volume_id"))


@query(f"WITH {_BY_FLAG} SELECT volume_id || '_20200101' AS volume_id, [0.0, 3.0, 4.0] AS origin, [1.0, 1.0, 1.25] AS spacing, volume_id || (CAST(sum(CAST(v AS BIGINT)) AS BIGINT) % 7) || '_19990102_B70f_1_250000' AS name FROM vox WHERE z = 0 GROUP BY volume_id")
def dicom_names(spark, sf_dir):
    return volumes.dicom_geometry(_dicom_files(spark, sf_dir)).select(_unmarked("volume_id"), "origin", "spacing", _unmarked("name"))


def _folder(spark, name: str) -> str:
    return f"{saving.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SAMPLES = 150
_SAMPLED = " UNION ALL ".join(f'SELECT CAST({j * 8 + i} AS INTEGER) AS g, "{c}" + 0.0 AS v FROM f{j} JOIN drawn USING (volume_id, x, y, z) WHERE drawn.again = {j}' for j in range(len(SCALES)) for i, c in enumerate(FEATURES))


@query(f"""WITH RECURSIVE {_BY_FLAG}, {_features_sql(SCALES[0], 0)}, {_features_sql(SCALES[1], 1)},
ranked AS (SELECT volume_id, x, y, z, row_number() OVER (PARTITION BY volume_id ORDER BY z, y, x) - 1 AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM vox WHERE m <> 0),
drawn AS (SELECT r.volume_id, r.x, r.y, r.z, a.i AS again FROM range({_SAMPLES}) t(i) CROSS JOIN range({len(SCALES)}) a(i) JOIN ranked r ON r.k = CAST('0x' || substr(md5(concat_ws(',', t.i, a.i, 1)), 1, 15) AS BIGINT) % r.n),
{_edges_sql(_SAMPLED, 6)} SELECT g AS hist_idx, list(round(edge, 4) + 0.0 ORDER BY k) AS edges FROM s WHERE k > 0 GROUP BY 1""")
def determine_edges_of_files(spark, sf_dir):
    """Images and masks of three volumes as files, a list of their pairs, and edges of samples that are drawn anew for each image and scale."""
    v, folder = vox(spark, sf_dir, by_flag=True), _folder(spark, "images")
    for column, kind in (("v", "f8"), ("m", "u1")):
        made = volumes.nifti_files(v.select(*KEYS, column), column, kind)
        files.write_files(made.select(F.concat(F.lit(f"{column}-"), "volume_id", F.lit(".nii.gz")).alias("name"), "content"), folder)
    lines = v.select("volume_id").distinct().select(F.format_string(f" {folder}/v-%s.nii.gz , {folder}/m-%s.nii.gz", "volume_id", "volume_id").alias("line"))
    text.write_lines(lines, f"{folder}/list", ["line"])
    found = tools.determine_edges(volumes.pair_voxels(spark, text.read_pairs(spark, f"{folder}/list")), SCALES, 6, samples=_SAMPLES)
    return found.select("hist_idx", F.transform("edges", lambda e: F.round(e, 4) + F.lit(0.0)).alias("edges"))


@query(_vox(" UNION ALL ".join(f"SELECT 'all_scale_0.500000{c}.nii.gz' AS name, x, y, z, round(\"{c}\", {DIGITS[c]}) + 0.0 AS v FROM f0" for c in FEATURES), _features_sql(0.5, 0)))
def feature_files(spark, sf_dir):
    """The features as files, one each, and these read again."""
    folder = _folder(spark, "features")
    tools.write_features(vox(spark, sf_dir), [0.5], folder, kind="f8")
    name = F.regexp_extract("volume_id", "[^/]+$", 0)
    digits = F.when(name.contains("GaussianCurvature"), F.round("v", DIGITS["GaussianCurvature"])).otherwise(F.round("v", 4))
    return files.read_slabs(spark, folder).select(name.alias("name"), "x", "y", "z", (digits + F.lit(0.0)).alias("v"))


@query(f"WITH {_BY_FLAG} SELECT volume_id || '.nii' AS name, x, y, z, v FROM vox WHERE z BETWEEN 2 AND 4")
def volume_slabs(spark, sf_dir):
    """Three slices of plain files: only their bytes are read."""
    folder = _folder(spark, "plain")
    made = volumes.nifti_files(vox(spark, sf_dir, by_flag=True), kind="f8", compressed=False)
    files.write_files(made.select(F.concat("volume_id", F.lit(".nii")).alias("name"), "content"), folder)
    return files.read_slabs(spark, folder, slab_bytes=4096, z=(2, 4)).select(F.regexp_extract("volume_id", "[^/]+$", 0).alias("name"), "x", "y", "z", "v")


@query(_vox("SELECT roi_id, x0, y0, z0, sx, sy, sz FROM rois", "rois AS (SELECT row_number() OVER (ORDER BY z, y, x) - 1 AS roi_id, x - 1 AS x0, y - 1 AS y0, z - 1 AS z0, CAST(3 AS BIGINT) AS sx, CAST(3 AS BIGINT) AS sy, CAST(3 AS BIGINT) AS sz FROM vox WHERE m <> 0 AND x >= 1 AND x <= 14 AND y >= 1 AND y <= 6 AND z >= 1 AND z <= 5)"))
def roi_files(spark, sf_dir):
    """Regions as a text file of their volume, and that read again."""
    folder = _folder(spark, "rois")
    files.write_files(files.text_files(text.roi_lines(_dense(vox(spark, sf_dir))), F.concat("volume_id", F.lit("1.ROIInfo"))), folder)
    return text.read_rois(spark, f"{folder}/all1.ROIInfo").drop("volume_id")


def _saved_lattices(spark, sf_dir):
    v, name = vox(spark, sf_dir, by_flag=True), uuid.uuid4().hex
    return [brick_tables.save_lattice(v.select(*KEYS, c), f"{c}_{name}", 8, brick=4) for c in ("v", "m")]


@query(f"WITH {_BY_FLAG} SELECT volume_id, x, y, z, v, m FROM vox")
def bricks_joined(spark, sf_dir):
    """An image and its mask saved by brick, joined where they lie."""
    return brick_tables.joined(*_saved_lattices(spark, sf_dir)).drop("brick")


@query(f"""WITH {_BY_FLAG}, rois AS (SELECT l_returnflag AS volume_id, l_orderkey AS roi_id, l_partkey % 16 - 2 AS x0, l_suppkey % 8 - 1 AS y0, l_linenumber - 2 AS z0, 1 + l_orderkey % 9 AS sx, 1 + l_orderkey % 5 AS sy, 1 + l_orderkey % 3 AS sz FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 50 = 0)
SELECT r.volume_id, r.roi_id, count(*) AS n, sum(v.v) AS total FROM rois r JOIN vox v ON v.volume_id = r.volume_id AND v.x >= r.x0 AND v.x < r.x0 + r.sx AND v.y >= r.y0 AND v.y < r.y0 + r.sy AND v.z >= r.z0 AND v.z < r.z0 + r.sz GROUP BY 1, 2""")
def bricks_boxed(spark, sf_dir):
    """Boxes made of line items, which go to the voxels of a lattice that is saved by brick."""
    image, _ = _saved_lattices(spark, sf_dir)
    rois = _read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_orderkey % 50 = 0").selectExpr(
        "l_returnflag AS volume_id", "l_orderkey AS roi_id", "l_partkey % 16 - 2 AS x0", "l_suppkey % 8 - 1 AS y0", "l_linenumber - 2 AS z0", "1 + l_orderkey % 9 AS sx", "1 + l_orderkey % 5 AS sy", "1 + l_orderkey % 3 AS sz"
    )
    return brick_tables.boxed(rois, image, brick=4).groupBy("volume_id", "roi_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


#: A grid turned by 30 degrees around z, and one that isn't.
_COS, _SIN = float(np.cos(np.pi / 6)), float(np.sin(np.pi / 6))
_TURNED = {"origin": [1.0, -2.0, 0.5], "spacing": [0.75, 0.5, 1.25], "direction": [[_COS, -_SIN, 0.0], [_SIN, _COS, 0.0], [0.0, 0.0, 1.0]]}
_STRAIGHT = {"origin": [-1.0, 0.5, 0.0], "spacing": [1.0, 0.8, 1.5]}
_TURNED_SIZE = (22, 18, 6)


def _turned_sql() -> str:
    matrix, offset = index_map(_STRAIGHT, _TURNED)
    at = ", ".join(f"round({float(matrix[i, 0])!r}::DOUBLE * a.i + {float(matrix[i, 1])!r}::DOUBLE * b.i + {float(matrix[i, 2])!r}::DOUBLE * c.i + {float(offset[i])!r}::DOUBLE, 9) AS p{x}" for i, x in enumerate("xyz"))
    weight = lambda c, x: f"(CASE WHEN {c}.d = 0 THEN 1 - (p{x} - floor(p{x})) ELSE p{x} - floor(p{x}) END)"
    inside = " AND ".join(f"p{x} BETWEEN 0 AND {n - 1}" for x, n in zip("xyz", SIZE, strict=True))
    met = " AND ".join(f"v.{x} = least(floor(p{x}) + {c}.d, {n - 1})" for x, c, n in zip("xyz", "def", SIZE, strict=True))
    nx, ny, nz = _TURNED_SIZE
    return _vox(f"""SELECT g.x, g.y, g.z, round(coalesce(sum(v.v * {weight("d", "x")} * {weight("e", "y")} * {weight("f", "z")}), -1.0), 6) + 0.0 AS v
FROM g CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) d CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) e CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) f LEFT JOIN vox v ON {inside} AND {met} GROUP BY 1, 2, 3""",
        f"g AS (SELECT CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z, {at} FROM range({nx}) a(i) CROSS JOIN range({ny}) b(i) CROSS JOIN range({nz}) c(i))")


@query(_turned_sql())
def resample_oriented(spark, sf_dir):
    """Onto a turned grid, in bricks of eight voxels."""
    found = tools.resample(vox(spark, sf_dir), SIZE, _TURNED_SIZE, align="physical", source=_STRAIGHT, target=_TURNED, outside=-1.0, side=8)
    return found.select("x", "y", "z", _rounded("v"))


@query(_TIED_SQL.replace("{B}", "7").replace("l_returnflag", "l_linenumber").replace("SELECT g AS l_linenumber", "SELECT CAST(g AS INTEGER) AS hist_idx"))
def edges_arriving(spark, sf_dir):
    """Quantities of each line number that arrive in three batches: edges after the last are those of all."""
    folder = _folder(spark, "arriving")
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("hist_idx"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") % 3).alias("third"))
    for k in range(3):
        rows.filter(F.col("third") == k).drop("third").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("hist_idx int, value double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    edges.keep_runs(stream, f"{folder}/runs", f"{folder}/state", parts=4).awaitTermination()
    return edges.edges_so_far(spark, f"{folder}/runs", 7)


def _view(rows) -> str:
    name = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    return name


_BOX_AND_SIZE = "ARRAY(3, 3, 3), ARRAY(16, 8, 7)"


@query(_vox("SELECT * FROM rois", _random_sql(50, "m <> 0")))
def sql_random_rois(spark, sf_dir):
    """Random regions by a table function."""
    tables.register(spark)
    return spark.sql(f"SELECT * FROM random_rois(TABLE({_view(vox(spark, sf_dir))}) PARTITION BY (volume_id), 50, {_BOX_AND_SIZE}, 1)")


@query(_vox("SELECT * FROM rois", _DENSE))
def sql_dense_rois(spark, sf_dir):
    tables.register(spark)
    return spark.sql(f"SELECT * FROM dense_rois(TABLE({_view(vox(spark, sf_dir))}) PARTITION BY (volume_id) ORDER BY (z, y, x), {_BOX_AND_SIZE})")


@query(_TIED_SQL.replace("{B}", "7").replace("SELECT g AS l_returnflag", "SELECT g AS hist_idx"))
def sql_edges(spark, sf_dir):
    """Edges by a table function, of values that SQL counts before."""
    tables.register(spark)
    rows = _view(_read(spark, sf_dir, "lineitem"))
    return spark.sql(f"SELECT * FROM equalised_edges(TABLE(SELECT l_returnflag AS hist_idx, l_quantity AS value, count(*) AS n FROM {rows} GROUP BY 1, 2) PARTITION BY (hist_idx), 7)")


@query(_vox("SELECT volume_id, x, y, z, v FROM vox"))
def read_nrrd(spark, sf_dir):
    return volumes.parsed(_as_files(spark, sf_dir, volumes.nrrd_bytes), volumes.parse_image)


@query(f"WITH {_BY_FLAG}, named AS (SELECT volume_id, volume_id || (CAST(sum(CAST(v AS BIGINT)) AS BIGINT) % 7) || '_19990102_B70f_1_250000' AS name FROM vox WHERE z = 0 GROUP BY 1) SELECT name AS volume_id, x, y, z, CAST(CAST(v AS BIGINT) % 1000 AS DOUBLE) AS v FROM vox JOIN named USING (volume_id)")
def dicom_converted(spark, sf_dir):
    """A folder of DICOM files as volume files, named by their tags, and these read."""
    folder = _folder(spark, "dicom")
    files.write_files(_dicom_files(spark, sf_dir).select(F.concat("path", F.lit(".dcm")).alias("name"), "content"), folder)
    made = tools.convert_dicom(spark, folder, "*.dcm").withColumn("name", _unmarked("name")).filter("name IS NOT NULL")
    return volumes.parsed(made.select(F.col("name").alias("path"), "content"), volumes.parse_nifti)


_STEPS = " UNION ALL ".join(f"SELECT a.place AS a, b.place AS b FROM on_ a JOIN on_ b ON {' AND '.join(f'b.{c} = a.{c} + {d if c == axis else 0}' for c in 'xyz')}" for axis in "xyz" for d in (1, -1))


@query(f"""WITH RECURSIVE {_LONG_VOX}, on_ AS (SELECT x, y, z, x * 56 + y * 7 + z AS place FROM vox WHERE m = 1),
near AS ({_STEPS}),
reached AS (SELECT place, place AS root FROM on_ UNION SELECT near.b, reached.root FROM reached JOIN near ON near.a = reached.place),
least AS (SELECT place, min(root) AS root FROM reached GROUP BY 1),
sizes AS (SELECT root, count(*) AS n_voxels, max(x) - min(x) + 1 AS length FROM least JOIN on_ USING (place) GROUP BY 1)
SELECT n_voxels, length, count(*) AS components FROM sizes GROUP BY 1, 2""")
def component_sizes_growing(spark, sf_dir):
    """How many components of the lattice that grows have so many voxels and are so long."""
    v = _long_vox(spark, sf_dir)[0].filter("m = 1")
    found = components.component_objects(v, neighbours=6)
    return found.groupBy("n_voxels", (F.col("max_x") - F.col("min_x") + 1).alias("length")).agg(F.count(F.lit(1)).alias("components"))
