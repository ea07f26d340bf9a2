"""The queries over volumes, regions, histograms and bags, on lattices made of the tables, and their SQL.

The lattice has 16 x 8 x 7 voxels: a line item's place is its part, supplier and
line number, its value their quantities' sum, its mask that sum modulo 3, and its
probability the share of returned items.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import eigen, pointwise, strings
from voxelloom.operators import bag, distance, histogram, lattice, roi, stencil
from voxelloom.plans import saving, tools
from voxelloom.sources import text, volumes

SIZE = (16, 8, 7)
BOX = (3, 3, 3)
EDGES = [100.0, 200.0, 300.0, 400.0, 500.0]
SCALES = [0.5, 0.75]
FEATURES = stencil.FEATURES
SPEC_EDGES = [-50.0, 0.0, 50.0, 250.0]
#: Decimals that both engines agree on, for each feature.
DIGITS = {c: 4 for c in FEATURES} | {"GaussianCurvature": 1}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vox(spark: SparkSession, sf_dir: str, by_flag: bool = False) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    place = {"x": F.col("l_partkey") % 16, "y": F.col("l_suppkey") % 8, "z": F.col("l_linenumber") - 1}
    values = {
        "v": F.sum("l_quantity"),
        "m": (F.sum("l_quantity").cast("long") % 3).cast("int"),
        "p": F.count_if(F.col("l_returnflag") == "A") / F.count(F.lit(1)),
    }
    return lattice.voxelise(rows, place, values, SIZE, {"v": 0.0, "m": 0, "p": 0.0}, F.col("l_returnflag") if by_flag else None)


def _rounded(c: str, digits: int = 6):
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


VOX = """cells AS (
  SELECT l_partkey % 16 AS x, l_suppkey % 8 AS y, CAST(l_linenumber - 1 AS BIGINT) AS z, CAST(sum(l_quantity) AS DOUBLE) AS v,
    CAST(CAST(sum(l_quantity) AS BIGINT) % 3 AS INTEGER) AS m,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS p
  FROM lineitem GROUP BY 1, 2, 3),
vox AS (
  SELECT 'all' AS volume_id, CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z, coalesce(v, 0.0) AS v, coalesce(m, 0) AS m, coalesce(p, 0.0) AS p
  FROM range(16) a(i) CROSS JOIN range(8) b(i) CROSS JOIN range(7) c(i)
  LEFT JOIN cells ON cells.x = a.i AND cells.y = b.i AND cells.z = c.i)"""
AXES = ("x", "y", "z")


def _over(axis: str) -> str:
    return f"PARTITION BY volume_id, {', '.join(a for a in AXES if a != axis)} ORDER BY {axis}"


def _shift(value: str, axis: str, k: int) -> str:
    if not k:
        return value
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    if k > 0:
        return f"coalesce(lead({value}, {k}) OVER ({_over(axis)}), last_value({value}) OVER ({_over(axis)} {frame}))"
    return f"coalesce(lag({value}, {-k}) OVER ({_over(axis)}), first_value({value}) OVER ({_over(axis)} {frame}))"


def _d(value: str, axis: str, order: int = 1) -> str:
    before, after = _shift(value, axis, -1), _shift(value, axis, 1)
    return f"({after} - {before}) / 2.0::DOUBLE" if order == 1 else f"({after} - 2.0::DOUBLE * {value} + {before}) / 1.0::DOUBLE"


def _derivatives_sql(source: str, value: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, {_d(value, "x")} AS dx, {_d(value, "x", 2)} AS hxx FROM {source}),
{name}2 AS (SELECT *, {_d(value, "y")} AS dy, {_d(value, "y", 2)} AS hyy, {_d("dx", "y")} AS hxy FROM {name}1),
{name} AS (SELECT *, {_d(value, "z")} AS dz, {_d(value, "z", 2)} AS hzz, {_d("dx", "z")} AS hxz, {_d("dy", "z")} AS hyz FROM {name}2)"""


def _eigen_sql(source: str, names: tuple[str, ...], name: str) -> str:
    a11, a12, a13, a22, a23, a33 = names
    pi = "3.141592653589793::DOUBLE"
    return f"""{name}1 AS (SELECT *, {a12}*{a12} + {a13}*{a13} + {a23}*{a23} AS off_, ({a11} + {a22} + {a33}) / 3.0::DOUBLE AS q_ FROM {source}),
{name}2 AS (SELECT *, CASE WHEN off_ = 0 THEN 1.0::DOUBLE ELSE sqrt((({a11}-q_)*({a11}-q_) + ({a22}-q_)*({a22}-q_) + ({a33}-q_)*({a33}-q_) + 2.0::DOUBLE*off_) / 6.0::DOUBLE) END AS p_ FROM {name}1),
{name}3 AS (SELECT *, (({a11}-q_)/p_ * (({a22}-q_)/p_) * (({a33}-q_)/p_) + 2.0::DOUBLE*({a12}/p_)*({a13}/p_)*({a23}/p_) - ({a23}/p_)*({a23}/p_)*(({a11}-q_)/p_) - ({a13}/p_)*({a13}/p_)*(({a22}-q_)/p_) - ({a12}/p_)*({a12}/p_)*(({a33}-q_)/p_)) / 2.0::DOUBLE AS r_ FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN r_ <= -1 THEN {pi}/3.0::DOUBLE WHEN r_ >= 1 THEN 0.0::DOUBLE ELSE acos(r_)/3.0::DOUBLE END AS f_ FROM {name}3),
{name}5 AS (SELECT *, q_ + 2.0::DOUBLE*p_*cos(f_) AS hi_, q_ + 2.0::DOUBLE*p_*cos(f_ + 2.0::DOUBLE*{pi}/3.0::DOUBLE) AS lo_ FROM {name}4),
{name}6 AS (SELECT *, CASE WHEN off_ = 0 THEN {a11} ELSE hi_ END AS a_, CASE WHEN off_ = 0 THEN {a22} ELSE 3.0::DOUBLE*q_ - hi_ - lo_ END AS b_, CASE WHEN off_ = 0 THEN {a33} ELSE lo_ END AS c_ FROM {name}5),
{name}7 AS (SELECT * EXCLUDE (a_, b_), CASE WHEN abs(a_) < abs(b_) THEN b_ ELSE a_ END AS a_, CASE WHEN abs(a_) < abs(b_) THEN a_ ELSE b_ END AS b_ FROM {name}6),
{name}8 AS (SELECT * EXCLUDE (b_, c_), CASE WHEN abs(b_) < abs(c_) THEN c_ ELSE b_ END AS b_, CASE WHEN abs(b_) < abs(c_) THEN b_ ELSE c_ END AS c_ FROM {name}7),
{name} AS (SELECT * EXCLUDE (a_, b_, c_), CASE WHEN abs(a_) < abs(b_) THEN b_ ELSE a_ END AS e1, CASE WHEN abs(a_) < abs(b_) THEN a_ ELSE b_ END AS e2, c_ AS e3 FROM {name}8)"""


def _smooth_sql(source: str, columns: list[str], sigma: float, name: str) -> str:
    kernel = stencil.gaussian_kernel(sigma)
    radius = len(kernel) // 2
    out, last = [], source
    for i, axis in enumerate(AXES):
        terms = ", ".join("0.0::DOUBLE + " + " + ".join(f"{w!r}::DOUBLE * {_shift(c, axis, k)}" for k, w in zip(range(-radius, radius + 1), kernel, strict=True)) + f" AS {c}" for c in columns)
        this = name if i == 2 else f"{name}_{axis}"
        out.append(f"{this} AS (SELECT * EXCLUDE ({', '.join(columns)}), {terms} FROM {last})")
        last = this
    return ",\n".join(out)


def _blur_sql(source: str, sigma: float, name: str) -> str:
    """Normalised convolution of v with the mask for certainty, as GaussianBlur."""
    return f"""{name}0 AS (SELECT *, CASE WHEN m <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mm FROM {source}),
{name}c AS (SELECT *, v * mm AS cv, mm AS cc FROM {name}0),
{_smooth_sql(f"{name}c", ["cv", "cc"], sigma, f"{name}s")},
{name} AS (SELECT * EXCLUDE (cv, cc), CASE WHEN cc <> 0 THEN cv / cc ELSE 3.4028234663852886e38::DOUBLE END AS "GaussianBlur" FROM {name}s)"""


def _features_sql(sigma: float, i: int) -> str:
    n = f"f{i}"
    masked = ", ".join(f'CASE WHEN mm <> 0 THEN {e} ELSE 0.0::DOUBLE END AS "{c}"' for c, e in zip(FEATURES, ('"GaussianBlur"', "sqrt(dx*dx + dy*dy + dz*dz)", "e1", "e2", "e3", "e1 + e2 + e3", "e1 * e2 * e3", "sqrt(e1*e1 + e2*e2 + e3*e3)"), strict=True))
    return f"""{_blur_sql("vox", sigma, n + "b")},
{_derivatives_sql(n + "b", '"GaussianBlur"', n + "d")},
{_eigen_sql(n + "d", ("hxx", "hxy", "hxz", "hyy", "hyz", "hzz"), n + "e")},
{n} AS (SELECT volume_id, x, y, z, m, {i} AS scale_idx, CAST({sigma!r} AS DOUBLE) AS scale, {masked} FROM {n}e)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _vox(select: str, more: str = "") -> str:
    return f"WITH {VOX}{',' if more else ''}\n{more}\n{select}"


@query(_vox("SELECT * FROM vox"))
def voxelize(spark, sf_dir):
    return vox(spark, sf_dir)


@query("""WITH c AS (SELECT l_returnflag AS volume_id, l_partkey % 16 AS x, l_suppkey % 8 AS y, CAST(l_linenumber - 1 AS BIGINT) AS z FROM lineitem GROUP BY 1, 2, 3, 4),
v AS (SELECT g.volume_id, CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z FROM (SELECT DISTINCT volume_id FROM c) g CROSS JOIN range(16) a(i) CROSS JOIN range(8) b(i) CROSS JOIN range(7) c(i))
SELECT volume_id, max(x) - min(x) + 1 AS size_x, max(y) - min(y) + 1 AS size_y, max(z) - min(z) + 1 AS size_z, count(*) AS n_voxels FROM v GROUP BY 1""")
def volume_info(spark, sf_dir):
    return tools.describe_volume(vox(spark, sf_dir, by_flag=True))


@query(_vox("SELECT x, y, z, CAST(greatest(0, least(1, m)) AS INTEGER) AS c FROM vox"))
def mask_clamp(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", pointwise.clamp(F.col("m")).cast("int").alias("c"))


@query(_vox("SELECT x, y, z, CASE WHEN m BETWEEN 1 AND 1 THEN 1 ELSE 0 END AS t, CASE WHEN v BETWEEN 300 AND 600 THEN 7 ELSE 3 END AS w FROM vox"))
def mask_threshold(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", pointwise.threshold(F.col("m"), 1, 1).alias("t"), pointwise.threshold(F.col("v"), 300, 600, 7, 3).alias("w"))


@query(_vox("SELECT x, y, z, v, CASE WHEN m IN (0, 2) THEN 5 ELSE 1 END AS m, p, volume_id FROM vox"))
def mask_remap(spark, sf_dir):
    return tools.remap_mask(vox(spark, sf_dir), [0, 2], 5, 1)


@query(_vox("SELECT volume_id, x, y, z, CASE WHEN m <> 0 THEN v ELSE -1.0 END AS v, m, p FROM vox"))
def mask_apply(spark, sf_dir):
    return tools.mask_image(vox(spark, sf_dir), outside=-1.0)


@query(_vox("SELECT a.x, a.y, a.z, a.v, b.m FROM vox a JOIN vox b ON a.x = b.x AND a.y = b.y AND a.z = b.z"))
def image_mask_join(spark, sf_dir):
    v = vox(spark, sf_dir)
    return lattice.image_with_mask(v.select(*lattice.KEYS, "v"), v.select(*lattice.KEYS, "m")).select("x", "y", "z", "v", "m")


@query(_vox("SELECT x, y, z, CAST(CASE WHEN v < 100 THEN 0 WHEN v > 700 THEN 255 ELSE floor((v - 100.0::DOUBLE) * 255.0::DOUBLE / 600.0::DOUBLE) END AS INTEGER) AS w FROM vox"))
def intensity_window(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", pointwise.intensity_window(F.col("v"), 600.0, 400.0).alias("w"))


@query(_vox("SELECT x, y, z, CASE WHEN m <> 0 THEN v / m ELSE 3.4028234663852886e38::DOUBLE END AS q, v * p AS t FROM vox"))
def divide_multiply(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", pointwise.divide(F.col("v"), F.col("m")).alias("q"), pointwise.multiply(F.col("v"), F.col("p")).alias("t"))


@query(_vox(f"SELECT x, y, z, {_d('v', 'x')} AS d FROM vox"))
def deriv_x1(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", stencil.derivative("v", "x").alias("d"))


@query(_vox(f"SELECT x, y, z, {_d('v', 'z', 2)} AS d FROM vox"))
def deriv_z2(spark, sf_dir):
    return vox(spark, sf_dir).select("x", "y", "z", stencil.derivative("v", "z", 2).alias("d"))


@query(_vox("SELECT x, y, z, hxx, hxy, hxz, hyy, hyz, hzz FROM d", _derivatives_sql("vox", "v", "d")))
def hessian(spark, sf_dir):
    return stencil.hessian(vox(spark, sf_dir)).select("x", "y", "z", *stencil.HESSIAN)


@query(_vox("SELECT x, y, z, round(CASE WHEN m <> 0 THEN sqrt(dx*dx + dy*dy + dz*dz) ELSE 0.0 END, 6) + 0.0 AS \"GradientMagnitude\" FROM d", _derivatives_sql("vox", "v", "d")))
def gradient_magnitude(spark, sf_dir):
    return tools.masked_gradient(vox(spark, sf_dir)).select("x", "y", "z", _rounded("GradientMagnitude"))


_MATRIX = "mm AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(eigen.COMPONENTS)) + " FROM embeddings)"


def _matrices(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(eigen.COMPONENTS)])


@query(f"WITH {_MATRIX}, {_eigen_sql('mm', eigen.COMPONENTS, 'e')} SELECT vec_id, round(e1, 6) + 0.0 AS e1, round(e2, 6) + 0.0 AS e2, round(e3, 6) + 0.0 AS e3 FROM e")
def eigenvalues(spark, sf_dir):
    return eigen.eigenvalues(_matrices(spark, sf_dir)).select("vec_id", *[_rounded(c) for c in ("e1", "e2", "e3")])


_EIGEN_SELECT = ", ".join(f'round({e}, 6) + 0.0 AS "{c}"' for c, e in zip(eigen.FEATURES, ("e1", "e2", "e3", "e1 + e2 + e3", "e1 * e2 * e3", "sqrt(e1*e1 + e2*e2 + e3*e3)"), strict=True))


@query(f"WITH {_MATRIX}, {_eigen_sql('mm', eigen.COMPONENTS, 'e')} SELECT vec_id, {_EIGEN_SELECT} FROM e")
def eigen_features(spark, sf_dir):
    return eigen.eigen_features(_matrices(spark, sf_dir)).select("vec_id", *[_rounded(c) for c in eigen.FEATURES])


#: The product of eigenvalues of a Hessian of whole numbers is a multiple of 1/32.
_WHOLE = DIGITS | {"GaussianCurvature": 5}
_HESSIAN_SELECT = ", ".join(f'round(CASE WHEN m <> 0 THEN {e} ELSE 0.0 END, {_WHOLE[c]}) + 0.0 AS "{c}"' for c, e in zip(eigen.FEATURES, ("e1", "e2", "e3", "e1 + e2 + e3", "e1 * e2 * e3", "sqrt(e1*e1 + e2*e2 + e3*e3)"), strict=True))


@query(_vox(f"SELECT x, y, z, {_HESSIAN_SELECT} FROM e", _derivatives_sql("vox", "v", "d") + ",\n" + _eigen_sql("d", stencil.HESSIAN, "e")))
def hessian_features(spark, sf_dir):
    return stencil.hessian_features(vox(spark, sf_dir)).select("x", "y", "z", *[_rounded(c, _WHOLE[c]) for c in eigen.FEATURES])


@query(_vox("SELECT x, y, z, round(v, 6) + 0.0 AS v FROM s", _smooth_sql("vox", ["v"], 0.75, "s")))
def gauss_smooth(spark, sf_dir):
    return stencil.gaussian_smooth(vox(spark, sf_dir), ["v"], 0.75).select("x", "y", "z", _rounded("v"))


@query(_vox('SELECT x, y, z, round(CASE WHEN mm <> 0 THEN "GaussianBlur" ELSE 0.0 END, 4) + 0.0 AS "GaussianBlur", CAST(0.75 AS DOUBLE) AS scale FROM b', _blur_sql("vox", 0.75, "b")))
def norm_conv(spark, sf_dir):
    return tools.masked_normalized_convolution(vox(spark, sf_dir), [0.75]).select("x", "y", "z", _rounded("GaussianBlur", 4), "scale")


_FEATURE_SELECT = ", ".join(f'round("{c}", {DIGITS[c]}) + 0.0 AS "{c}"' for c in FEATURES)


@query(_vox(f"SELECT x, y, z, {_FEATURE_SELECT} FROM f0", _features_sql(0.5, 0)))
def features8(spark, sf_dir):
    return tools.extract_features(vox(spark, sf_dir), [0.5]).select("x", "y", "z", *[_rounded(c, DIGITS[c]) for c in FEATURES])


@query(_vox(f"SELECT x, y, z, scale, {_FEATURE_SELECT} FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1)", _features_sql(SCALES[0], 0) + ",\n" + _features_sql(SCALES[1], 1)))
def features8_multiscale(spark, sf_dir):
    return tools.extract_features(vox(spark, sf_dir), SCALES).select("x", "y", "z", "scale", *[_rounded(c, DIGITS[c]) for c in FEATURES])


_PRICE_EDGES = [1000.0, 5000.0, 20000.0, 40000.0, 90000.0]


def _bin_sql(value: str, edges: list[float]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {value} > {e!r} THEN 1 ELSE 0 END" for e in edges) + " AS INTEGER)"


_COUNTS_SQL = f"""WITH b AS (SELECT l_returnflag, {_bin_sql("l_extendedprice", _PRICE_EDGES)} AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
h AS (SELECT k.l_returnflag, CAST(s.i AS INTEGER) AS bin, CAST(coalesce(b.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT l_returnflag FROM b) k CROSS JOIN range({len(_PRICE_EDGES) + 1}) s(i) LEFT JOIN b ON b.l_returnflag = k.l_returnflag AND b.bin = s.i)"""


@query(f"{_COUNTS_SQL} SELECT * FROM h")
def hist_counts(spark, sf_dir):
    return histogram.histogram(_read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _PRICE_EDGES)


@query(f"{_COUNTS_SQL} SELECT l_returnflag, bin, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS freq FROM h")
def hist_freqs(spark, sf_dir):
    return histogram.frequencies(hist_counts(spark, sf_dir), ["l_returnflag"])


@query("SELECT l_quantity, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, sf_dir):
    return tools.value_counts(_read(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT DISTINCT m FROM (" + _vox("SELECT m FROM vox") + ")")
def distinct_values(spark, sf_dir):
    return roi.mask_values(vox(spark, sf_dir))


@query("""WITH r AS (SELECT event_id, ntile(10) OVER (ORDER BY event_id) AS tile FROM events)
SELECT CAST(tile - 2 AS INTEGER) AS edge_idx, min(event_id) AS edge FROM r WHERE tile > 1 GROUP BY tile""")
def edges_distinct(spark, sf_dir):
    return histogram.distinct_edges(_read(spark, sf_dir, "events"), 10, "event_id")


_TIED_SQL = """WITH RECURSIVE c AS (SELECT l_returnflag AS g, l_quantity AS v, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
u AS (SELECT g, v, n, CAST(sum(n) OVER (PARTITION BY g ORDER BY v) AS BIGINT) AS hi FROM c),
r AS (SELECT g, v, hi - n AS lo, hi, lead(v) OVER (PARTITION BY g ORDER BY v) AS nextv FROM u),
t AS (SELECT g, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY g),
s AS (
  SELECT g, total, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, total % {B} AS sur, CAST(0 AS BIGINT) AS def, CAST(NULL AS DOUBLE) AS edge FROM t
  UNION ALL
  SELECT q.g, q.total, q.k + 1,
    CASE WHEN q.np = r.lo THEN q.np WHEN r.hi = q.total THEN r.lo WHEN q.np - r.lo < r.hi - q.np OR (q.np - r.lo = r.hi - q.np AND q.d > 0) THEN r.lo ELSE r.hi END,
    CASE WHEN q.np = r.lo OR r.hi = q.total THEN q.u
         WHEN q.np - r.lo < r.hi - q.np OR (q.np - r.lo = r.hi - q.np AND q.d > 0) THEN CASE WHEN q.np - r.lo > q.d THEN q.np - r.lo - q.d ELSE q.u END
         ELSE CASE WHEN r.hi - q.np > q.u THEN 0 ELSE q.u - (r.hi - q.np) END END,
    CASE WHEN q.np = r.lo OR r.hi = q.total THEN q.d
         WHEN q.np - r.lo < r.hi - q.np OR (q.np - r.lo = r.hi - q.np AND q.d > 0) THEN CASE WHEN q.np - r.lo > q.d THEN 0 ELSE q.d - (q.np - r.lo) END
         ELSE CASE WHEN r.hi - q.np > q.u THEN r.hi - q.np - q.u ELSE q.d END END,
    CASE WHEN q.np = r.lo OR r.hi = q.total OR q.np - r.lo < r.hi - q.np OR (q.np - r.lo = r.hi - q.np AND q.d > 0) THEN r.v ELSE r.nextv END
  FROM (SELECT g, total, k,
      pos + total // {B} + CASE WHEN sur > 0 THEN greatest(1, sur // ({B} - k)) WHEN def > 0 THEN -least(total // {B}, greatest(1, def // ({B} - k))) ELSE 0 END AS np,
      CASE WHEN sur > 0 THEN sur - greatest(1, sur // ({B} - k)) ELSE sur END AS u,
      CASE WHEN sur > 0 THEN def WHEN def > 0 THEN def - least(total // {B}, greatest(1, def // ({B} - k))) ELSE def END AS d
    FROM s WHERE k < {B} - 1) q JOIN r ON r.g = q.g AND r.lo <= q.np AND q.np < r.hi)
SELECT g AS l_returnflag, CAST(k - 1 AS INTEGER) AS edge_idx, edge FROM s WHERE k > 0"""


@query(_TIED_SQL.replace("{B}", "7"))
def edges_ties(spark, sf_dir):
    return histogram.determine_edges(_read(spark, sf_dir, "lineitem"), 7, "l_returnflag", "l_quantity")


@query(_TIED_SQL.replace("{B}", "5"))
def edges_ties_walked(spark, sf_dir):
    counts = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return histogram.walked_edges(counts, 5, "l_returnflag", "l_quantity")


def _edges_sql(source: str, bins: int) -> str:
    """The tied edges of (g, v) rows, with names that don't clash."""
    sql = _TIED_SQL.replace("{B}", str(bins)).replace("SELECT l_returnflag AS g, l_quantity AS v, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2", f"SELECT g, v, CAST(count(*) AS BIGINT) AS n FROM ({source}) GROUP BY 1, 2")
    return sql.replace("WITH RECURSIVE ", "", 1).replace("SELECT g AS l_returnflag, CAST(k - 1 AS INTEGER) AS edge_idx, edge FROM s WHERE k > 0", "")


_LONG = " UNION ALL ".join(f'SELECT CAST({j * 8 + i} AS INTEGER) AS g, "{c}" AS v FROM f{j} WHERE m <> 0' for j in range(len(SCALES)) for i, c in enumerate(FEATURES))


@query(_vox(f"""SELECT g AS hist_idx, CASE g // 8 WHEN 0 THEN CAST({SCALES[0]!r} AS DOUBLE) ELSE CAST({SCALES[1]!r} AS DOUBLE) END AS scale,
  ([{", ".join(f"'{c}'" for c in FEATURES)}])[g % 8 + 1] AS feature, list(round(edge, 4) + 0.0 ORDER BY k) AS edges FROM s WHERE k > 0 GROUP BY 1, 2, 3""", _features_sql(SCALES[0], 0) + ",\n" + _features_sql(SCALES[1], 1) + ",\n" + _edges_sql(_LONG.replace(" AS v FROM", " + 0.0 AS v FROM"), 6)).replace("WITH ", "WITH RECURSIVE ", 1))
def determine_edges(spark, sf_dir):
    found = tools.determine_edges(vox(spark, sf_dir), SCALES, 6)
    return found.withColumn("edges", F.transform("edges", lambda e: F.round(e, 4) + F.lit(0.0)))


_FITS = "x >= 1 AND x <= 14 AND y >= 1 AND y <= 6 AND z >= 1 AND z <= 5"
_BOXES = "x - 1 AS x0, y - 1 AS y0, z - 1 AS z0, CAST(3 AS BIGINT) AS sx, CAST(3 AS BIGINT) AS sy, CAST(3 AS BIGINT) AS sz"
_DENSE = f"rois AS (SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY z, y, x) - 1 AS roi_id, {_BOXES} FROM vox WHERE m <> 0 AND {_FITS})"
_HASH = "md5(concat_ws(',', x, y, z, 1))"


def _random_sql(n: int, where: str = "m <> 0", by: str = "") -> str:
    keys = "volume_id" + (f", {by}" if by else "")
    return f"rois AS (SELECT {keys}, roi_id, x0, y0, z0, sx, sy, sz FROM (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {_HASH}, z, y, x) - 1 AS roi_id, {_BOXES} FROM vox WHERE {where} AND {_FITS}) WHERE roi_id < {n})"


_IN_BOX = "v.volume_id = r.volume_id AND v.x >= r.x0 AND v.x < r.x0 + r.sx AND v.y >= r.y0 AND v.y < r.y0 + r.sy AND v.z >= r.z0 AND v.z < r.z0 + r.sz"


def _dense(v):
    return roi.dense_rois(v, BOX, SIZE)


@query(_vox("SELECT * FROM rois", _DENSE))
def rois_dense(spark, sf_dir):
    return _dense(vox(spark, sf_dir))


@query(_vox("SELECT * FROM rois", _random_sql(50, "m = 1")))
def rois_random_hash(spark, sf_dir):
    return tools.generate_rois(vox(spark, sf_dir), SIZE, 50, BOX)


@query(_vox("SELECT * FROM rois", _random_sql(20, "m <> 0", "m")))
def rois_by_label(spark, sf_dir):
    return tools.generate_rois(vox(spark, sf_dir), SIZE, 20, BOX, by_label=True)


@query(_vox("""SELECT c.volume_id, i AS roi_id, x0, y0, z0, sx, sy, sz FROM (SELECT CAST(i AS BIGINT) AS i FROM range(40) t(i)) JOIN (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY z0, y0, x0) - 1 AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM rois) c
ON c.k = CAST('0x' || substr(md5(concat_ws(',', i, 0, 1)), 1, 15) AS BIGINT) % c.n""", _DENSE))
def rois_random_again(spark, sf_dir):
    return roi.random_rois_again(vox(spark, sf_dir), 40, BOX, SIZE)


@query(_vox(f"SELECT r.volume_id, r.roi_id, list(v.v ORDER BY v.z, v.y, v.x) AS \"values\" FROM rois r JOIN vox v ON {_IN_BOX} GROUP BY 1, 2", _random_sql(30, "m = 1")))
def roi_flatten(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.sample_rois(v, tools.generate_rois(v, SIZE, 30, BOX))


def _labels_sql(ignore: str, dominant: str) -> str:
    return _vox(f"""SELECT volume_id, roi_id, CAST(CASE WHEN bool_or(label = {dominant}) THEN {dominant} ELSE arg_max(label, n * 1000 - label) END AS INTEGER) AS label FROM c GROUP BY 1, 2""", _DENSE + f", c AS (SELECT r.volume_id, r.roi_id, v.m AS label, CASE WHEN v.m IN ({ignore}) THEN 0 ELSE count(*) END AS n FROM rois r JOIN vox v ON {_IN_BOX} GROUP BY 1, 2, 3)")


@query(_labels_sql("-1", "-7"))
def roi_labels_mode(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.extract_labels(v, _dense(v))


@query(_labels_sql("0", "-7"))
def roi_labels_ignore(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.extract_labels(v, _dense(v), ignore=[0])


@query(_labels_sql("0", "2"))
def roi_labels_dominant(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.extract_labels(v, _dense(v), ignore=[0], dominant=2)


_ROUNDS = [5, 5, 10, 30]
_ENDS = [sum(_ROUNDS[: i + 1]) for i in range(len(_ROUNDS))]


@query(_vox("""SELECT t.volume_id, CAST(e.i AS INTEGER) AS round, CAST(e.n AS INTEGER) AS n_rois, CAST(count(*) FILTER (WHERE w.roi < e.n) AS BIGINT) AS visited, CAST(count(*) FILTER (WHERE w.roi < e.n AND w.m <> 0) AS BIGINT) AS hits, t.region,
  CAST(count(*) FILTER (WHERE w.roi < e.n AND w.m <> 0) AS DOUBLE) / t.region AS share FROM w CROSS JOIN e CROSS JOIN t GROUP BY t.volume_id, e.i, e.n, t.region""", _random_sql(sum(_ROUNDS)) + f""",
w AS (SELECT v.x, v.y, v.z, v.m, min(r.roi_id) AS roi FROM rois r JOIN vox v ON {_IN_BOX} GROUP BY 1, 2, 3, 4),
e AS (SELECT * FROM (VALUES {", ".join(f"({i}, {n})" for i, n in enumerate(_ENDS))}) AS e(i, n)),
t AS (SELECT volume_id, CAST(count(*) FILTER (WHERE m <> 0) AS BIGINT) AS region FROM vox GROUP BY 1)"""))
def roi_coverage(spark, sf_dir):
    return tools.roi_coverage(vox(spark, sf_dir), SIZE, BOX, _ROUNDS)


_LINES = "(SELECT max(l_linenumber) FROM lineitem)"


@query(f"""WITH vox AS (SELECT 'all' AS volume_id, CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z, 1 AS m FROM (SELECT unnest(range(2 * {_LINES} + 2)) AS i) a CROSS JOIN (SELECT unnest(range({_LINES} + 1)) AS i) b CROSS JOIN (SELECT unnest(range({_LINES})) AS i) c),
{_random_sql(sum(_ROUNDS))},
w AS (SELECT v.x, v.y, v.z, min(r.roi_id) AS roi FROM rois r JOIN vox v ON {_IN_BOX} GROUP BY 1, 2, 3),
e AS (SELECT * FROM (VALUES {", ".join(f"({i}, {n})" for i, n in enumerate(_ENDS))}) AS e(i, n))
SELECT CAST(e.i AS INTEGER) AS round, CAST(count(*) FILTER (WHERE w.roi < e.n) AS BIGINT) AS visited, CAST(count(*) FILTER (WHERE w.roi < e.n) AS DOUBLE) / (SELECT count(*) FROM vox) AS share FROM w CROSS JOIN e GROUP BY e.i""")
def roi_coverage_analytic(spark, sf_dir):
    """A volume whose size the table says."""
    n = _read(spark, sf_dir, "lineitem").agg(F.max("l_linenumber")).first()[0]
    return tools.analytic_coverage(spark, (2 * n + 2, n + 1, n), BOX, _ROUNDS).select("round", "visited", "share")


@query(_vox(f"SELECT v.volume_id, v.x, v.y, v.z, CASE WHEN EXISTS (SELECT 1 FROM rois r WHERE {_IN_BOX}) THEN v.v ELSE 0.0 END AS v, v.m, v.p FROM vox v", _random_sql(10, "m = 1")))
def mask_with_rois(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.mask_with_rois(v, tools.generate_rois(v, SIZE, 10, BOX))


def _intensity_sql(rois: str) -> str:
    return f"""{rois},
k AS (SELECT r.volume_id, r.roi_id, {_bin_sql("v.v", EDGES)} AS bin, count(*) AS n FROM rois r JOIN vox v ON {_IN_BOX} AND v.m <> 0 GROUP BY 1, 2, 3),
h AS (SELECT r.volume_id, r.roi_id, CAST(s.i AS INTEGER) AS bin, CAST(coalesce(k.n, 0) AS BIGINT) AS n FROM rois r CROSS JOIN range({len(EDGES) + 1}) s(i) LEFT JOIN k ON k.volume_id = r.volume_id AND k.roi_id = r.roi_id AND k.bin = s.i),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY volume_id, roi_id) AS DOUBLE) AS total FROM h)"""


@query(_vox("SELECT volume_id, roi_id, bin, n, n / total AS freq FROM g", _intensity_sql(_DENSE)))
def bag_intensity(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.make_intensity_bag(v, EDGES, _dense(v))


@query(_vox("SELECT volume_id, roi_id, bin, n, n / total AS freq FROM g", _intensity_sql(f"rois AS (SELECT volume_id, (z * 8 + y) * 16 + x AS roi_id, {_BOXES} FROM vox WHERE m <> 0 AND {_FITS})")))
def bag_dense(spark, sf_dir):
    return bag.dense_intensity_bag(vox(spark, sf_dir), BOX, SIZE, EDGES)


def _spec(spark):
    n = len(FEATURES) * len(SCALES)
    return spark.createDataFrame([(i, SPEC_EDGES) for i in range(n)], "hist_idx int, edges array<double>")


_BAG_SQL = _features_sql(SCALES[0], 0) + ",\n" + _features_sql(SCALES[1], 1) + ",\n" + _random_sql(25, "m = 1") + ",\n" + "allf AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1),\n" + "vals AS (" + " UNION ALL ".join(f'SELECT volume_id, x, y, z, m, CAST(scale_idx * 8 + {i} AS INTEGER) AS hist_idx, "{c}" AS value FROM allf' for i, c in enumerate(FEATURES)) + f"""),
k AS (SELECT r.volume_id, r.roi_id, v.hist_idx, {_bin_sql("v.value", SPEC_EDGES)} AS bin, count(*) AS n FROM rois r JOIN vals v ON {_IN_BOX} AND v.m <> 0 GROUP BY 1, 2, 3, 4)"""


@query(_vox("SELECT volume_id, roi_id, hist_idx, bin, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY volume_id, roi_id, hist_idx) AS DOUBLE), 6) AS freq FROM k", _BAG_SQL))
def bag_multiscale(spark, sf_dir):
    v = vox(spark, sf_dir)
    return tools.make_bag(v, _spec(spark), SCALES, tools.generate_rois(v, SIZE, 25, BOX), SIZE).select("volume_id", "roi_id", "hist_idx", "bin", F.round("freq", 6).alias("freq"))


_N_HISTS, _N_BINS = len(FEATURES) * len(SCALES), len(SPEC_EDGES) + 1


@query(_vox(f"""SELECT r.volume_id, r.roi_id, CASE WHEN any_value(t.n) IS NULL THEN array_to_string([CAST('nan' AS VARCHAR) FOR i IN range({_N_HISTS * _N_BINS})], ',') ELSE string_agg(printf('%.4f', coalesce(CAST(k.n AS DOUBLE), 0.0) / t.n), ',' ORDER BY h.i * {_N_BINS} + b.i) END AS line
FROM rois r CROSS JOIN range({_N_HISTS}) h(i) CROSS JOIN range({_N_BINS}) b(i)
LEFT JOIN k ON k.volume_id = r.volume_id AND k.roi_id = r.roi_id AND k.hist_idx = h.i AND k.bin = b.i
LEFT JOIN (SELECT volume_id, roi_id, hist_idx, sum(n) AS n FROM k GROUP BY 1, 2, 3) t ON t.volume_id = r.volume_id AND t.roi_id = r.roi_id AND t.hist_idx = h.i GROUP BY 1, 2""", _BAG_SQL))
def bag_arrays(spark, sf_dir):
    v = vox(spark, sf_dir)
    rois = tools.generate_rois(v, SIZE, 25, BOX)
    lines = bag.bag_lines(bag.as_arrays(tools.make_bag(v, _spec(spark), SCALES, rois, SIZE), rois, _N_HISTS, _N_BINS))
    # Both engines write four decimals alike.
    even = F.transform(F.split("line", ","), lambda x: F.when(x == "nan", x).otherwise(F.format_string("%.4f", x.cast("double"))))
    return lines.withColumn("line", F.array_join(even, ","))


_DENSE_BY_PLACE = f"rois AS (SELECT volume_id, (z * 8 + y) * 16 + x AS roi_id, {_BOXES} FROM vox WHERE m <> 0 AND {_FITS})"


@query(_vox("SELECT volume_id, roi_id, hist_idx, bin, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY volume_id, roi_id, hist_idx) AS DOUBLE), 6) AS freq FROM k", _BAG_SQL.replace(_random_sql(25, "m = 1"), _DENSE_BY_PLACE)))
def bag_dense_multiscale(spark, sf_dir):
    return tools.make_bag(vox(spark, sf_dir), _spec(spark), SCALES, "dense", SIZE, BOX).select("volume_id", "roi_id", "hist_idx", "bin", F.round("freq", 6).alias("freq"))


_DATASET_SQL = """WITH b AS (SELECT bag, row_number() OVER (ORDER BY bag) - 1 AS bag_idx, n FROM (SELECT CAST(o_custkey AS VARCHAR) AS bag, count(*) AS n FROM orders GROUP BY 1)),
f AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY bag_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM b)"""


def _dataset(spark, sf_dir):
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    found = orders.select(F.col("o_custkey").cast("string").alias("bag"), F.col("o_orderkey").alias("roi_id"), F.array("o_totalprice").alias("features"))
    labels = customers.select(F.col("c_custkey").cast("string").alias("bag"), (F.col("c_nationkey") % 2).cast("double").alias("label"))
    return tools.assemble_dataset(found, labels.join(found.select("bag"), "bag", "left_semi"))


@query(_DATASET_SQL + """ SELECT f.bag_idx, f.first + row_number() OVER (PARTITION BY f.bag ORDER BY o_orderkey) - 1 AS inst_idx, o_totalprice AS feature, CAST(0 AS DOUBLE) AS label FROM f JOIN orders ON f.bag = CAST(o_custkey AS VARCHAR)""")
def bagged_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir)[0].select("bag_idx", "inst_idx", F.col("features")[0].alias("feature"), "label")


@query(_DATASET_SQL + """ SELECT f.bag_idx, f.bag, CAST(f.n AS BIGINT) AS n_instances, CAST(c_nationkey % 2 AS DOUBLE) AS label FROM f LEFT JOIN customer ON f.bag = CAST(c_custkey AS VARCHAR)""")
def bag_labels(spark, sf_dir):
    return _dataset(spark, sf_dir)[1]


_SMALL = "small AS (SELECT * FROM vox WHERE x BETWEEN 3 AND 9 AND y BETWEEN 2 AND 6 AND z BETWEEN 1 AND 4 AND m = 1)"
_BBOX = "box AS (SELECT volume_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM small GROUP BY 1)"


def _small(v):
    on = F.col("x").between(3, 9) & F.col("y").between(2, 6) & F.col("z").between(1, 4) & (F.col("m") == 1)
    return v.withColumn("s", F.when(on, 1).otherwise(0))


@query(_vox("SELECT * FROM box", _SMALL + ", " + _BBOX))
def bbox(spark, sf_dir):
    return lattice.bounding_box(_small(vox(spark, sf_dir)), "s")


@query(_vox("SELECT v.volume_id, x - min_x AS x, y - min_y AS y, z - min_z AS z, v FROM vox v JOIN box USING (volume_id) WHERE x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND z BETWEEN min_z AND max_z", _SMALL + ", " + _BBOX))
def crop(spark, sf_dir):
    return tools.crop_to_mask(_small(vox(spark, sf_dir)), "s").select("volume_id", "x", "y", "z", "v")


@query(_vox("SELECT x, y, z, v FROM vox WHERE z IN (0, 1, 2, 4, 5, 6)"))
def slices(spark, sf_dir):
    return tools.extract_slices(vox(spark, sf_dir), "z", 7, indices=[1], locations=[0.75, 3.0], window=3, stride=1).select("x", "y", "z", "v")


@query(_vox("SELECT x, y, 6 - z AS z, v FROM vox WHERE x IN (4, 8)"))
def flip(spark, sf_dir):
    return tools.extract_slices(vox(spark, sf_dir), "x", 16, indices=[4, 8], flip=7).select("x", "y", "z", "v")


@query(_vox("SELECT CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, coalesce(v, -9.0) AS v FROM range(21) a(i) CROSS JOIN range(11) b(i) LEFT JOIN (SELECT x + 2 AS x, y + 1 AS y, v FROM vox WHERE z = 3) s ON s.x = a.i AND s.y = b.i"))
def pad(spark, sf_dir):
    plane = vox(spark, sf_dir).filter("z = 3").withColumn("z", F.lit(0).cast("long"))
    return tools.pad(plane.select(*lattice.KEYS, "v"), (16, 8), (21, 11), {"v": -9.0}).select("x", "y", "v")


_GRID = "g AS (SELECT CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z, 0.0::DOUBLE + a.i * 0.5::DOUBLE AS px, 0.0::DOUBLE + b.i * 0.75::DOUBLE AS py, 0.0::DOUBLE + c.i * 1.5::DOUBLE AS pz FROM range(31) a(i) CROSS JOIN range(10) b(i) CROSS JOIN range(5) c(i))"
_CORNERS = "SELECT 0 AS d UNION ALL SELECT 1"


@query(_vox(f"""SELECT g.x, g.y, g.z, round(coalesce(sum(v.v * (CASE WHEN a.d = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE WHEN b.d = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) * (CASE WHEN c.d = 0 THEN 1 - (pz - floor(pz)) ELSE pz - floor(pz) END)), 0.0), 6) + 0.0 AS v
FROM g CROSS JOIN ({_CORNERS}) a CROSS JOIN ({_CORNERS}) b CROSS JOIN ({_CORNERS}) c
LEFT JOIN vox v ON px <= 15 AND py <= 7 AND pz <= 6 AND v.x = least(floor(px) + a.d, 15) AND v.y = least(floor(py) + b.d, 7) AND v.z = least(floor(pz) + c.d, 6) GROUP BY 1, 2, 3""", _GRID))
def resample_linear(spark, sf_dir):
    return tools.resample(vox(spark, sf_dir), SIZE, (31, 10, 5), (0.5, 0.75, 1.5)).select("x", "y", "z", _rounded("v"))


@query(_vox("SELECT g.x, g.y, g.z, coalesce(v.v, 0.0) AS v FROM g LEFT JOIN vox v ON px <= 15 AND py <= 7 AND pz <= 6 AND v.x = floor(px + 0.5) AND v.y = floor(py + 0.5) AND v.z = floor(pz + 0.5)", _GRID))
def resample_nearest(spark, sf_dir):
    return tools.resample(vox(spark, sf_dir), SIZE, (31, 10, 5), (0.5, 0.75, 1.5), order=0).select("x", "y", "z", "v")


_EDGE = ", ".join(f"coalesce(lag(m) OVER ({_over(a)}), 1) AS before_{a}, coalesce(lead(m) OVER ({_over(a)}), 1) AS after_{a}" for a in AXES)


@query(_vox("""SELECT volume_id, round(coalesce(avg(CASE WHEN m <> 0 THEN d * p END), 0.0), 6) AS expected_distance
FROM (SELECT v.volume_id, v.x, v.y, v.z, v.m, v.p, CAST(min((v.x - e.x) * (v.x - e.x) + (v.y - e.y) * (v.y - e.y) + (v.z - e.z) * (v.z - e.z)) AS DOUBLE) AS d FROM vox v CROSS JOIN edge e GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1""", f"n AS (SELECT *, {_EDGE} FROM vox), edge AS (SELECT x, y, z FROM n WHERE m <> 0 AND (before_x = 0 OR after_x = 0 OR before_y = 0 OR after_y = 0 OR before_z = 0 OR after_z = 0))"))
def expected_distance(spark, sf_dir):
    return tools.expected_distance(vox(spark, sf_dir)).select("volume_id", F.round("expected_distance", 6).alias("expected_distance"))


def _spline_sql() -> str:
    """Slices on the finer grid: weights of each old value for each new place, from the matrices of both axes, and the sums."""
    matrices = {}
    for name, n, step in (("x", SIZE[0], 0.25 / 1.0), ("y", SIZE[1], 0.25 / 0.5)):
        m = int(np.ceil(n / step))
        dense = distance.spline_matrix(n, np.arange(m) * step, 3) @ _solved(n)
        matrices[name] = ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for i, row in enumerate(dense) for j, w in enumerate(row) if w)
    value = "sum(sx.w * sy.w * v.v)"
    return _vox(f"""SELECT v.volume_id, CAST(sx.i AS BIGINT) AS x, CAST(sy.i AS BIGINT) AS y, v.z, CAST(CASE WHEN {value} < 0 THEN 0 WHEN {value} > 800 THEN 255 ELSE floor(({value} - 0.0) * 255.0::DOUBLE / 800.0::DOUBLE + 1e-7) END AS INTEGER) AS value,
  CAST(max(CASE WHEN v.x = least(floor(sx.i * 0.25 + 0.5), 15) AND v.y = least(floor(sy.i * 0.5 + 0.5), 7) THEN v.m END) AS BIGINT) AS m
FROM vox v JOIN sx ON sx.j = v.x JOIN sy ON sy.j = v.y GROUP BY 1, 2, 3, 4""", f"sx(i, j, w) AS (VALUES {matrices['x']}), sy(i, j, w) AS (VALUES {matrices['y']})")


def _solved(n: int) -> np.ndarray:
    """Coefficients of the cubic spline through unit values, by solving for them: no recursive filter."""
    basis = np.zeros((n, n))
    for i in range(n):
        for d, w in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
            j = abs(i + d)
            basis[i, 2 * (n - 1) - j if j > n - 1 else j] += w
    return np.linalg.inv(basis)


@query(_spline_sql())
def window_bspline(spark, sf_dir):
    found = distance.resampled_slices(vox(spark, sf_dir), (1.0, 0.5), mask="m")
    # Values that are whole but for rounding fall to the same side in both engines.
    return found.withColumn("value", pointwise.intensity_window(F.col("value") + F.lit(1e-7 * 800 / 255), 800.0, 400.0))


@query(_vox("SELECT volume_id, x, y, z, v FROM vox"))
def volume_files(spark, sf_dir):
    """The lattice written as files and read again."""
    files = volumes.nifti_files(vox(spark, sf_dir), kind="f8").withColumnRenamed("volume_id", "path")
    return volumes.parsed(files, volumes.parse_nifti)


@query(_vox("SELECT 'all_20200101' AS volume_id, x, y, z, CAST(CAST(v AS BIGINT) % 1000 AS DOUBLE) AS v FROM vox"))
def dicom_series(spark, sf_dir):
    """Every slice of the lattice as a DICOM file, and the volume assembled from them."""

    def written(frame):
        import pandas as pd

        z = int(frame["z"].iloc[0])
        grid = frame.pivot(index="y", columns="x", values="v").to_numpy()
        content = volumes.dicom_bytes(grid % 1000, "all", "20200101", 2.5 * z, explicit=bool(z % 2))
        return pd.DataFrame({"path": [f"slice-{z}"], "content": [content]})

    v = vox(spark, sf_dir).withColumn("v", F.floor("v").cast("double"))
    files = v.groupBy("z").applyInPandas(written, "path string, content binary")
    return volumes.series_volumes(volumes.dicom_slices(files))


@query(_vox("SELECT volume_id, roi_id, x0, y0, z0, sx, sy, sz FROM rois", _DENSE))
def roi_text_parse(spark, sf_dir):
    """The lattice's regions as lines of a file with a heading, and read again."""
    lines = text.roi_lines(_dense(vox(spark, sf_dir))).select(F.col("volume_id").alias("path"), (F.col("roi_id") + 1).cast("int").alias("line"), F.col("line").alias("value"))
    head = spark.createDataFrame([("all", 0, "index size")], "path string, line int, value string")
    return text.parse_rois(head.unionByName(lines))


@query(_vox("SELECT volume_id, roi_id, '[' || x0 || ', ' || y0 || ', ' || z0 || '][' || sx || ', ' || sy || ', ' || sz || ']' AS line FROM rois", _DENSE))
def roi_text_write(spark, sf_dir):
    return text.roi_lines(_dense(vox(spark, sf_dir)))


@query("SELECT c_mktsegment AS path, CAST(c_custkey AS INTEGER) AS line, c_name AS first, c_mktsegment || ', more' AS second FROM customer WHERE c_custkey % 5 <> 0")
def pair_list_parse(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ,"), "c_mktsegment", F.lit(", more ")))
    return text.parse_pairs(_read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("path"), F.col("c_custkey").cast("int").alias("line"), value.alias("value")))


@query("SELECT c_custkey, rtrim(c_name, '/') || '/' || ltrim('/' || c_mktsegment, '/') AS path FROM customer")
def path_join(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", strings.path_join(F.col("c_name"), F.concat(F.lit("/"), F.col("c_mktsegment"))).alias("path"))


@query("SELECT c_custkey, trim('#_' || c_name || '_#', '#_') AS name, string_split(c_name, '#') AS parts FROM customer")
def split_trim(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", strings.trim(F.concat(F.lit("#_"), F.col("c_name"), F.lit("_#")), "#_").alias("name"), strings.split(F.concat(F.col("c_name"), F.lit("#")), "#").alias("parts"))


def _as_files(spark, sf_dir, write):
    """The lattice as a file (path, content); ``write`` makes it of values indexed [z, y, x]."""

    def run(frame):
        import pandas as pd

        grid = np.zeros(SIZE[::-1])
        grid[frame["z"], frame["y"], frame["x"]] = frame["v"]
        return pd.DataFrame({"path": frame["volume_id"].iloc[:1], "content": [write(grid)]})

    return vox(spark, sf_dir).groupBy("volume_id").applyInPandas(run, "path string, content binary")


_VALUES = _vox("SELECT volume_id, x, y, z, v FROM vox")


@query(_VALUES)
def read_hr2(spark, sf_dir):
    return volumes.parsed(_as_files(spark, sf_dir, volumes.hr2_bytes), volumes.parse_image)


@query(_VALUES)
def read_octave(spark, sf_dir):
    def written(grid):
        nz, ny, nx = grid.shape
        head = ["# Created by a test", "# name: v", "# type: matrix", "# ndims: 3", f" {nx} {ny} {nz}"]
        return "\n".join([*head, *[f"{v:g}" for v in grid.transpose(0, 2, 1).ravel()]]).encode()

    return volumes.parsed(_as_files(spark, sf_dir, written), volumes.parse_image)


@query(_VALUES)
def read_nifti(spark, sf_dir):
    return volumes.parsed(_as_files(spark, sf_dir, lambda grid: volumes.nifti_bytes(grid.astype("f4"))), volumes.parse_image)


@query(_VALUES)
def read_metaimage(spark, sf_dir):
    return volumes.parsed(_as_files(spark, sf_dir, volumes.metaimage_bytes), volumes.parse_image)


def _order_lines(spark, sf_dir):
    """Orders as lines of a file for each status, one in seven of them blank."""
    shown = F.concat_ws(" ,", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.format_string("%.2f", F.col("o_totalprice")))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("path"), F.col("o_orderkey").cast("int").alias("line"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(shown).alias("value"))


@query("SELECT o_orderstatus AS path, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row, [CAST(o_orderkey AS DOUBLE), CAST(o_custkey AS DOUBLE), round(CAST(o_totalprice AS DOUBLE), 2)] AS \"values\" FROM orders WHERE o_orderkey % 7 <> 0")
def read_matrix(spark, sf_dir):
    return text.parse_matrix(_order_lines(spark, sf_dir), across=True)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [CAST(o_custkey AS DOUBLE), 7.0] WHEN 1 THEN CAST([] AS DOUBLE[]) ELSE [CAST(o_custkey AS DOUBLE)] END AS numbers FROM orders")
def sequence_stops(spark, sf_dir):
    """Numbers of a line up to the first part that isn't one."""
    key = F.col("o_orderkey") % 3
    line = F.concat(F.when(key == 1, "x").otherwise(F.col("o_custkey").cast("string")), F.when(key == 2, ", 5 apples, 7").otherwise(", 7"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.parse_sequence(line).alias("numbers"))


@query(_vox("SELECT r.volume_id, r.roi_id, string_agg(CAST(CAST(v.v AS BIGINT) AS VARCHAR), ',' ORDER BY v.z, v.y, v.x) AS line FROM rois r JOIN (SELECT * REPLACE (floor(v) AS v) FROM vox) v ON " + _IN_BOX + " GROUP BY 1, 2", _random_sql(30, "m = 1")))
def sample_lines(spark, sf_dir):
    v = vox(spark, sf_dir).withColumn("v", F.floor("v").cast("long"))
    return text.sample_lines(tools.sample_rois(v, tools.generate_rois(v, SIZE, 30, BOX)))


@query(_vox("SELECT r.volume_id, r.roi_id, string_agg(printf('%g', v.v), ',' ORDER BY v.z, v.y, v.x) AS line FROM rois r JOIN (SELECT * REPLACE (floor(v) / 7.0::DOUBLE AS v) FROM vox) v ON " + _IN_BOX + " GROUP BY 1, 2", _random_sql(30, "m = 1")))
def sample_lines_fractions(spark, sf_dir):
    """Six digits of each value."""
    v = vox(spark, sf_dir).withColumn("v", F.floor("v") / F.lit(7.0))
    return text.sample_lines(tools.sample_rois(v, tools.generate_rois(v, SIZE, 30, BOX)))


_PRICES = "SELECT CAST(l_orderkey % 16 AS INTEGER) AS g, floor(l_extendedprice) AS v FROM lineitem"
_PRICE_SPEC_SQL = "WITH RECURSIVE " + _edges_sql(_PRICES, 5)


def _price_spec(spark, sf_dir):
    """Edges of the prices of sixteen groups of orders, as a specification of two scales."""
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).cast("int").alias("hist_idx"), F.floor("l_extendedprice").cast("double").alias("value"))
    edges = histogram.determine_edges(rows, 5)
    return edges.groupBy("hist_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("edge_idx", "edge"))), lambda e: e["edge"]).alias("edges"))


@query(_PRICE_SPEC_SQL + "SELECT * FROM (VALUES (-2, '# " + ",".join(FEATURES) + "'), (-1, '# 0.5,0.75')) AS t(hist_idx, line) UNION ALL SELECT g, string_agg(CAST(CAST(edge AS BIGINT) AS VARCHAR), ',' ORDER BY k) FROM s WHERE k > 0 GROUP BY g")
def edge_lines(spark, sf_dir):
    return text.spec_lines(_price_spec(spark, sf_dir), SCALES)


@query(_PRICE_SPEC_SQL + "SELECT g AS hist_idx, list(edge ORDER BY k) AS edges FROM s WHERE k > 0 GROUP BY g")
def edge_file(spark, sf_dir):
    """The specification written as a text file and read again."""
    path = f"{saving.shared_folder(spark)}/spec-{uuid.uuid4().hex}"
    text.write_lines(text.spec_lines(_price_spec(spark, sf_dir), SCALES), path, ["hist_idx"])
    return text.read_spec(spark, path, SCALES)


@query(_DATASET_SQL + """ SELECT f.bag_idx, f.bag, f.first + row_number() OVER (PARTITION BY f.bag ORDER BY o_orderkey) - 1 AS inst_idx, o_totalprice AS feature, CAST(o_orderkey % 2 AS DOUBLE) AS label FROM f JOIN orders ON f.bag = CAST(o_custkey AS VARCHAR)""")
def dataset_saved(spark, sf_dir):
    """A dataset with instance labels, saved and read again."""
    found = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("bag"), F.col("o_orderkey").alias("roi_id"), F.array("o_totalprice").alias("features"))
    marks = found.select("bag", "roi_id", (F.col("roi_id") % 2).cast("double").alias("label"))
    path = f"{saving.shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    tools.save_dataset(*tools.assemble_dataset(found, None, marks), path)
    bags = spark.read.parquet(f"{path}/bags")
    return spark.read.parquet(f"{path}/instances").join(bags.select("bag_idx", "bag"), "bag_idx").select("bag_idx", "bag", "inst_idx", F.col("features")[0].alias("feature"), "label")


@query("SELECT c_custkey, c_name || '_' || c_mktsegment || '_' || printf('%d_%02d0000', CAST(c_custkey AS BIGINT) // 100, CAST(c_custkey AS BIGINT) % 100) AS name FROM customer")
def volume_names(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", strings.volume_name([F.concat(F.lit(" "), F.col("c_name")), F.col("c_mktsegment")], F.col("c_custkey") / 100).alias("name"))


@query("""SELECT c_custkey, c_name || '_scale_' || printf('%.6f', c_custkey / 8.0::DOUBLE) || c_mktsegment || '.nii.gz' AS feature, rtrim(c_mktsegment, '/') || '/p_scale_' || printf('%.6f', c_custkey / 8.0::DOUBLE) || '.nii.gz' AS scale,
  c_name || (c_custkey % 7) || '.ROIInfo' AS mask, 'axis-' || (c_custkey % 3) || '_absslice-' || c_custkey || '_relslice-' || (c_custkey // 2) || '.nii.gz' AS slice FROM customer""")
def file_names(spark, sf_dir):
    key, scale = F.col("c_custkey"), F.col("c_custkey") / 8
    names = {"feature": text.feature_file(F.col("c_name"), scale, F.col("c_mktsegment")), "scale": text.scale_file(F.concat("c_mktsegment", F.lit("/")), F.lit("p_"), scale), "mask": text.mask_roi_file(F.col("c_name"), key % 7), "slice": text.slice_file(key % 3, key, F.expr("c_custkey div 2"))}
    return _read(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in names.items()])


@query(_vox("SELECT g AS hist_idx, list(round(edge, 4) + 0.0 ORDER BY k) AS edges FROM s WHERE k > 0 GROUP BY 1", _features_sql(SCALES[0], 0) + ",\n" + _edges_sql(" UNION ALL ".join(f'SELECT CAST({i} AS INTEGER) AS g, "{c}" + 0.0 AS v FROM f0 WHERE m = 2' for i, c in enumerate(FEATURES)), 4)).replace("WITH ", "WITH RECURSIVE ", 1))
def edges_of_foreground(spark, sf_dir):
    """Edges of the voxels with one mask value only."""
    found = tools.determine_edges(vox(spark, sf_dir), SCALES[:1], 4, foreground=[2])
    return found.select("hist_idx", F.transform("edges", lambda e: F.round(e, 4) + F.lit(0.0)).alias("edges"))


# A lattice that grows with the tables: as long as there are parts.


def _long_vox(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    n = rows.agg(F.max("l_partkey")).first()[0] + 1
    place = {"x": F.col("l_partkey"), "y": F.col("l_suppkey") % 8, "z": F.col("l_linenumber") - 1}
    values = {"v": F.sum("l_quantity"), "m": (F.sum("l_quantity").cast("long") % 3).cast("int")}
    return lattice.voxelise(rows, place, values, (n, 8, 7), {"v": 0.0, "m": 0}), n


_LONG_VOX = """cells AS (
  SELECT l_partkey AS x, l_suppkey % 8 AS y, CAST(l_linenumber - 1 AS BIGINT) AS z, CAST(sum(l_quantity) AS DOUBLE) AS v, CAST(CAST(sum(l_quantity) AS BIGINT) % 3 AS INTEGER) AS m
  FROM lineitem GROUP BY 1, 2, 3),
parts AS (SELECT unnest(range((SELECT max(l_partkey) + 1 FROM lineitem))) AS i),
vox AS (
  SELECT 'all' AS volume_id, CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(c.i AS BIGINT) AS z, coalesce(v, 0.0) AS v, coalesce(m, 0) AS m
  FROM parts a CROSS JOIN range(8) b(i) CROSS JOIN range(7) c(i) LEFT JOIN cells ON cells.x = a.i AND cells.y = b.i AND cells.z = c.i)"""


@query(f"WITH {_LONG_VOX}, {_features_sql(0.75, 0)} SELECT x, y, z, {_FEATURE_SELECT} FROM f0 WHERE m <> 0")
def features8_growing(spark, sf_dir):
    found = tools.extract_features(_long_vox(spark, sf_dir)[0], [0.75]).filter("m <> 0")
    return found.select("x", "y", "z", *[_rounded(c, DIGITS[c]) for c in FEATURES])


@query(f"""WITH {_LONG_VOX}, s AS (SELECT *, {", ".join(f"CASE WHEN m <> 0 AND {_bin_sql('v', [10.0, 40.0])} = {k} THEN 1 ELSE 0 END AS b{k}" for k in range(3))} FROM vox),
sx AS (SELECT x, y, z, m, {", ".join(f"sum(b{k}) OVER (PARTITION BY y, z ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b{k}" for k in range(3))} FROM s),
sy AS (SELECT x, y, z, m, {", ".join(f"sum(b{k}) OVER (PARTITION BY x, z ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b{k}" for k in range(3))} FROM sx),
sz AS (SELECT x, y, z, m, {", ".join(f"CAST(sum(b{k}) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS b{k}" for k in range(3))} FROM sy)
SELECT z, CAST(count(*) AS BIGINT) AS boxes, CAST(sum(b0) AS BIGINT) AS n0, CAST(sum(b1) AS BIGINT) AS n1, CAST(sum(b2) AS BIGINT) AS n2 FROM sz
WHERE m <> 0 AND x >= 1 AND x < (SELECT max(x) FROM sz) AND y BETWEEN 1 AND 6 AND z BETWEEN 1 AND 5 GROUP BY 1""")
def bag_dense_growing(spark, sf_dir):
    """Sums by slice of the dense intensity bag."""
    v, n = _long_vox(spark, sf_dir)
    found = bag.dense_intensity_bag(v, BOX, (n, 8, 7), [10.0, 40.0])
    z = F.expr(f"roi_id div {n * 8}")
    return found.groupBy(z.alias("z")).agg(F.count_distinct("roi_id").alias("boxes"), *[F.sum(F.when(F.col("bin") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(3)])


@query("SELECT CAST(o_custkey AS VARCHAR) AS volume_id, o_orderkey AS roi_id, CAST(o_orderkey % 5 AS VARCHAR) AS line FROM orders")
def label_lines(spark, sf_dir):
    labels = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("volume_id"), F.col("o_orderkey").alias("roi_id"), (F.col("o_orderkey") % 5).cast("int").alias("label"))
    return text.label_lines(labels)


@query(_COUNTS_SQL + " SELECT l_returnflag, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bin) AS line FROM h GROUP BY 1")
def hist_lines(spark, sf_dir):
    return histogram.csv_line(hist_counts(spark, sf_dir), ["l_returnflag"])


@query("SELECT c_custkey, regexp_replace(c_name, '(.)\\.[^./]*$', '\\1') || '.nii.gz' AS path FROM (SELECT c_custkey, c_mktsegment || '.d/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.dcm' WHEN 1 THEN '' ELSE '.a.b' END AS c_name FROM customer)".replace("\\\\", "\\"))
def extension_replaced(spark, sf_dir):
    name = F.concat("c_mktsegment", F.lit(".d/"), "c_name", F.when(F.col("c_custkey") % 3 == 0, ".dcm").when(F.col("c_custkey") % 3 == 1, "").otherwise(".a.b"))
    return _read(spark, sf_dir, "customer").select("c_custkey", strings.replace_extension(name, "nii.gz").alias("path"))


@query("SELECT 's_d' AS volume_id, CAST(l_orderkey AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, dense_rank() OVER (ORDER BY l_shipdate) - 1 AS z, l_quantity AS v FROM lineitem")
def series_assembly(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.lit("s").alias("series_uid"), F.lit("d").alias("series_date"), F.col("l_shipdate").alias("position"), F.col("l_orderkey").alias("x"), F.lit(0).cast("long").alias("y"), F.col("l_quantity").alias("v"))
    return volumes.series_volumes(rows)


@query(_vox("SELECT x, y, z, m FROM vox WHERE m <> 0 INTERSECT SELECT x, y, z, m FROM vox WHERE v > 300"))
def mask_overlap(spark, sf_dir):
    return roi.overlap(vox(spark, sf_dir), F.col("m") != 0, F.col("v") > 300).select("x", "y", "z", "m")


@query(_vox("SELECT volume_id, x, y, z, round(distance, 6) + 0.0 AS distance FROM (SELECT v.volume_id, v.x, v.y, v.z, sqrt(CAST(min((v.x - e.x) * (v.x - e.x) + (v.y - e.y) * (v.y - e.y) + (v.z - e.z) * (v.z - e.z)) AS DOUBLE)) AS distance FROM vox v CROSS JOIN (SELECT x, y, z FROM vox WHERE v > 0 AND (x * 31 + y * 17 + z * 7) % 23 = 0) e GROUP BY 1, 2, 3, 4)"))
def distance_map(spark, sf_dir):
    d = distance.squared_distance(vox(spark, sf_dir), (F.col("v") > 0) & ((F.col("x") * 31 + F.col("y") * 17 + F.col("z") * 7) % 23 == 0))
    return d.select("volume_id", "x", "y", "z", F.sqrt("d2").alias("distance")).select("volume_id", "x", "y", "z", _rounded("distance"))


from voxelloom import workflow_queries  # noqa: E402, F401  registers its queries with those here
