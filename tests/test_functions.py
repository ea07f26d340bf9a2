import numpy as np
from pyspark.sql import functions as F

from voxelloom.functions.eigen import COMPONENTS, eigen_features, eigenvalues
from voxelloom.functions.strings import join_paths, path_join, six_digits, split, trim
from voxelloom.plans.tools import extract_window
from voxelloom.operators.distance import spline_coefficients, spline_matrix

CASES = [
    ((1, 0, 0, 1, 0, 1), (1, 1, 1)),
    ((1, 0, 0, 2, 0, 3), (3, 2, 1)),
    ((-1, 0, 0, -2, 0, -3), (-3, -2, -1)),
    ((1, 0, 0, -2, 0, 3), (3, -2, 1)),
    ((1, 1, 1, 1, 1, 1), (3, 0, 0)),
    ((0.27, 0.92, 0.58, 0.24, 0.75, 0.04), (1.70680634, -0.7205504, -0.43625594)),
    ((599, 860, -835, -941, 817, -207), (-2005.21004566, 1183.41690727, 272.79313839)),
]


def test_known_eigenvalues(spark):
    rows = [(i, *map(float, m)) for i, (m, _) in enumerate(CASES)]
    got = eigenvalues(spark.createDataFrame(rows, ["i", *COMPONENTS])).orderBy("i").collect()
    for r, (_, want) in zip(got, CASES, strict=True):
        assert np.allclose((r.e1, r.e2, r.e3), want, rtol=1e-8, atol=1e-8)


def test_random_eigenvalues(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-2, 3, (400, 1))
    got = eigen_features(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(m)], ["i", *COMPONENTS])).orderBy("i").collect()
    for r, (a, b, c, d, e, f) in zip(got, m, strict=True):
        full = np.array([[a, b, c], [b, d, e], [c, e, f]])
        want = sorted(np.linalg.eigvalsh(full), key=lambda x: -abs(x))
        scale = abs(want[0])
        assert np.allclose((r.Eigenvalue1, r.Eigenvalue2, r.Eigenvalue3), want, atol=1e-6 * scale)
        assert abs(r.Eigenvalue1) >= abs(r.Eigenvalue2) >= abs(r.Eigenvalue3)
        assert np.isclose(r.LaplacianOfGaussian, a + d + f, atol=1e-9 * scale) and np.isclose(r.GaussianCurvature, np.linalg.det(full), atol=1e-6 * scale**3)
        assert np.isclose(r.FrobeniusNorm, np.linalg.norm(full))


def test_strings(spark):
    rows = [("  a b ", "/x/", "a,b,,c,"), ("", "/", ""), ("   ", "y//", ",")]
    df = spark.createDataFrame(rows, ["s", "p", "c"])
    got = df.select(trim(F.col("s")).alias("t"), path_join(F.col("p"), F.lit("/z")).alias("j"), split(F.col("c"), ",").alias("l")).collect()
    assert [r.t for r in got] == ["a b", "", ""] and [r.j for r in got] == ["/x/z", "/z", "y/z"]
    assert [r.l for r in got] == [["a", "b", "", "c"], [], [""]]
    assert join_paths("a/", "/b") == "a/b"


def test_six_digits(spark):
    values = [0.0, 1.0, -1.5, 0.1, 1 / 3, 2 / 3, 123456.0, 1234567.0, 1e-5, 1.5e-7, 99999.94, 0.0001, 1e20, -2.5e-10, float("nan"), float("inf"), 100.0, 999999.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(six_digits(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == ["%g" % v for v in values]


def test_splines(spark):
    rng = np.random.default_rng(1)
    line = rng.normal(size=12)
    for order in range(6):
        c = spline_coefficients(line, order)
        assert np.allclose(spline_matrix(12, np.arange(12.0), order) @ c, line)
    smooth = np.sin(np.arange(30) / 4)
    at = np.arange(5, 24, 0.25)
    assert np.abs(spline_matrix(30, at, 3) @ spline_coefficients(smooth, 3) - np.sin(at / 4)).max() < 1e-3
    rows = [("v", x, y, 0, float(200 * x)) for x in range(6) for y in range(4)]
    got = extract_window(spark.createDataFrame(rows, "volume_id string, x long, y long, z long, v double"), (0.5, 0.5), 1000.0, 500.0, order=1).collect()
    assert len(got) == 12 * 8 and {r.value for r in got if r.x == 4} == {102} and {r.value for r in got if r.x == 11} == {255}
