"""Eigenvalues of symmetric 3 x 3 matrices, and features of them, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = ("a11", "a12", "a13", "a22", "a23", "a33")
FEATURES = ("Eigenvalue1", "Eigenvalue2", "Eigenvalue3", "LaplacianOfGaussian", "GaussianCurvature", "FrobeniusNorm")


def _by_magnitude(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The three by falling magnitude; of equal magnitudes what came first stays first."""
    swap = lambda p, q: (F.when(F.abs(p) < F.abs(q), q).otherwise(p), F.when(F.abs(p) < F.abs(q), p).otherwise(q))
    a, b = swap(a, b)
    b, c = swap(b, c)
    a, b = swap(a, b)
    return a, b, c


def eigenvalues(df: DataFrame, components: tuple[str, ...] = COMPONENTS, names: tuple[str, str, str] = ("e1", "e2", "e3")) -> DataFrame:
    """Adds the eigenvalues by falling magnitude, from the characteristic polynomial's trigonometric roots.

    A diagonal matrix has its diagonal.  Steps are columns of their own, so that each
    is computed once; all stay within generated code.
    """
    a11, a12, a13, a22, a23, a33 = (F.col(c) for c in components)
    off = a12 * a12 + a13 * a13 + a23 * a23
    q = (a11 + a22 + a33) / 3.0
    df = df.withColumn("_off", off).withColumn("_q", q)
    q = F.col("_q")
    square = (a11 - q) * (a11 - q) + (a22 - q) * (a22 - q) + (a33 - q) * (a33 - q) + 2.0 * F.col("_off")
    df = df.withColumn("_p", F.when(F.col("_off") == 0, F.lit(1.0)).otherwise(F.sqrt(square / 6.0)))
    p = F.col("_p")
    b11, b12, b13, b22, b23, b33 = ((a11 - q) / p, a12 / p, a13 / p, (a22 - q) / p, a23 / p, (a33 - q) / p)
    r = (b11 * b22 * b33 + 2.0 * b12 * b13 * b23 - b23 * b23 * b11 - b13 * b13 * b22 - b12 * b12 * b33) / 2.0
    df = df.withColumn("_r", r)
    phi = F.when(F.col("_r") <= -1, math.pi / 3).when(F.col("_r") >= 1, 0.0).otherwise(F.acos(F.col("_r")) / 3.0)
    df = df.withColumn("_phi", phi)
    df = df.withColumn("_hi", q + 2.0 * p * F.cos(F.col("_phi"))).withColumn("_lo", q + 2.0 * p * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0))
    df = df.withColumn("_mid", 3.0 * q - F.col("_hi") - F.col("_lo"))
    diagonal = F.col("_off") == 0
    df = df.withColumns({"_a": F.when(diagonal, a11).otherwise(F.col("_hi")), "_b": F.when(diagonal, a22).otherwise(F.col("_mid")), "_c": F.when(diagonal, a33).otherwise(F.col("_lo"))})
    ordered = _by_magnitude(F.col("_a"), F.col("_b"), F.col("_c"))
    return df.withColumns(dict(zip(names, ordered, strict=True))).drop("_off", "_q", "_p", "_r", "_phi", "_hi", "_lo", "_mid", "_a", "_b", "_c")


def eigen_features(df: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Adds the eigenvalues, their sum, product and norm, by the names of FEATURES."""
    df = eigenvalues(df, components, FEATURES[:3])
    a, b, c = (F.col(n) for n in FEATURES[:3])
    return df.withColumns({FEATURES[3]: a + b + c, FEATURES[4]: a * b * c, FEATURES[5]: F.sqrt(a * a + b * b + c * c)})
