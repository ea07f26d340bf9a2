"""Stencils on dense lattices: derivatives, Gaussian smoothing, multi-scale features.

A single pass along an axis is a window over the lines of that axis; one exchange puts
a line's voxels together and serves all columns of the pass.  Features of many scales
are array passes over bricks with a halo as wide as the widest kernel: one exchange for
all scales, axes and derivatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.functions.eigen import eigen_features
from voxelloom.functions.pointwise import LARGEST_FLOAT, apply_mask, divide
from voxelloom.operators.bricks import SIDE, Brick, in_bricks, lines
from voxelloom.operators.lattice import AXES

HESSIAN = ("hxx", "hxy", "hxz", "hyy", "hyz", "hzz")
FEATURES = ("GaussianBlur", "GradientMagnitude", "Eigenvalue1", "Eigenvalue2", "Eigenvalue3", "LaplacianOfGaussian", "GaussianCurvature", "FrobeniusNorm")
#: Kernels of a larger radius run as array passes over lines instead of long window expressions.
WINDOW_RADIUS = 12


def _line(axis: str, by: tuple[str, ...] = ("volume_id",)):
    return Window.partitionBy(*by, *[a for a in AXES if a != axis]).orderBy(axis)


def shifted(value: str, axis: str, k: int, by: tuple[str, ...] = ("volume_id",)) -> Column:
    """The value k places further on; beyond the ends the last one repeats."""
    w = _line(axis, by)
    if k == 0:
        return F.col(value)
    end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(value, k).over(w), F.last(value).over(end)) if k > 0 else F.coalesce(F.lag(value, -k).over(w), F.first(value).over(end))


def derivative(value: str, axis: str, order: int = 1, spacing: float = 1.0, by: tuple[str, ...] = ("volume_id",)) -> Column:
    """Central difference of order 1 or 2; the ends repeat."""
    before, after = shifted(value, axis, -1, by), shifted(value, axis, 1, by)
    return (after - before) / (2.0 * spacing) if order == 1 else (after - 2.0 * F.col(value) + before) / (spacing * spacing)


def gradient(voxels: DataFrame, value: str = "v", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    for a, s in zip(AXES, spacing, strict=True):
        voxels = voxels.withColumn(f"d{a}", derivative(value, a, 1, s, by))
    return voxels


def gradient_magnitude(voxels: DataFrame, value: str = "v", name: str = "GradientMagnitude", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    g = gradient(voxels, value, spacing, by)
    return g.withColumn(name, F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))).drop("dx", "dy", "dz")


def derivatives(voxels: DataFrame, value: str = "v", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """First derivatives and the Hessian's six components, in one pass along each axis."""
    sx, sy, sz = spacing
    first = voxels.withColumns({"dx": derivative(value, "x", 1, sx, by), "hxx": derivative(value, "x", 2, sx, by)})
    second = first.withColumns({"dy": derivative(value, "y", 1, sy, by), "hyy": derivative(value, "y", 2, sy, by), "hxy": derivative("dx", "y", 1, sy, by)})
    return second.withColumns({"dz": derivative(value, "z", 1, sz, by), "hzz": derivative(value, "z", 2, sz, by), "hxz": derivative("dx", "z", 1, sz, by), "hyz": derivative("dy", "z", 1, sz, by)})


def hessian(voxels: DataFrame, value: str = "v", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    return derivatives(voxels, value, spacing).drop("dx", "dy", "dz")


def hessian_features(voxels: DataFrame, value: str = "v", mask: str | None = "m", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Eigenvalue features of the unsmoothed Hessian, masked."""
    out = eigen_features(hessian(voxels, value, spacing), HESSIAN).drop(*HESSIAN)
    return out.withColumns({c: apply_mask(F.col(c), F.col(mask)) for c in FEATURES[2:]}) if mask else out


def gaussian_kernel(sigma: float, spacing: float = 1.0, width: float = 4.0) -> list[float]:
    """Weights of -radius to radius, which sum to 1."""
    radius = max(1, math.ceil(width * sigma / spacing))
    w = [math.exp(-0.5 * (k * spacing / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


# Amplitudes, frequencies and decays of the two oscillations that a fourth-order recursive Gaussian sums on either side.
_RECURSIVE = ((1.3530, 1.8151, 0.6681, -1.3932), (-0.3531, 0.0902, 2.0787, -1.3732))


def recursive_kernel(sigma: float, spacing: float = 1.0, least: float = 1e-5) -> list[float]:
    """Impulse response of the fourth-order recursive approximation of a Gaussian, down to ``least`` of its peak.

    On lines whose ends repeat, its convolution is what the recursive filter gives.
    """
    width = -math.log(least / 2) / 1.3732
    radius = max(1, math.ceil(width * sigma / spacing))
    at = np.arange(radius + 1) * spacing / sigma
    half = sum((a * np.cos(w * at) + b * np.sin(w * at)) * np.exp(d * at) for a, b, w, d in _RECURSIVE)
    whole = np.concatenate([half[:0:-1], half])
    return (whole / whole.sum()).tolist()


def _recursion(sigma: float, spacing: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Poles and their weights of the recursive Gaussian, and the sum of its whole response."""
    poles = np.array([np.exp(complex(d, w) * spacing / sigma) for _, _, w, d in _RECURSIVE])
    weights = np.array([complex(a, -b) for a, b, _, _ in _RECURSIVE])
    return poles, weights, float(2 * (weights / (1 - poles)).sum().real - weights.sum().real)


def recursive_lines(grid: np.ndarray, axis: int, sigma: float, spacing: float = 1.0) -> np.ndarray:
    """The recursive Gaussian along an axis, forward and backward; the ends repeat.

    A pole's state is what came before, decayed; it goes from place to place, whatever
    sigma.  Before the first place (after the last) the state is that of a line of its
    value.
    """
    poles, weights, total = _recursion(sigma, spacing)
    x = np.moveaxis(grid, axis, 0)
    n, shape = len(x), (len(poles),) + (1,) * (x.ndim - 1)
    p, c = poles.reshape(shape), weights.reshape(shape)
    out = np.empty(x.shape)
    state = x[0] / (1 - p)
    for i in range(n):
        state = p * state + x[i]
        out[i] = (c * state).sum(0).real
    state = x[-1] / (1 - p)
    for i in range(n - 1, -1, -1):
        # What comes after this place only: it is in the forward half itself.
        out[i] += (c * p * state).sum(0).real
        state = p * state + x[i]
    return np.moveaxis(out / total, 0, axis)


#: Lines of so many neighbours on either of the other axes are a group of the recursive pass.
BUNDLE = 16


def _bundle(axis: int, step: float, smooth: dict[str, tuple[str, float]], kept: list[str], arrow: pa.Schema):
    """Lines of a bundle smoothed along one axis: new columns (name: (column, sigma)) beside those that are kept."""

    def run(table: pa.Table) -> pa.Table:
        at = tuple((q := table.column(a).to_numpy()) - q.min() for a in AXES)
        cols = [table.column(c) for c in kept]
        for column, sigma in smooth.values():
            grid = np.zeros(tuple(int(q.max()) + 1 for q in at))
            grid[at] = table.column(column).cast(pa.float64()).to_numpy()
            cols.append(pa.array(recursive_lines(grid, axis, sigma, step)[at]))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return run


def recursive_smooth(voxels: DataFrame, smooth: dict[str, tuple[str, float]], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """New columns (name: (column, sigma)) of recursively smoothed values, all in the same three passes.

    A pass has bundles of whole lines of one axis in a group, one exchange, and no halo:
    its cost doesn't depend on sigma.  A group holds BUNDLE * BUNDLE lines.  The lattice
    is dense.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    for i, (axis, step) in enumerate(zip(AXES, spacing, strict=True)):
        kept = [f for f in voxels.schema.fields if f.name not in smooth]
        schema = T.StructType([*kept, *[T.StructField(name, T.DoubleType()) for name in smooth]])
        run = _bundle(i, step, {name: (c if i == 0 else name, sigma) for name, (c, sigma) in smooth.items()}, [f.name for f in kept], to_arrow_schema(schema))
        bundle = [F.floor(F.col(a) / BUNDLE).alias(f"_b{a}") for a in AXES if a != axis]
        voxels = voxels.groupBy(*by, *bundle).applyInArrow(run, schema)
    return voxels


def _line_pass(columns: list[str], axis: str, kernel: list[float]):
    radius = len(kernel) // 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(axis)
            for c in columns:
                frame[c] = np.convolve(np.pad(frame[c].to_numpy(float), radius, "edge"), kernel[::-1], "valid")
            yield frame

    return lambda frame: next(run(iter([frame])))


def convolved(voxels: DataFrame, columns: list[str], axis: str, kernel: list[float], by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """Columns convolved along an axis; the ends repeat."""
    radius = len(kernel) // 2
    if radius > WINDOW_RADIUS:
        schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in columns else f.dataType) for f in voxels.schema])
        return voxels.groupBy(*by, *[a for a in AXES if a != axis]).applyInPandas(_line_pass(columns, axis, kernel), schema)
    out = {}
    for c in columns:
        total = F.lit(0.0)
        for k, w in zip(range(-radius, radius + 1), kernel, strict=True):
            total = total + F.lit(w) * shifted(c, axis, k, by)
        out[c] = total
    return voxels.withColumns(out)


def gaussian_smooth(voxels: DataFrame, columns: list[str], sigma: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), width: float = 4.0, by: tuple[str, ...] = ("volume_id",), recursive: bool = False) -> DataFrame:
    """Separable sampled Gaussian, cut at ``width`` standard deviations, or its recursive approximation on dense lattices."""
    if recursive:
        return recursive_smooth(voxels, {c: (c, sigma) for c in columns}, spacing, by).select(*voxels.columns)
    for a, s in zip(AXES, spacing, strict=True):
        voxels = convolved(voxels, columns, a, gaussian_kernel(sigma, s, width), by)
    return voxels


def normalized_convolution(voxels: DataFrame, value: str = "v", certainty: str = "c", sigma: float = 1.0, name: str = "GaussianBlur", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), width: float = 4.0, by: tuple[str, ...] = ("volume_id",), recursive: bool = False) -> DataFrame:
    """Smoothed value * certainty over smoothed certainty, both in the same passes."""
    both = voxels.withColumns({"_cv": F.col(value) * F.col(certainty), "_c": F.col(certainty).cast("double")})
    smooth = gaussian_smooth(both, ["_cv", "_c"], sigma, spacing, width, by, recursive)
    return smooth.withColumn(name, divide(F.col("_cv"), F.col("_c"))).drop("_cv", "_c")


#: What bricks give for each voxel and scale, before eigenvalues.
_RAW = (FEATURES[0], "dx", "dy", "dz", *HESSIAN)


def _derived(blur: np.ndarray, spacing: tuple[float, float, float]) -> list[np.ndarray]:
    """First derivatives and the Hessian's components."""
    near = lambda g, axis: [lines(g, axis, w, 1, 1) for w in ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0))]
    first, second = [], []
    for axis, step in enumerate(spacing):
        before, after = near(blur, axis)
        first.append((after - before) / (2.0 * step))
    for p in range(3):
        for q in range(p, 3):
            before, after = near(blur if p == q else first[p], q)
            second.append((after - 2.0 * blur + before) / (spacing[p] * spacing[p]) if p == q else (after - before) / (2.0 * spacing[q]))
    return first + second


def _in_scales(voxels: DataFrame, scales: list[float], value: str, mask: str, spacing: tuple[float, float, float], width: float, recursive: bool, derive: bool) -> DataFrame:
    """Every voxel and scale with the normalised convolution and, if asked, its derivatives.

    Sampled kernels are passes over bricks whose halo is as wide as the widest; one
    exchange for all scales.  The recursion smooths all scales in three passes over lines
    first, and bricks need a halo of one voxel, for derivatives.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept, names = voxels.columns, _RAW if derive else _RAW[:1]
    schema = T.StructType([*voxels.schema.fields, T.StructField("scale_idx", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    kernels = {} if recursive else {(sigma, s): gaussian_kernel(sigma, s, width) for sigma in scales for s in spacing}
    rows, halo = voxels, (int(derive),) * 3
    if recursive:
        certain = F.when(F.col(mask) != 0, 1.0).otherwise(0.0)
        both = voxels.withColumns({"_cv": F.col(value) * certain, "_c": certain})
        rows = recursive_smooth(both, {f"_{c}{i}": (f"_{c}", sigma) for i, sigma in enumerate(scales) for c in ("cv", "c")}, spacing).drop("_cv", "_c")
    else:
        halo = tuple(len(kernels[max(scales), s]) // 2 + derive for s in spacing)

    def run(brick: Brick) -> pa.Table:
        own, parts = brick.own_rows().select(kept), []
        certain = None if recursive else (brick.grid(mask) != 0).astype(float)
        for i, sigma in enumerate(scales):
            if recursive:
                both = [brick.grid(f"_{c}{i}") for c in ("cv", "c")]
            else:
                both = [brick.grid(value) * certain, certain]
                for axis, step in enumerate(spacing):
                    kernel = kernels[sigma, step]
                    radius = len(kernel) // 2
                    both = [lines(g, axis, kernel, radius, radius) for g in both]
            blur = np.where(both[1] != 0, both[0] / np.where(both[1] != 0, both[1], 1.0), LARGEST_FLOAT)
            part = own.append_column("scale_idx", pa.array(np.full(own.num_rows, i, np.int32)))
            for name, grid in zip(names, [blur, *(_derived(blur, spacing) if derive else [])], strict=True):
                part = part.append_column(name, pa.array(brick.at_own(grid)))
            parts.append(part)
        return pa.concat_tables(parts).cast(to_arrow_schema(schema))

    # Bricks three times as wide as a halo: of a voxel there are 4.6 copies at most, not 8.
    others = [c for c in kept if c not in ("volume_id", *AXES, value, mask)]
    found = in_bricks(rows, halo, run, schema, side=max(SIDE, 3 * max(halo)), own_only=others)
    return found.withColumn("scale", F.element_at(F.array(*[F.lit(float(s)) for s in scales]), F.col("scale_idx") + 1))


def blurred(voxels: DataFrame, scales: list[float], value: str = "v", mask: str = "m", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), width: float = 4.0, recursive: bool = False) -> DataFrame:
    """The normalised convolution of every voxel at every scale, with the mask, as 0 or 1, for certainty: a row for each, with scale_idx and scale."""
    return _in_scales(voxels, scales, value, mask, spacing, width, recursive, False)


def features(voxels: DataFrame, scales: list[float], value: str = "v", mask: str = "m", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), width: float = 4.0, recursive: bool = False) -> DataFrame:
    """The eight features of every voxel at every scale: a row for each, with scale_idx and scale.

    Values are smoothed with the mask, as 0 or 1, for certainty; gradient and Hessian
    are those of the smoothed values before masking; each feature is masked at last.
    A brick's halo is one voxel wider than the widest kernel, or one voxel after recursive
    smoothing.
    """
    d = _in_scales(voxels, scales, value, mask, spacing, width, recursive, True)
    d = d.withColumn(FEATURES[1], F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    d = eigen_features(d, HESSIAN).drop("dx", "dy", "dz", *HESSIAN)
    return d.withColumns({c: apply_mask(F.col(c), F.col(mask)) for c in FEATURES})


def feature_rows(featured: DataFrame) -> DataFrame:
    """One row for each voxel and histogram: hist_idx = scale_idx * 8 + feature, value."""
    pairs = ", ".join(f"{i}, `{c}`" for i, c in enumerate(FEATURES))
    kept = [c for c in featured.columns if c not in (*FEATURES, "scale")]
    long = featured.selectExpr(*kept, f"stack({len(FEATURES)}, {pairs}) AS (feature_idx, value)")
    return long.withColumn("hist_idx", (F.col("scale_idx") * len(FEATURES) + F.col("feature_idx")).cast("int")).drop("scale_idx", "feature_idx")
