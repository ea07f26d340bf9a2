"""Distance maps, expected distances, and spline resampling of slices: array passes where columns can't say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.lattice import AXES


def envelopes(height: np.ndarray, step: float) -> np.ndarray:
    """Along the last axis, min over j of (step * (i - j))**2 + height[j] for every i: lower envelopes of parabolas, of all lines at once."""
    lines, n = height.shape
    s2, row = step * step, np.arange(lines)
    # Of each line a stack of parabolas, by their places, and where each begins to be lowest.
    place, begin = np.zeros((lines, n), np.int64), np.full((lines, n + 1), np.inf)
    top = np.full(lines, -1)
    for q in range(n):
        todo = row[np.isfinite(height[:, q])]
        cross = np.full(lines, -np.inf)
        left = todo[top[todo] >= 0]
        while len(left):
            p = place[left, top[left]]
            cross[left] = (height[left, q] - height[left, p] + s2 * (q * q - p * p)) / (2 * s2 * (q - p))
            left = left[cross[left] <= begin[left, top[left]]]
            top[left] -= 1
            cross[left[top[left] < 0]] = -np.inf
            left = left[top[left] >= 0]
        top[todo] += 1
        place[todo, top[todo]], begin[todo, top[todo]] = q, cross[todo]
    out, at = np.full((lines, n), np.inf), np.zeros(lines, np.int64)
    some = row[top >= 0]
    for i in range(n):
        on = some
        while len(on):
            on = on[at[on] < top[on]]
            on = on[begin[on, at[on] + 1] < i]
            at[on] += 1
        owner = place[some, at[some]]
        out[some, i] = s2 * (i - owner) ** 2 + height[some, owner]
    return out


def squared_distance(voxels: DataFrame, target, name: str = "d2", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Exact squared distance of each voxel to the nearest one where ``target`` holds; infinite without any.

    A task holds one plane at a time: first those of x and y, of which all lines of
    both axes are done together, then those of x and z for the third axis.
    """
    rows = voxels.withColumn(name, F.when(target, F.lit(0.0)).otherwise(F.lit(float("inf"))))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    steps = dict(zip(AXES, spacing, strict=True))

    def within(first: str, second: str, axes: tuple[str, ...]):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            i, j = (frame[a].to_numpy() - frame[a].min() for a in (first, second))
            grid = np.full((int(i.max()) + 1, int(j.max()) + 1), np.inf)
            grid[i, j] = frame[name].to_numpy(float)
            if first in axes:
                grid = envelopes(np.ascontiguousarray(grid.T), steps[first]).T
            if second in axes:
                grid = envelopes(np.ascontiguousarray(grid), steps[second])
            return frame.assign(**{name: grid[i, j]})

        return run

    rows = rows.groupBy("volume_id", "z").applyInPandas(within("x", "y", ("x", "y")), schema)
    return rows.groupBy("volume_id", "y").applyInPandas(within("x", "z", ("z",)), schema)


def signed_distance(voxels: DataFrame, mask: str = "m", squared: bool = True, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Distance to the mask's boundary voxels, positive inside; boundary voxels are those of the mask next to one outside of it."""
    inside = F.col(mask) != 0
    edged = voxels
    near = F.lit(False)
    for a in AXES:
        w = Window.partitionBy("volume_id", *[b for b in AXES if b != a]).orderBy(a)
        edged = edged.withColumn(f"_{a}", (F.coalesce(F.lag(mask).over(w), F.lit(1)) == 0) | (F.coalesce(F.lead(mask).over(w), F.lit(1)) == 0))
        near = near | F.col(f"_{a}")
    edged = edged.withColumn("_edge", inside & near).drop(*[f"_{a}" for a in AXES])
    d = squared_distance(edged, F.col("_edge"), "distance", spacing).drop("_edge")
    size = F.col("distance") if squared else F.sqrt("distance")
    return d.withColumn("distance", F.when(inside, size).otherwise(-size))


def expected_distance(voxels: DataFrame, distance: str = "distance", probability: str = "p", mask: str = "m") -> DataFrame:
    """Per volume the mean over the mask of distance * probability; 0 without a mask."""
    value = F.when(F.col(mask) != 0, F.col(distance) * F.col(probability))
    return voxels.groupBy("volume_id").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("expected_distance"))


def _poles(order: int) -> list[float]:
    """Poles of the recursive filter that makes spline coefficients."""
    return {0: [], 1: [], 2: [np.sqrt(8) - 3], 3: [np.sqrt(3) - 2], 4: [np.sqrt(664 - np.sqrt(438976)) + np.sqrt(304) - 19, np.sqrt(664 + np.sqrt(438976)) - np.sqrt(304) - 19], 5: [np.sqrt(135 / 2 - np.sqrt(17745 / 4)) + np.sqrt(105 / 4) - 13 / 2, np.sqrt(135 / 2 + np.sqrt(17745 / 4)) - np.sqrt(105 / 4) - 13 / 2]}[order]


def spline_basis(order: int, x: np.ndarray) -> np.ndarray:
    """Centred B-spline by its recurrence."""
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    h = (order + 1) / 2
    return ((x + h) * spline_basis(order - 1, x + 0.5) + (h - x) * spline_basis(order - 1, x - 0.5)) / order


def spline_coefficients(line: np.ndarray, order: int) -> np.ndarray:
    """Coefficients, along the last axis, of the spline through the values; ends are mirrored."""
    c = line.astype(float).copy()
    n = c.shape[-1]
    if n == 1:
        return c
    for z in _poles(order):
        c *= (1 - z) * (1 - 1 / z)
        k = np.arange(2 * n - 2)
        mirrored = np.concatenate([c, c[..., -2:0:-1]], axis=-1)
        c[..., 0] = (mirrored * z**k).sum(axis=-1) / (1 - z ** (2 * n - 2))
        for i in range(1, n):
            c[..., i] += z * c[..., i - 1]
        c[..., -1] = z / (z * z - 1) * (c[..., -1] + z * c[..., -2])
        for i in range(n - 2, -1, -1):
            c[..., i] = z * (c[..., i + 1] - c[..., i])
    return c


def spline_matrix(n: int, at: np.ndarray, order: int) -> np.ndarray:
    """Weights of n coefficients for values at places; places beyond the ends take the nearest inside."""
    at = np.clip(at, 0, n - 1)
    first = np.floor(at - (order - 1) / 2).astype(int)
    out = np.zeros((len(at), n))
    for k in range(order + 1):
        i = first + k
        w = spline_basis(order, at - i)
        j = np.abs(i)
        j = np.where(j > n - 1, 2 * (n - 1) - j, j) if n > 1 else np.zeros_like(j)
        np.add.at(out, (np.arange(len(at)), np.clip(j, 0, n - 1)), w)
    return out


def resampled_slices(voxels: DataFrame, spacing: tuple[float, float], new_spacing: float = 0.25, order: int = 3, value: str = "v", mask: str | None = None) -> DataFrame:
    """Slices (volume_id, z) of the plane x, y at an even spacing, by B-splines of order 0 to 5; size ceil(size * spacing / new_spacing).

    With ``mask``, a column of that name has the mask at the nearest old place.
    """
    schema = "volume_id string, x long, y long, z long, value double" + (f", `{mask}` long" if mask else "")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.pivot(index="y", columns="x", values=value).to_numpy(float)
        ny, nx = grid.shape
        mx, my = (int(np.ceil(n * s / new_spacing)) for n, s in ((nx, spacing[0]), (ny, spacing[1])))
        px, py = np.arange(mx) * new_spacing / spacing[0], np.arange(my) * new_spacing / spacing[1]
        c = spline_coefficients(spline_coefficients(grid, order).T, order).T
        out = spline_matrix(ny, py, order) @ c @ spline_matrix(nx, px, order).T
        y, x = np.divmod(np.arange(mx * my), mx)
        found = pd.DataFrame({"volume_id": frame["volume_id"].iloc[0], "x": x, "y": y, "z": frame["z"].iloc[0], "value": out.ravel()})
        if mask:
            near = [np.minimum(np.floor(p + 0.5), n - 1).astype(int) for p, n in ((py, ny), (px, nx))]
            found[mask] = frame.pivot(index="y", columns="x", values=mask).to_numpy()[np.ix_(*near)].ravel().astype("int64")
        return found

    return voxels.groupBy("volume_id", "z").applyInPandas(run, schema)
