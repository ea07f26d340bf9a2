"""Resampling onto grids of any orientation, brick by brick of the target.

Places of the source are affine in places of the target, so each voxel of the source
knows which target places it can touch: it goes to the bricks that have some, mostly one.
A brick then looks up its own places in what came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.bricks import SIDE
from voxelloom.operators.lattice import AXES

Matrix = list[list[float]]
IDENTITY: Matrix = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
#: Decimals of a place in the source: places that are whole but for rounding are whole.
DIGITS = 9


def index_map(source: dict, target: dict) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and offset that take a target's index to the source's, where both have origin, spacing and direction (columns are the axes' cosines)."""
    frame = lambda g: np.array(g.get("direction") or IDENTITY, float) @ np.diag(g["spacing"])
    back = np.linalg.inv(frame(source))
    return back @ frame(target), back @ (np.array(target["origin"], float) - np.array(source["origin"], float))


def _looked_up(places: np.ndarray, grid: np.ndarray, start: np.ndarray, old: tuple[int, int, int], order: int, outside: float) -> np.ndarray:
    """Values at places (n x 3, in the source's indices) by nearest neighbour or linear interpolation."""
    last = np.array(old) - 1
    out = np.full(len(places), outside)
    on = ((places >= 0) & (places <= last)).all(1)
    p = places[on]
    if order == 0:
        near = np.floor(p + 0.5).astype(np.int64) - start
        out[on] = grid[tuple(near.T)]
        return out
    low = np.floor(p).astype(np.int64)
    part, total = p - low, np.zeros(len(p))
    for corner in np.ndindex(2, 2, 2):
        weight = np.prod(np.where(np.array(corner) == 1, part, 1 - part), 1)
        at = np.minimum(low + corner, last) - start
        used = weight > 0
        total[used] += weight[used] * grid[tuple(at[used].T)]
    out[on] = total
    return out


def resampled_onto(voxels: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int], matrix: Matrix | np.ndarray, offset: list[float] | np.ndarray, value: str = "v", order: int = 1, outside: float = 0.0, side: int = SIDE) -> DataFrame:
    """(volume_id, x, y, z, value) of each volume at the places ``matrix @ index + offset`` of its own indices.

    Nearest neighbour (order 0) or linear interpolation (1); places outside of the old
    lattice get ``outside``.  One exchange, in which a voxel near a brick's side is copied.
    """
    a, b = np.array(matrix, float), np.array(offset, float)
    back = np.linalg.inv(a)
    reach = np.abs(back).sum(1) + 1e-6  # target places that are less than a voxel away, in any axis of the source
    shown = [f"CAST({float(x)!r} AS DOUBLE)" for x in b]
    rows = voxels.select("volume_id", *AXES, F.col(value).cast("double").alias("value"), F.lit(False).alias("_mark"))
    for i, n in enumerate(new):
        at = F.expr(" + ".join(f"CAST({float(back[i, j])!r} AS DOUBLE) * ({c} - {shown[j]})" for j, c in enumerate(AXES)))
        number = lambda e, n=n: F.least(F.greatest(F.floor(e), F.lit(0)), F.lit(n - 1))
        low, high = number(at - float(reach[i])), number(at + float(reach[i]))
        rows = rows.filter((at > -float(reach[i])) & (at < n - 1 + float(reach[i]))).withColumn(f"_b{AXES[i]}", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    bricks = voxels.select("volume_id").distinct()
    for c, n in zip(AXES, new, strict=True):
        bricks = bricks.withColumn(f"_b{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // side).cast("long"))))
    nowhere = F.lit(0).cast("long")
    marks = bricks.select("volume_id", *[nowhere.alias(c) for c in AXES], F.lit(0.0).alias("value"), F.lit(True).alias("_mark"), *[f"_b{c}" for c in AXES])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        volume, *brick = (k.as_py() for k in key)
        own = [np.arange(k * side, min((k + 1) * side, n)) for k, n in zip(brick, new, strict=True)]
        index = np.stack(np.meshgrid(*own, indexing="ij"), -1).reshape(-1, 3)
        there = ~table.column("_mark").to_numpy(zero_copy_only=False)
        place = np.stack([table.column(c).to_numpy()[there] for c in AXES], 1).astype(np.int64)
        if len(place):
            start = place.min(0)
            grid = np.zeros(place.max(0) - start + 1)
            grid[tuple((place - start).T)] = table.column("value").to_numpy()[there]
            values = _looked_up(np.round(index @ a.T + b, DIGITS), grid, start, old, order, outside)
        else:
            values = np.full(len(index), outside)
        return pa.Table.from_arrays([pa.array([volume] * len(index), pa.string()), *[pa.array(c) for c in index.T.astype(np.int64)], pa.array(values)], names=["volume_id", *AXES, value])

    return rows.unionByName(marks).groupBy("volume_id", *[f"_b{c}" for c in AXES]).applyInArrow(run, f"volume_id string, x long, y long, z long, `{value}` double")
