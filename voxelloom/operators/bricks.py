"""Array passes over bricks of dense lattices, each with a halo of its neighbours' voxels: one exchange, whatever the pass does."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.lattice import AXES

#: Side of a brick at least.
SIDE = 32


class Brick:
    """A group's rows as arrays: the brick with as much of its halo as the volume has."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.place = [table.column(a).to_numpy() for a in AXES]
        self.start = [int(p.min()) for p in self.place]
        self.shape = tuple(int(p.max()) - s + 1 for p, s in zip(self.place, self.start, strict=True))
        self.at = tuple(p - s for p, s in zip(self.place, self.start, strict=True))
        self.own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))

    def grid(self, column: str) -> np.ndarray:
        """Values indexed [x, y, z]; 0 where a voxel is missing."""
        out = np.zeros(self.shape)
        out[self.at] = self.table.column(column).to_numpy(zero_copy_only=False)
        return out

    def at_own(self, grid: np.ndarray) -> np.ndarray:
        """What a grid has at the brick's own voxels."""
        return grid[tuple(i[self.own] for i in self.at)]

    def own_rows(self) -> pa.Table:
        return self.table.take(pa.array(self.own)).drop_columns(["_own", "_bx", "_by", "_bz"])


def side_for(halo: tuple[int, int, int]) -> int:
    """A brick is no smaller than both its halos, so no voxel is copied to more than two bricks an axis."""
    return max(SIDE, 2 * max(halo))


def in_bricks(voxels: DataFrame, halo: tuple[int, int, int], run: Callable[[Brick], pa.Table], schema: T.StructType, keys: tuple[str, ...] = ("volume_id",), side: int | None = None, below: tuple[int, int, int] | None = None, halo_alone: bool = False, own_only: list[str] | None = None) -> DataFrame:
    """``run`` on each brick with ``halo`` voxels more on either side of each axis (``below``: fewer before it); it returns rows for the brick's own voxels.

    Bricks end where the volume does: what is there of a halo says how far it goes.
    ``halo_alone`` runs bricks too that have no voxel of their own; columns ``own_only``
    are null in a halo, where nothing needs them.
    """
    side = side or side_for(halo)
    rows = voxels
    for a, h, less in zip(AXES, halo, below or halo, strict=True):
        number = lambda k, a=a: F.floor((F.col(a) + F.lit(k)) / F.lit(side)).cast("int")
        near = F.array_distinct(F.array(number(-h), number(0), number(less))) if h else F.array(number(0))
        rows = rows.withColumn(f"_b{a}", F.explode(near))
    own = [F.floor(F.col(a) / F.lit(side)).cast("int") == F.col(f"_b{a}") for a in AXES]
    rows = rows.withColumn("_own", own[0] & own[1] & own[2])
    if own_only:
        rows = rows.withColumns({c: F.when(F.col("_own"), F.col(c)) for c in own_only})

    def group(table: pa.Table) -> pa.Table:
        brick = Brick(table.combine_chunks())
        return run(brick) if halo_alone or len(brick.own) else pa.Table.from_pylist([], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.groupBy(*keys, "_bx", "_by", "_bz").applyInArrow(group, schema)


def lines(grid: np.ndarray, axis: int, weights: np.ndarray, before: int, after: int) -> np.ndarray:
    """Sums of ``before`` to ``after`` neighbours along an axis with these weights; the ends repeat."""
    n = grid.shape[axis]
    width = [(0, 0)] * grid.ndim
    width[axis] = (before, after)
    padded = np.pad(grid, width, "edge")
    out = np.zeros(grid.shape)
    for k, w in enumerate(weights):
        out += w * np.take(padded, range(k, k + n), axis)
    return out


def box_sums(grid: np.ndarray, box: tuple[int, int, int]) -> np.ndarray:
    """Sums over the box around every place, from half its size (rounded down) before; beyond the grid there is nothing."""
    for axis, b in enumerate(box):
        n = grid.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(grid, [0], axis)), np.cumsum(grid, axis)], axis)
        begin = np.clip(np.arange(n) - b // 2, 0, n)
        end = np.clip(np.arange(n) - b // 2 + b, 0, n)
        grid = np.take(total, end, axis) - np.take(total, begin, axis)
    return grid
