"""Per-voxel functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a division by 0 gives.
LARGEST_FLOAT = 3.4028234663852886e38


def clamp(v: Column, low: float = 0, high: float = 1) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def threshold(v: Column, low: float, high: float, inside: int = 1, outside: int = 0) -> Column:
    """``inside`` where low <= v <= high."""
    return F.when(v.between(low, high), inside).otherwise(outside)


def remap(v: Column, include: list[int], inside: int = 1, outside: int = 0) -> Column:
    return F.when(v.isin(include), inside).otherwise(outside)


def apply_mask(v: Column, mask: Column, outside: float = 0.0) -> Column:
    return F.when(mask != 0, v).otherwise(F.lit(outside))


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(LARGEST_FLOAT))


def multiply(a: Column, b: Column) -> Column:
    return a * b


def intensity_window(v: Column, width: float = 1500.0, level: float = -500.0) -> Column:
    """Values from level - width / 2 to level + width / 2 as 0 to 255, others at the ends."""
    low, high = level - width / 2, level + width / 2
    return F.when(v < low, 0).when(v > high, 255).otherwise(F.floor((v - low) * 255.0 / (high - low))).cast("int")


def bin_index(v: Column, edges: list[float]) -> Column:
    """Number of edges below v: bins are right-closed.  NaN is in the first."""
    count = F.lit(0)
    for e in edges:
        count = count + (v > F.lit(float(e))).cast("int")
    return F.when(F.isnan(v), 0).otherwise(count)


def bin_index_of(v: Column, edges: Column) -> Column:
    """The same with the edges as a sorted array column."""
    return F.when(F.isnan(v), 0).otherwise(F.size(F.filter(edges, lambda e: e < v)))
