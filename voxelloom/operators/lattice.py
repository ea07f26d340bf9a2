"""Dense lattices: one row per voxel, with volume_id, x, y, z and value columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
KEYS = ("volume_id", "x", "y", "z")


def places(spark: SparkSession, size: tuple[int, int, int]) -> DataFrame:
    """Every (x, y, z) of a volume, in raster order, made in as many tasks as the session has."""
    nx, ny, nz = size
    return spark.range(nx * ny * nz).select((F.col("id") % nx).alias("x"), F.expr(f"id div {nx} % {ny}").alias("y"), F.expr(f"id div {nx * ny}").alias("z"))


def spine(volumes: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Every voxel (volume_id, x, y, z) of volumes of one size, made from their ids; slices are dealt out before they are filled."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slices = volumes.select("volume_id", every(size[2]).alias("z")).repartition("volume_id", "z")
    return slices.withColumn("y", every(size[1])).withColumn("x", every(size[0])).select(*KEYS)


def densified(voxels: DataFrame, size: tuple[int, int, int], fill: dict[str, object]) -> DataFrame:
    """Voxels of every place; those that aren't there get ``fill``."""
    grid = spine(voxels.select("volume_id").distinct(), size)
    return grid.join(voxels, list(KEYS), "left").select(*KEYS, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])


def voxelise(rows: DataFrame, place: dict[str, Column], values: dict[str, Column], size: tuple[int, int, int], fill: dict[str, object], volume: Column | None = None) -> DataFrame:
    """A dense lattice of aggregates of rows by place; sums are partial before the shuffle."""
    keyed = rows.select("*", (F.lit("all") if volume is None else volume).alias("volume_id"), *[c.cast("long").alias(a) for a, c in place.items()])
    found = keyed.groupBy(*KEYS).agg(*[c.alias(n) for n, c in values.items()])
    if volume is None:
        found = places(rows.sparkSession, size).join(found.drop("volume_id"), list(AXES), "left")
        return found.select(F.lit("all").alias("volume_id"), *AXES, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])
    return densified(found, size, fill)


def image_with_mask(image: DataFrame, mask: DataFrame) -> DataFrame:
    """Positional join of two lattices; hash or sort-merge, as their sizes ask."""
    return image.join(mask, list(KEYS))


def volume_info(voxels: DataFrame) -> DataFrame:
    """Size and extent of each volume."""
    return voxels.groupBy("volume_id").agg(
        *[(F.max(a) - F.min(a) + 1).alias(f"size_{a}") for a in AXES],
        F.count(F.lit(1)).alias("n_voxels"),
    )


def flipped(voxels: DataFrame, axis: str, size: int) -> DataFrame:
    return voxels.withColumn(axis, F.lit(size - 1) - F.col(axis))


def cropped(voxels: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int], reindex: bool = True) -> DataFrame:
    """A box of each volume; ranges reach the scan as filters."""
    for axis, a, n in zip(AXES, start, size, strict=True):
        voxels = voxels.filter(F.col(axis).between(a, a + n - 1))
    return voxels.withColumns({a: F.col(a) - s for a, s in zip(AXES, start, strict=True)}) if reindex else voxels


def bounding_box(voxels: DataFrame, mask: str = "m") -> DataFrame:
    """Per volume: smallest box of all voxels in the mask; the union of the boxes of its components is the same."""
    return voxels.filter(F.col(mask) != 0).groupBy("volume_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def cropped_to_mask(voxels: DataFrame, mask: str = "m") -> DataFrame:
    """Each volume cut to its mask's bounding box and indexed from 0; one row a volume is broadcast if small."""
    boxed = voxels.join(bounding_box(voxels, mask), "volume_id")
    for a in AXES:
        boxed = boxed.filter(F.col(a).between(F.col(f"min_{a}"), F.col(f"max_{a}")))
    return boxed.select("volume_id", *[(F.col(a) - F.col(f"min_{a}")).alias(a) for a in AXES], *[c for c in voxels.columns if c not in KEYS])


def padded(voxels: DataFrame, old: tuple[int, ...], new: tuple[int, ...], fill: dict[str, object]) -> DataFrame:
    """Constant padding to a new size: half of it before, the other half and what is odd after."""
    if any(n < o for o, n in zip(old, new, strict=True)):
        raise ValueError("the new size is smaller than the old")
    full = tuple(new) + (1,) * (3 - len(new))
    shift = {a: F.col(a) + (n - o) // 2 for a, o, n in zip(AXES, old, new, strict=False)}
    return densified(voxels.withColumns(shift), full, fill)


def slice_indices(n: int, indices: list[int] | None = None, locations: list[float] | None = None, window: int = 0, stride: int = 1) -> list[int]:
    """Slices asked for by index or by relative location, with neighbours within a window.

    Locations outside [0, 1] count for nothing; without any index all are taken; a
    stride of 0 counts as 1.  Neighbours outside the volume are left out, indices
    outside are an error.
    """
    chosen = list(indices or [])
    for at in locations or []:
        if 0 <= at <= 1:
            chosen.append(int(at * (n - 1) + 0.5))
    if not chosen:
        return list(range(n))
    step = max(stride, 1)
    near = [i + s * d for i in chosen for d in range(step, window // 2 + 1, step) for s in (-1, 1)]
    chosen = sorted({*chosen, *(i for i in near if 0 <= i < n)})
    if chosen[-1] >= n or chosen[0] < 0:
        raise ValueError(f"slice {chosen[-1]} is outside of {n}")
    return chosen


def slices(voxels: DataFrame, axis: str, n: int, flip: int | None = None, **chosen) -> DataFrame:
    """Rows of the chosen slices; with ``flip``, the size of their second axis, that axis is turned unless slices are along z."""
    found = voxels.filter(F.col(axis).isin(slice_indices(n, **chosen)))
    if flip is not None and axis != "z":
        second = [a for a in AXES if a != axis][1]
        found = flipped(found, second, flip)
    return found


def empty_volume(spark: SparkSession, size: tuple[int, int, int]) -> DataFrame:
    """The voxels of one volume of which only the size is known."""
    return places(spark, size).select(F.lit("all").alias("volume_id"), *AXES)
