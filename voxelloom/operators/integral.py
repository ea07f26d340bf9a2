"""Summed volumes: sums over boxes of any size from the eight corners of each.

A summed volume has at every place the sum of all before it along all three axes: three
window passes, one along each axis.  A box then asks for eight places whatever its size,
where a join of boxes with voxels copies a voxel for each box that it is in.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.lattice import AXES, KEYS

STARTS, SIZES = ("x0", "y0", "z0"), ("sx", "sy", "sz")


def summed_volumes(voxels: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(volume_id, x, y, z, columns): each column's sum over all voxels whose x, y and z are no larger."""
    rows = voxels.select(*KEYS, *[c.alias(n) for n, c in columns.items()])
    for a in AXES:
        w = Window.partitionBy("volume_id", *[b for b in AXES if b != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({n: F.sum(n).over(w) for n in columns})
    return rows


def box_sums_of(rois: DataFrame, voxels: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Boxes (volume_id, roi_id, ..) with each column's sum over the voxels in them, 0 where there is none.

    The lattice is dense and starts at 0.  What of a box is outside of it counts for
    nothing.  Sums of whole numbers are exact; of others they are differences of large
    sums.
    """
    ends = voxels.groupBy("volume_id").agg(*[F.max(a).alias(f"_end_{a}") for a in AXES])
    # One row a volume, joined as its size asks.
    boxes = rois.join(ends, "volume_id")
    for a, s, n in zip(AXES, STARTS, SIZES, strict=True):
        boxes = boxes.withColumns({f"_low_{a}": F.greatest(F.col(s), F.lit(0)) - 1, f"_high_{a}": F.least(F.col(s) + F.col(n) - 1, F.col(f"_end_{a}"))})
    there = reduce(lambda p, q: p & q, [F.col(f"_high_{a}") > F.col(f"_low_{a}") for a in AXES])
    corners = [F.struct(*[F.col(f"_{end}_{a}").alias(a) for a, end in zip(AXES, ends_, strict=True)], F.lit((-1) ** ends_.count("low")).alias("sign")) for ends_ in product(("low", "high"), repeat=3)]
    asked = boxes.filter(there).select("volume_id", "roi_id", F.explode(F.array(*corners)).alias("c")).select("volume_id", "roi_id", *[F.col(f"c.{a}").cast("long").alias(a) for a in AXES], F.col("c.sign").alias("sign"))
    asked = asked.filter(reduce(lambda p, q: p & q, [F.col(a) >= 0 for a in AXES]))  # before the first place sums are 0
    found = asked.join(summed_volumes(voxels, columns), list(KEYS)).groupBy("volume_id", "roi_id").agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in columns])
    return rois.join(found, ["volume_id", "roi_id"], "left").select(*rois.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in columns])


def worth_summing(rois: DataFrame, voxels: DataFrame) -> bool:
    """Whether boxes have more voxels in all than the lattice has, so that a join would copy more rows than the sums pass; the lattice must be dense."""
    boxes = rois.agg(F.sum(F.col("sx") * F.col("sy") * F.col("sz"))).first()[0] or 0
    places = reduce(lambda p, q: p * q, [F.max(a) + 1 for a in AXES])
    volumes = voxels.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == places).alias("dense"), *[F.min(a).alias(f"_{a}") for a in AXES])
    whole = volumes.agg(F.sum("n").alias("n"), F.bool_and(F.col("dense") & (F.col("_x") == 0) & (F.col("_y") == 0) & (F.col("_z") == 0)).alias("dense")).first()
    return bool(whole.dense) and boxes > whole.n
