"""Lattices saved by brick: tables whose joins need no exchange.

A table is bucketed by volume and brick, so all voxels of a brick are in one bucket, and
sorted within it along a Z-order curve of bricks, so that near bricks are near in the
file too.  Images and masks saved with as many buckets are joined where they lie; boxes,
which are few, travel to the voxels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.lattice import AXES, KEYS
from voxelloom.operators.roi import BRICK, SIZES, STARTS

#: Bits of a brick's number along each axis.
BITS = 20


def z_order(numbers: list[Column], bits: int = BITS) -> Column:
    """Numbers of up to ``bits`` bits interleaved, those of the first lowest."""
    parts = [F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), len(numbers) * k + i) for i, c in enumerate(numbers) for k in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def brick_of(brick: int = BRICK) -> Column:
    """The Z-order number of a voxel's brick; places are from 0."""
    return z_order([F.expr(f"{a} div {brick}") for a in AXES])


def save_lattice(voxels: DataFrame, table: str, buckets: int, brick: int = BRICK) -> DataFrame:
    """Voxels as a table with the column ``brick``, in ``buckets`` buckets; rows that a task writes go to few of them.

    Tables that are to be joined need the same ``buckets`` and ``brick``.
    """
    spark = voxels.sparkSession
    placed = voxels.withColumn("brick", brick_of(brick))
    dealt = placed.repartition(buckets, "volume_id", "brick")
    dealt.write.format("parquet").bucketBy(buckets, "volume_id", "brick").sortBy("volume_id", "brick", "z", "y", "x").mode("overwrite").saveAsTable(table)
    return read_lattice(spark, table)


def read_lattice(spark: SparkSession, table: str) -> DataFrame:
    """A saved lattice; buckets count for joins on more columns than theirs too."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(table)


def joined(image: DataFrame, mask: DataFrame) -> DataFrame:
    """Two saved lattices voxel by voxel, bucket by bucket."""
    # Without the hint a small one would be broadcast instead.
    return image.join(mask.hint("merge"), [KEYS[0], "brick", *AXES])


def boxed(rois: DataFrame, voxels: DataFrame, brick: int = BRICK) -> DataFrame:
    """Voxels of a saved lattice in each box, with their places within it (dx, dy, dz); only boxes move.

    A box is asked for once for each brick that it touches; what of it is before 0 has none.
    """
    r = rois
    for a, s, n in zip(AXES, STARTS, SIZES, strict=True):
        r = r.filter(F.col(s) + F.col(n) > 0).withColumn(f"_b{a}", F.explode(F.sequence(F.expr(f"greatest({s}, 0) div {brick}"), F.expr(f"({s} + {n} - 1) div {brick}"))))
    asked = r.withColumn("brick", z_order([F.col(f"_b{a}") for a in AXES])).drop(*[f"_b{a}" for a in AXES])
    inside = reduce(lambda p, q: p & q, [(F.col(a) >= F.col(s)) & (F.col(a) < F.col(s) + F.col(n)) for a, s, n in zip(AXES, STARTS, SIZES, strict=True)])
    found = voxels.join(asked.hint("merge"), ["volume_id", "brick"]).filter(inside)
    return found.withColumns({f"d{a}": F.col(a) - F.col(s) for a, s in zip(AXES, STARTS, strict=True)}).drop("brick")
