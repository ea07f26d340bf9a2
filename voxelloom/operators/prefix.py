"""Prefix sums over a whole table in order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.plans.saving import saved


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with the sums of all rows before them in ``order``.

    Rows are dealt by ranges and kept, so that ranges stay as they are; sums are taken
    within a range and over the ranges' totals, of which there are as many as shuffle
    partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_value_{k}": c for k, c in sums.items()})
    dealt = saved(valued.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_value_{k}").alias(f"_total_{k}") for k in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_inside_{k}": F.coalesce(F.sum(f"_value_{k}").over(within), F.lit(0)) for k in sums}).join(F.broadcast(starts), "_range")
    return out.select(*rows.columns, *[(F.col(f"_start_{k}") + F.col(f"_inside_{k}")).alias(k) for k in sums])
