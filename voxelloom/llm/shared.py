"""Tables cut off from their lineage in the shared folder, and joins that spread large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.plans.saving import saved, shared_folder

__all__ = ["checkpointed", "join_groups", "saved"]


def checkpointed(df: DataFrame) -> DataFrame:
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, item: str, with_spread: bool = False, apart: Column | None = None) -> DataFrame:
    """Rows with the columns of their group, by ``key``, which every row finds; ``size`` is a group's number of rows.

    Groups of more than a thousandth of all ``total`` rows, of which there are
    fewer than a thousand, are broadcast.  Rows that find theirs so are spread by
    ``item``, a column that tells them apart, over the sort-merge join of the rest.
    Rows without an item go one way, but where ``apart`` (of the group's columns, as
    hot_..) says that they needn't meet: these are spread at random.  ``with_spread`` keeps
    the column ``spread``: rows are dealt by ``key`` and it.
    """
    most = max(total // 1000, 1)
    names = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.filter(F.col(size) > most).select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in names]))
    # Not a literal: the optimizer would take it out of the join's keys, and all rows of a key would meet again.
    nowhere = F.when(F.col(size) >= 0, F.lit(-1).cast("long")).alias("spread")
    rest = groups.filter(F.col(size) <= most).select(F.col(key), nowhere, *[F.col(c).alias(f"rest_{c}") for c in names])
    dealt = F.pmod(F.xxhash64(item), F.lit(1 << 20))
    if apart is not None:
        dealt = F.when(F.col(item).isNull() & apart, F.floor(F.rand(1) * (1 << 20)).cast("long")).otherwise(dealt)
    found = rows.join(hot, rows[key] == F.col("hot_key"), "left").withColumn("spread", F.when(F.col("hot_key").isNotNull(), dealt).otherwise(F.lit(-1).cast("long")))
    return found.join(rest.hint("merge"), [key, "spread"], "left").select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"hot_{c}", f"rest_{c}").alias(c) for c in names], *[F.col("spread")] * with_spread)
