"""Volumes that arrive as Parquet rows over time: histograms of each arrived batch, added to a running table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelloom.functions.pointwise import bin_index


def arriving_voxels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_histogram(voxels: DataFrame, edges: list[float], value: str = "v") -> DataFrame:
    """(volume_id, bin, n) over all rows so far; its state is one count a volume and bin."""
    return voxels.groupBy("volume_id", bin_index(F.col(value), edges).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ingest(voxels: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append arriving voxels to a table by volume, each batch once."""

    def write(batch: DataFrame, epoch: int) -> None:
        # A repeated batch replaces itself.
        batch.withColumn("epoch", F.lit(epoch)).write.partitionBy("epoch", "volume_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    return voxels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
