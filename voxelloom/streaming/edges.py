"""Equalised edges over values that arrive over time.

What a stream keeps of all values so far is how often each came: runs of equal values,
dealt by a hash of the value, so that no task holds a whole histogram.  A batch changes
the runs of its own values only, and only these are told on.  Edges of everything that
has come are folded from the latest count of each value, as those of a table are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voxelloom.operators.histogram import edges_of_counts

#: Parts of each histogram's runs.
PARTS = 64
#: A store of states that a state of its own kind for each value needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RUNS = "hist_idx int, value double, n long"


class Runs(StatefulProcessor):
    """By histogram and part: how often each value has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "value double", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[float, int] = {}
        for frame in rows:
            for value, n in frame.groupby("value", dropna=False)["n"].sum().items():
                new[value] = new.get(value, 0) + int(n)
        for value, n in new.items():
            known = self.counts.getValue((value,)) if self.counts.containsKey((value,)) else None
            new[value] = n + (known[0] if known else 0)
            self.counts.updateValue((value,), (new[value],))
        yield pd.DataFrame({"hist_idx": key[0], "value": list(new), "n": list(new.values())})

    def close(self) -> None:
        pass


def changed_runs(values: DataFrame, parts: int = PARTS) -> DataFrame:
    """(hist_idx, value, n) of a stream of (hist_idx, value): of each value that a batch has, how often it has come in all."""
    part = F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")
    kept = values.filter("value IS NOT NULL").select(F.col("hist_idx").cast("int").alias("hist_idx"), (F.col("value").cast("double") + F.lit(0.0)).alias("value"), F.lit(1).cast("long").alias("n")).withColumn("part", part)
    return kept.groupBy("hist_idx", "part").transformWithStateInPandas(statefulProcessor=Runs(), outputStructType=_RUNS, outputMode="Update", timeMode="None")


def keep_runs(values: DataFrame, target: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Tell on the runs that each batch changes, to a table with a folder for each batch; a batch that is repeated replaces its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    conf, name = values.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STORE)  # a query takes it as it is when it starts
    try:
        return changed_runs(values, parts).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def latest_runs(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    """(hist_idx, value, n) after all batches, or after those up to one; a count only grows, so the largest is the latest."""
    told = spark.read.parquet(target)
    told = told if upto is None else told.filter(F.col("epoch") <= upto)
    return told.groupBy("hist_idx", "value").agg(F.max("n").alias("n"))


def edges_so_far(spark: SparkSession, target: str, n_bins: int, upto: int | None = None, on_overflow: str = "error") -> DataFrame:
    """(hist_idx, edge_idx, edge) that equalise the histograms of all values that have come."""
    return edges_of_counts(latest_runs(spark, target, upto), n_bins, on_overflow=on_overflow)
