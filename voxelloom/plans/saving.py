"""Tables cut off from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of the session's warehouse where that is unset; both are shared by all executors."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


#: Tables of this process, in the order they were written.
_written: list[str] = []


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """Written below the shared folder and read again; ``by`` puts rows into folders by a column, so that a filter on it reads only these."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables are there."""
    return len(_written)


def drop_saved(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete the tables written after the first ``since``, perhaps but the last; results that were made from them must be written by then."""
    gone = _written[since : len(_written) - but_last]
    del _written[since : len(_written) - but_last]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
