"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  New data is grouped by digest,
parted from the index by a sort-merge anti-join on the bucketed key (the index side is
not shuffled), and what is new is appended under the name of its batch.  Which row of
a text stays is then read from the index, so a batch that is run again after a failure
finds its own entries and gets the same result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.llm.shared import join_groups, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


class DigestIndex:
    """Digests of all texts taken so far: (digest binary, keep_id long, batch string), one row each.

    ``name`` is a table of the session's catalog, kept in its warehouse; it is made,
    empty, bucketed and sorted by digest, where there is none of that name.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Those of (digest, keep_id) whose digest isn't in the index."""
        return digests.join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add distinct digests that the index doesn't have; each bucket is written by one task, sorted."""
        rows = digests.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def with_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, digest), and with ``whole`` the input row as a struct ``row``."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)).alias("digest"), *[F.struct(docs["*"]).alias("row")] * whole)


def _taken(rows: DataFrame, index: DigestIndex, batch: str | None) -> tuple[DataFrame, int]:
    """Groups of the batch, with first_id from the index, and whether they are new; rows of the batch."""
    batch = batch or uuid.uuid4().hex
    groups = saved(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    index.append(index.unseen(groups), batch)
    known = index.table().select("digest", F.col("keep_id").alias("first_id"), (F.col("batch") == batch).alias("fresh"))
    found = saved(groups.join(known.hint("merge"), "digest"))
    return found, found.agg(F.sum("group_size")).first()[0] or 0


def _placed(rows: DataFrame, index: DigestIndex, batch: str | None) -> DataFrame:
    """Rows with their group, and whether they are kept: of rows that repeat the doc_id and text to keep, one."""
    groups, total = _taken(rows.select("doc_id", "digest"), index, batch)
    # Rows without an id meet only where all of a group have none, as one of them is kept then.
    found = join_groups(rows, groups, "digest", "group_size", total, "doc_id", with_spread=True, apart=F.col("hot_keep_id").isNotNull())
    again = Window.partitionBy("digest", "spread", "doc_id").orderBy(F.lit(0))
    first = F.row_number().over(again) == 1
    return found.withColumn("kept", F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & first)


def kept_rows(docs: DataFrame, index: DigestIndex, batch: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that ``deduplicate`` keeps."""
    return _placed(with_digest(docs, doc_id, text, whole=True), index, batch).filter("kept").select("row.*")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deduplicate a batch against the index and itself, and append what is new.

    Texts are equal when identical after lower-casing A-Z only; null text is
    empty.  Of equal texts in the batch the row with the largest doc_id stays,
    unless an earlier batch has the text: then none does, and keep_id is that of
    the index.  One row per input row: doc_id, keep_id, group_size (rows of the
    batch with this text), kept, text_sha256.

    A null doc_id counts as the smallest; of rows that repeat one doc_id and text, one
    is kept.  Very long texts cost one digest each.  Other columns are ignored.  An
    empty table gives no rows and leaves the index as it was.

    The index is changed by the call, the rows come when they are asked for.  A batch
    that failed is run again under the same name ``batch``: what it has appended counts
    as its own.  Without a name a batch gets a new one.

    Groups are summed before the shuffle.  Rows of the largest groups find theirs
    in a broadcast table of under a thousand rows, all others by a sort-merge join.
    """
    return _placed(with_digest(docs, doc_id, text), index, batch).select("doc_id", F.col("first_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@contextmanager
def passing_index(spark: SparkSession):
    """An index for one batch, which goes once the batch is in: results don't need the table any more."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        yield index
    finally:
        index.drop()


def op4_exact_dedup(docs: DataFrame) -> DataFrame:
    """The whole table as the first batch of an index of its own."""
    with passing_index(docs.sparkSession) as index:
        return deduplicate(docs, index)


OP4_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.text_sha256 = g.text_sha256
"""
