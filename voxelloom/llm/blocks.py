"""Documents dealt into blocks by a hash of id and text, and what blocks tell hash buckets.

A block is a group of whole documents, about ``1 / (2 * shuffle partitions)`` of
the input.  What all copies within a block have in common is told once, so that
a passage in a third of all documents costs a hash bucket one entry per block,
not one per document.  Everything is a lazy plan of shuffles: a lost executor
costs the recomputation of its own partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import textcore as tc

#: Stands for a null id in comparisons: after all others but itself.
NO_ID = (1 << 63) - 1
LETTER = "bucket int, block int, hashes binary, more binary"
LETTER_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(spark: SparkSession) -> int:
    return 2 * partitions(spark)


def bucket_count(spark: SparkSession) -> int:
    """Hash buckets, half as many as blocks: a block sends each of them a letter, so their number times that of blocks counts."""
    return partitions(spark)


def in_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, nameless, text, block); one shuffle of the texts, which all uses in one plan share."""
    spark = docs.sparkSession
    return docs.select(known_id(F.col(f"`{doc_id}`")).alias("doc_id"), F.col(f"`{doc_id}`").cast("long").isNull().alias("nameless"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("block", block_number(spark)).repartition(partitions(spark), "block")


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def block_number(spark: SparkSession) -> Column:
    """By id and text, so that neither rows without an id nor copies of a text meet in one block."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(block_count(spark))).cast("int")


def shown_ids(table: pa.Table) -> pa.Array:
    """Ids of a block's rows, null where there was none."""
    return pa.array(table.column("doc_id").to_numpy(), pa.int64(), mask=table.column("nameless").to_numpy(zero_copy_only=False))


def block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def letters(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, LETTER_ARROW, strict=True)], schema=LETTER_ARROW)


def received(table: pa.Table):
    """(block, hashes, more) of each letter."""
    for block, hashes, more in zip(*(table.column(c).to_pylist() for c in ("block", "hashes", "more")), strict=True):
        yield block, tc.unpack(hashes), more


def tell_buckets(block: int, hashes: np.ndarray, doc_ids: np.ndarray, n: int) -> list[tuple[int, int, bytes, bytes]]:
    """Each distinct hash of the block once, whether documents of different ids have it, and how often it comes."""
    order, first = tc.by_runs(hashes)
    if not len(first):
        return []
    dealt, hashes = doc_ids[order], hashes[order[first]]
    several = (np.minimum.reduceat(dealt, first) != np.maximum.reduceat(dealt, first)).astype(np.uint8)
    count = np.diff(np.append(first, len(order))).astype(np.uint32)
    return [(b, block, tc.pack(hashes[s]), several[s].tobytes() + tc.transposed(count[s])) for b, s in tc.by_bucket(hashes, n)]


def shared_hashes(most: int | None = None):
    """Of a bucket: back to each block, those of its hashes that documents of two or more ids have, and whether they come over ``most`` times."""

    def run(table: pa.Table) -> pa.Table:
        got = list(received(table))
        bucket = table.column("bucket")[0].as_py()
        every = np.concatenate([h for _, h, _ in got])
        several = np.concatenate([np.frombuffer(m[: len(h)], np.uint8) for _, h, m in got]).astype(bool)
        count = np.concatenate([tc.restored(m[len(h) :], np.uint32) for _, h, m in got]).astype(np.int64)
        order = np.argsort(every)
        first = tc.runs(every[order])
        size = np.diff(np.append(first, len(every)))
        on = (size > 1) | np.logical_or.reduceat(several[order], first)
        shared, hot = every[order][first][on], (np.add.reduceat(count[order], first)[on] > (most or 1 << 62)).astype(np.uint8)
        out = []
        for block, hashes, _ in got:
            at, there = tc.find(shared, hashes)
            if there.any():
                out.append((bucket, block, tc.pack(hashes[there]), hot[at[there]].tobytes() if most else b""))
        return letters(out)

    return run


def all_received(table: pa.Table | None) -> np.ndarray:
    """The sorted hashes of all letters to a block."""
    parts = [h for _, h, _ in received(table)] if table is not None and table.num_rows else []
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, tc.U64)
