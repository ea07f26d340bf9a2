"""Voxels by rank: which is the k-th of a volume's voxels in raster order, without sorting any.

Voxels become bitmaps of strips (STRIP lines of a slice), a bit each, in the tasks that
read them; bitmaps of a strip are united, and counts before each strip are sums over
strips.  A rank goes to its strip, and there to the place of the bit that has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.plans.saving import saved

#: Lines of a strip.
STRIP = 32
_BITS = "volume_id string, z long, strip long, width int, bits binary"
_BITS_ARROW = pa.schema([("volume_id", pa.string()), ("z", pa.int64()), ("strip", pa.int64()), ("width", pa.int32()), ("bits", pa.binary())])


def _packed(width: int, y: np.ndarray, x: np.ndarray) -> bytes:
    on = np.zeros((STRIP, width), bool)
    on[y % STRIP, x] = True
    return np.packbits(on, axis=1).tobytes()


def _unpacked(width: int, bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(STRIP, -1), axis=1)[:, :width].astype(bool)


def _marked(batches):
    """The bits of each batch's voxels, by strip."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        volumes = table.column("volume_id").combine_chunks().dictionary_encode()
        code = volumes.indices.to_numpy()
        x, y, z = (table.column(a).to_numpy() for a in "xyz")
        strips, at = np.unique(np.stack([code, z, y // STRIP], 1), axis=0, return_inverse=True)
        names, rows, width = volumes.dictionary.to_pylist(), [], int(x.max(initial=0)) + 1
        order = np.argsort(at, kind="stable")  # within a batch
        ends = np.searchsorted(at[order], np.arange(len(strips) + 1))
        for k, (v, slice_, strip) in enumerate(strips.tolist()):
            own = order[ends[k] : ends[k + 1]]
            rows.append((names[v], slice_, strip, width, _packed(width, y[own], x[own])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BITS_ARROW)], schema=_BITS_ARROW)


def _united(table: pa.Table) -> pa.Table:
    """One bitmap of a strip's parts, as wide as the widest."""
    widths = table.column("width").to_pylist()
    on = np.zeros((STRIP, max(widths)), bool)
    for width, bits in zip(widths, table.column("bits").to_pylist(), strict=True):
        on[:, :width] |= _unpacked(width, bits)
    first = [table.column(c)[0].as_py() for c in ("volume_id", "z", "strip")]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*first, max(widths), np.packbits(on, axis=1).tobytes()], _BITS_ARROW, strict=True)], schema=_BITS_ARROW)


def strips_of(voxels: DataFrame) -> DataFrame:
    """(volume_id, z, strip, width, bits, n, start) of the strips that have voxels; start is how many come before in raster order."""
    marked = voxels.select(F.col("volume_id").cast("string").alias("volume_id"), *[F.col(a).cast("long").alias(a) for a in "xyz"]).mapInArrow(_marked, _BITS)
    strips = marked.groupBy("volume_id", "z", "strip").applyInArrow(_united, _BITS)
    counted = saved(strips.withColumn("n", _ones("bits")))
    # As many rows a volume as strips.
    before = Window.partitionBy("volume_id").orderBy("z", "strip").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _ones(bits: str):
    """How many bits are set."""
    by_digit = {4: "F", 3: "7BDE", 2: "3569AC", 1: "1248"}
    return sum((F.length(F.regexp_replace(F.hex(bits), f"[^{d}]", "")) * k for k, d in by_digit.items()), F.lit(0)).cast("long")


def _selected(batches):
    """The places of the asked ranks in each strip."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for volume, z, strip, width, bits, asked in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "z", "strip", "width", "bits", "asked")), strict=True):
            at = np.flatnonzero(_unpacked(width, bits))
            for item in asked:
                place = int(at[item["within"]])
                for column, v in zip(out, (volume, item["item"], place % width, strip * STRIP + place // width, z), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:]]], names=["volume_id", "item", "x", "y", "z"])


def at_ranks(strips: DataFrame, asked: DataFrame) -> DataFrame:
    """(volume_id, item, x, y, z) of asked ranks (volume_id, item, rank from 0); a rank may be asked for more than once."""
    # Ranks find their strips by order: a strip comes before the ranks it has.
    begins = strips.select("volume_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("z", "strip", "start").alias("found"), F.lit(None).cast("long").alias("item"))
    wanted = asked.select(F.col("volume_id").cast("string").alias("volume_id"), F.col("rank").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<z: long, strip: long, start: long>").alias("found"), "item")
    last = F.last("found", ignorenulls=True).over(Window.partitionBy("volume_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    met = begins.unionByName(wanted).withColumn("strip_of", last).filter("kind = 1")
    by_strip = met.groupBy("volume_id", F.col("strip_of.z").alias("z"), F.col("strip_of.strip").alias("strip")).agg(F.collect_list(F.struct("item", (F.col("at") - F.col("strip_of.start")).alias("within"))).alias("asked"))
    return by_strip.join(strips.drop("n", "start"), ["volume_id", "z", "strip"]).mapInArrow(_selected, "volume_id string, item long, x long, y long, z long")
