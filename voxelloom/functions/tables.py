"""Table functions for SQL: regions of a lattice, and edges, by volume or histogram.

    register(spark)
    SELECT * FROM random_rois(TABLE(voxels) PARTITION BY (volume_id), 50, ARRAY(41, 41, 41), ARRAY(512, 512, 400), 1)
    SELECT * FROM dense_rois(TABLE(voxels) PARTITION BY (volume_id) ORDER BY (z, y, x), ARRAY(41, 41, 41), ARRAY(512, 512, 400))
    SELECT * FROM equalised_edges(TABLE(counts) PARTITION BY (hist_idx), 41)

Their rows are those of ``roi.random_rois``, ``roi.dense_rois`` and
``histogram.determine_edges``, which scale further: a table function sees a partition
row by row, in one task.  It keeps the n regions of least draw, one counter, or the
values' counts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from voxelloom.operators.histogram import MOST_VALUES, equalised_edges

#: The columns of a region; made without a session, as functions are analysed where there is none.
ROIS = T.StructType([T.StructField("volume_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("roi_id", "x0", "y0", "z0", "sx", "sy", "sz")]])


def _table(argument: AnalyzeArgument, columns: tuple[str, ...]) -> None:
    if not argument.isTable:
        raise ValueError("the first argument is a TABLE")
    missing = set(columns) - set(argument.dataType.names)
    if missing:
        raise ValueError(f"the table has no column {', '.join(sorted(missing))}")


def _number(argument: AnalyzeArgument, name: str, least: int) -> None:
    if argument.value is None or argument.value < least:
        raise ValueError(f"{name} is a constant of {least} or more")


def _three(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, T.ArrayType) or argument.value is not None and len(argument.value) != 3:
        raise ValueError(f"{name} is an array of three numbers")


def _box(row: Row, box: list[int], size: list[int]) -> list[int] | None:
    """Start and size of the box around a voxel of the mask, if it fits."""
    if not row["m"]:
        return None
    start = [row[a] - b // 2 for a, b in zip("xyz", box, strict=True)]
    return [*start, *box] if all(s >= 0 and s + b <= n for s, b, n in zip(start, box, size, strict=True)) else None


class RandomRois:
    """n boxes around voxels of the mask, drawn by hash, without putting back: those of least draw."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument, box: AnalyzeArgument, size: AnalyzeArgument, seed: AnalyzeArgument) -> AnalyzeResult:
        _table(rows, ("volume_id", "x", "y", "z", "m"))
        _number(n, "n", 0)
        _three(box, "box")
        _three(size, "size")
        return AnalyzeResult(ROIS)

    def __init__(self) -> None:
        self.least: list[tuple] = []
        self.volume: str | None = None

    def eval(self, row: Row, n: int, box: list[int], size: list[int], seed: int) -> None:
        found = _box(row, box, size)
        if found is None or n == 0:
            return
        self.volume = row["volume_id"]
        draw = int(hashlib.md5(f"{row['x']},{row['y']},{row['z']},{seed}".encode()).hexdigest(), 16)
        # The greatest of those kept comes first.
        item = (-draw, -row["z"], -row["y"], -row["x"], found)
        if len(self.least) < n:
            heapq.heappush(self.least, item)
        elif item > self.least[0]:
            heapq.heapreplace(self.least, item)

    def terminate(self) -> Iterator[tuple]:
        for i, item in enumerate(sorted(self.least, reverse=True)):
            yield (self.volume, i, *item[-1])


class DenseRois:
    """A box around every voxel of the mask that has room, numbered in the order in which voxels come."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, box: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        _table(rows, ("volume_id", "x", "y", "z", "m"))
        _three(box, "box")
        _three(size, "size")
        return AnalyzeResult(ROIS)

    def __init__(self) -> None:
        self.n = 0

    def eval(self, row: Row, box: list[int], size: list[int]) -> Iterator[tuple]:
        found = _box(row, box, size)
        if found is not None:
            yield (row["volume_id"], self.n, *found)
            self.n += 1


class EqualisedEdges:
    """Edges of a histogram's values (value) or counted values (value, n), with the column that the table is partitioned by."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n_bins: AnalyzeArgument) -> AnalyzeResult:
        _table(rows, ("hist_idx", "value"))
        _number(n_bins, "the number of bins", 1)
        kind = rows.dataType["hist_idx"].dataType
        return AnalyzeResult(T.StructType().add("hist_idx", kind).add("edge_idx", T.IntegerType()).add("edge", T.DoubleType()))

    def __init__(self) -> None:
        self.counts: dict[float, int] = {}
        self.of, self.n_bins = None, 0

    def eval(self, row: Row, n_bins: int) -> None:
        self.of, self.n_bins = row["hist_idx"], n_bins
        value = float(row["value"])
        self.counts[value] = self.counts.get(value, 0) + (row["n"] if "n" in row.__fields__ else 1)
        if len(self.counts) > MOST_VALUES:
            raise ValueError(f"more than {MOST_VALUES} different values of {self.of}: use histogram.determine_edges")

    def terminate(self) -> Iterator[tuple]:
        if self.counts:
            values = sorted(self.counts)
            for i, edge in enumerate(equalised_edges(values, [self.counts[v] for v in values], self.n_bins)):
                yield self.of, i, float(edge)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, kind in (("random_rois", RandomRois), ("dense_rois", DenseRois), ("equalised_edges", EqualisedEdges)):
        spark.udtf.register(name, F.udtf(kind))
