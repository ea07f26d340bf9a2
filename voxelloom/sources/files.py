"""Data sources of volume files: ``volumes`` reads slabs of them, ``files`` writes whole files.

    spark.dataSource.register(VolumeSource)
    spark.read.format("volumes").option("zFrom", 10).option("zTo", 19).load(folder)
    spark.dataSource.register(FileSink)
    volumes.nifti_files(voxels).select(name, "content").write.format("files").mode("append").save(folder)

Both open files in Python, in any file system that Arrow knows by its URI; the readers
of ``volumes.py`` take files over Spark's own file systems instead.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxelloom.sources import volumes

#: Bytes of pixels that one task reads, about.
SLAB_BYTES = 64 << 20
#: Bytes in which a file's head is looked for.
HEAD_BYTES = 64 << 10
_FOREVER = 1 << 62


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class Slabs(InputPartition):
    """Files, and of each the slices from and to (not with it)."""

    parts: list[tuple[str, int, int]]

    def __post_init__(self) -> None:
        self.value = len(self.parts)


class VolumeReader(DataSourceReader):
    """Voxels of all volume files below a path; slices ``low`` to ``high`` (not with it) only.

    Files with plain pixels are read slab by slab: of those in SLAB_BYTES or more each
    slab is a partition, and slices outside of the conditions aren't read at all.
    Compressed files are read whole.
    """

    def __init__(self, path: str, glob: str = "*", slab_bytes: int = SLAB_BYTES, low: int = 0, high: int = _FOREVER):
        self.path, self.glob, self.slab_bytes = path, glob, slab_bytes
        self.low, self.high, self.volume = low, high, None
        self.bytes_read = 0

    def _files(self) -> list[tuple[str, int]]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == arrow_fs.FileType.File:
            return [(path, info.size)]
        found = [f for f in system.get_file_info(arrow_fs.FileSelector(path, recursive=True)) if f.type == arrow_fs.FileType.File]
        shown = [f for f in found if not any(p[:1] in "._" for p in f.path[len(path) :].strip("/").split("/"))]
        return sorted((f.path, f.size) for f in shown if fnmatch.fnmatch(f.base_name, self.glob))

    def partitions(self) -> list[Slabs]:
        """Small files together, slabs of large ones alone; only heads of large files are read here."""
        out, held, size = [], [], 0
        for path, n in self._files():
            if self.volume is not None and path != self.volume:
                continue
            step = None
            if n > self.slab_bytes:
                head = volumes.plain_head(self._bytes(path, 0, HEAD_BYTES))
                if head is not None:
                    step = max(1, self.slab_bytes // (head.size[0] * head.size[1] * np.dtype(head.kind).itemsize))
                    out += [Slabs([(path, max(z, self.low), min(z + step, self.high))]) for z in range(0, head.size[2], step) if z < self.high and z + step > self.low]
                    continue
            held.append((path, self.low, self.high))
            size += n
            if size > self.slab_bytes:
                out.append(Slabs(held))
                held, size = [], 0
        return out + [Slabs(held)] * bool(held) or [Slabs([])]

    def _bytes(self, path: str, offset: int, n: int | None) -> bytes:
        system, _ = file_system(self.path)
        with system.open_input_file(path) as f:
            f.seek(offset)
            data = f.read(n) if n is not None else f.read()
        self.bytes_read += len(data)
        return data

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        for path, low, high in partition.parts:
            try:
                yield from self._slab(path, low, high)
            except (ValueError, KeyError, struct.error, zlib.error, EOFError) as e:
                raise ValueError(f"{path}: {e}") from e

    def _slab(self, path: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
        head = volumes.plain_head(self._bytes(path, 0, HEAD_BYTES))
        if head is None:
            _, values = volumes.parse_image(self._bytes(path, 0, None))
            low, high = max(low, 0), min(high, len(values))
            if low < high:
                yield from volumes.voxel_batches(path, values[low:high], low)
            return
        nx, ny, nz = head.size
        low, high = max(low, 0), min(high, nz)
        slice_bytes = nx * ny * np.dtype(head.kind).itemsize
        step = max(1, self.slab_bytes // max(slice_bytes, 1))
        for z in range(low, high, step):
            n = min(step, high - z)
            data = self._bytes(path, head.offset + z * slice_bytes, n * slice_bytes)
            if len(data) < n * slice_bytes:
                raise ValueError("the pixels end early")
            yield from volumes.voxel_batches(path, head.scaled(np.frombuffer(data, head.kind)).reshape(n, ny, nx), z)


class PushedReader(VolumeReader):
    """Takes conditions on z and volume_id.

    Spark keeps what one use of a relation has pushed for its later uses, so a relation
    with this reader is for one condition.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("volume_id",) and self.volume is None:
                self.volume = f.value
                continue
            if getattr(f, "attribute", None) != ("z",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value + 1)
            else:
                if isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value) + 1)
                yield f


class VolumeSource(DataSource):
    """``volumes``: (volume_id, x, y, z, v) of the files below a path; options ``glob``, ``slabBytes``, ``zFrom``, ``zTo`` (the last slice) and ``push``."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return volumes.VOXELS

    def reader(self, schema) -> VolumeReader:
        o = self.options
        kind = PushedReader if o.get("push", "false").lower() == "true" else VolumeReader
        return kind(o["path"], o.get("glob", "*"), int(o.get("slabBytes", SLAB_BYTES)), int(o.get("zFrom", 0)), int(o.get("zTo", _FOREVER)) + 1)


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task's files, and their names."""

    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    """Rows (name, content) as files below a path: each task stages its own, and a commit moves all of them to their places.

    A task that fails, or whose attempt another one replaces, leaves nothing: what isn't
    committed goes with the staging folder.  Two rows of one name are an error, and so is a
    name that leaves the folder; then there is no file at all.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staged-{uuid.uuid4().hex}"
        system, top = file_system(path)
        # Tasks make no folder above their own: one that goes on after the end finds none and fails.
        system.create_dir(f"{top}/{self.staging}", recursive=True)

    def write(self, rows: Iterator) -> Staged:
        system, top = file_system(self.path)
        folder, names = f"{top}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=False)
        for row in rows:
            name = posixpath.normpath(row["name"])
            if name.startswith(("/", "..", "_staged-")) or name == ".":
                raise ValueError(f"no name of a file: {row['name']}")
            with system.open_output_stream(f"{folder}/{len(names)}", compression=None) as f:
                f.write(bytes(row["content"]))
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, top = file_system(self.path)
        staged = [m for m in messages if m is not None]
        names = [n for m in staged for n in m.names]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            self.abort(messages)
            raise ValueError(f"several files of one name: {', '.join(twice[:5])}")
        if self.overwrite:
            for old in system.get_file_info(arrow_fs.FileSelector(top, allow_not_found=True)):
                if old.base_name != self.staging:
                    (system.delete_dir if old.type == arrow_fs.FileType.Directory else system.delete_file)(old.path)
        for m in staged:
            for k, name in enumerate(m.names):
                system.create_dir(posixpath.dirname(f"{top}/{name}"), recursive=True)
                system.move(f"{m.folder}/{k}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, top = file_system(self.path)
        if system.get_file_info(f"{top}/{self.staging}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.staging}")


class FileSink(DataSource):
    """``files``: writes rows (name, content) as files below a path; ``overwrite`` replaces all that is there."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def read_slabs(spark: SparkSession, path: str, glob: str = "*", slab_bytes: int = SLAB_BYTES, z: tuple[int, int] | None = None, push: bool = False) -> DataFrame:
    """Voxels of the volume files below a path, perhaps of the slices from and to (with it) only.

    With ``push`` a filter on z or volume_id reaches the files too, and the result is for
    use under one such filter.
    """
    spark.dataSource.register(VolumeSource)
    reader = spark.read.format("volumes").option("glob", glob).option("slabBytes", slab_bytes).option("push", str(push).lower())
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if z is not None:
        reader = reader.option("zFrom", z[0]).option("zTo", z[1])
    return reader.load(path)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Files (name, content) below a path, all or none."""
    files.sparkSession.dataSource.register(FileSink)
    files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("files").mode("overwrite" if overwrite else "append").save(path)


def text_files(lines: DataFrame, name: Column, order: str = "roi_id") -> DataFrame:
    """(name, content) of a text file for each volume: its lines in order, each ended by a line feed.

    These are files that people and other tools read: regions, labels, samples and bags of
    a volume; each is gathered whole.
    """
    joined = lines.groupBy("volume_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda r: F.concat(r["line"], F.lit("\n"))), "").alias("content"))
    return joined.select(name.alias("name"), F.col("content").cast("binary").alias("content"))
