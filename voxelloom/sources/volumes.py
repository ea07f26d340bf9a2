"""Readers and writers of volume files, over any file system that Spark reads.

Files come as (path, content) from the binary source and are parsed in tasks, a
file at a time; voxels leave in batches.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.functions.strings import volume_name
from voxelloom.sources.pixels import jpeg_bytes, jpeg_values, rle_bytes, rle_values

VOXELS = "volume_id string, x long, y long, z long, v double"
GEOMETRY = "volume_id string, dim int, size array<long>, origin array<double>, spacing array<double>"
#: Voxels in one batch.
BATCH = 1 << 18

Volume = tuple[dict, np.ndarray]
"""Header (size, origin, spacing) and values, indexed [z, y, x]."""


def _files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def _read(parse: Callable[[bytes], Volume], with_values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    header, values = parse(content)
                except (ValueError, struct.error, zlib.error, EOFError, OSError) as e:
                    raise ValueError(f"{path}: {e}") from e
                if not with_values:
                    yield pa.RecordBatch.from_pylist([{"volume_id": path, "dim": len(header["size"]), **{k: header[k] for k in ("size", "origin", "spacing")}}], schema=pa.schema([("volume_id", pa.string()), ("dim", pa.int32()), ("size", pa.list_(pa.int64())), ("origin", pa.list_(pa.float64())), ("spacing", pa.list_(pa.float64()))]))
                    continue
                yield from voxel_batches(path, values)

    return run


def voxel_batches(volume_id: str, values: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Voxels of values indexed [z, y, x], of which the first slice has number ``first``."""
    nz, ny, nx = values.shape
    flat = values.ravel()
    for lo in range(0, len(flat), BATCH):
        at = np.arange(lo, min(lo + BATCH, len(flat)))
        cols = [pa.array([volume_id] * len(at), pa.string()), *[pa.array(c, pa.int64()) for c in (at % nx, at // nx % ny, at // (nx * ny) + first)], pa.array(flat[at].astype(float))]
        yield pa.RecordBatch.from_arrays(cols, names=["volume_id", "x", "y", "z", "v"])


def parsed(files: DataFrame, parse: Callable[[bytes], Volume]) -> DataFrame:
    """Voxels of files (path, content)."""
    return files.select("path", "content").mapInArrow(_read(parse, True), VOXELS)


def _voxels(spark: SparkSession, path, parse, glob=None) -> DataFrame:
    return parsed(_files(spark, path, glob), parse)


def _geometry(spark: SparkSession, path, parse, glob=None) -> DataFrame:
    return _files(spark, path, glob).mapInArrow(_read(parse, False), GEOMETRY)


# HR2: magic, then fields (name, length, content), the last with the deflated pixels.


def inflated(data: bytes, chunk: int = 16_384) -> bytes:
    """A deflated stream, piece by piece."""
    stream, out = zlib.decompressobj(), bytearray()
    for lo in range(0, len(data), chunk):
        out += stream.decompress(data[lo : lo + chunk])
        if stream.eof:
            break
    out += stream.flush()
    if not stream.eof:
        raise ValueError("the compressed pixels end early")
    return bytes(out)


def parse_hr2(data: bytes) -> Volume:
    """Magic ``HR2``; numbers in fields are ASCII; pixels are float (little endian) or signed char, x fastest."""
    if data[:3] != b"HR2":
        raise ValueError("no HR2 file")
    fields, at = {}, 3
    while at < len(data):
        n = data[at]
        name, at = data[at + 1 : at + 1 + n].decode("ascii"), at + 1 + n
        end = data.index(0, at, at + 5)
        length, at = int.from_bytes(data[at:end], "little"), end + 1
        content = data[at : at + length] if name != "ImageData" or length else data[at:]
        at += len(content)
        fields[name] = content
        if name == "ImageData":
            break
    for name in ("PixelType", "Dimension", "Size", "Origin", "Spacing", "Compression", "ImageData"):
        if name not in fields:
            raise ValueError(f"field {name} is missing")
    text = {k: v.decode("ascii").strip("\0 ") for k, v in fields.items() if k != "ImageData"}
    kinds = {"float": np.dtype("<f4"), "char": np.dtype("i1")}
    if text["PixelType"] not in kinds or text["Compression"] != "ZLib":
        raise ValueError(f"pixel type {text['PixelType']} or compression {text['Compression']} isn't known")
    dim = int(text["Dimension"])
    size, origin, spacing = [int(x) for x in text["Size"].split()], *[[float(x) for x in text[k].split()] for k in ("Origin", "Spacing")]
    if not len(size) == len(origin) == len(spacing) == dim:
        raise ValueError("size, origin and spacing don't have as many numbers as dimensions")
    if dim != 3:
        raise ValueError("only three dimensions are read")
    values = np.frombuffer(inflated(fields["ImageData"]), kinds[text["PixelType"]])
    if len(values) != np.prod(size):
        raise ValueError(f"{len(values)} values for a size of {size}")
    return {"size": size, "origin": origin, "spacing": spacing}, values.reshape(size[::-1])


def hr2_bytes(values: np.ndarray, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), kind: str = "float") -> bytes:
    """A file of values indexed [z, y, x]."""
    numbers = lambda xs: " ".join(f"{x:g}" for x in xs).encode()
    pixels = zlib.compress(np.ascontiguousarray(values).astype("<f4" if kind == "float" else "i1").tobytes())
    fields = [("PixelType", kind.encode()), ("Dimension", b"3"), ("Size", numbers(values.shape[::-1])), ("Origin", numbers(origin)), ("Spacing", numbers(spacing)), ("Compression", b"ZLib"), ("ImageData", pixels)]
    out = b"HR2"
    for name, content in fields:
        size = len(content).to_bytes(4, "little").rstrip(b"\0")
        # A length with a zero byte in it can't be written; the pixels may say 0, for the rest of the file.
        size = b"" if b"\0" in size else size
        out += bytes([len(name)]) + name.encode() + size + b"\0" + content
    return out


def read_hr2(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _voxels(spark, path, parse_hr2)


def hr2_geometry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _geometry(spark, path, parse_hr2)


# Octave text: header lines, a line of sizes, values one a line.


def parse_octave(data: bytes, order: str = "row") -> Volume:
    """``order='row'`` takes the second index as the fastest, then the first; ``'column'`` the first, then the second."""
    lines = data.decode().splitlines()
    if len(lines) < 5 or not lines[0].startswith("#"):
        raise ValueError("no Octave text file")
    header = {}
    for line in lines[1:4]:
        key, _, value = line.lstrip("# ").partition(":")
        header[key.strip()] = value.strip()
    if {"name", "type", "ndims"} - set(header):
        raise ValueError("name, type or ndims is missing")
    size = [int(x) for x in lines[4].split()]
    if len(size) != int(header["ndims"]) or len(size) != 3:
        raise ValueError("three sizes are needed, as many as ndims")
    values = np.array(" ".join(lines[5:]).split(), float)
    nx, ny, nz = size
    if len(values) < nx * ny * nz:
        raise ValueError(f"{len(values)} values for a size of {size}")
    values = values[: nx * ny * nz]
    out = values.reshape(nz, nx, ny).transpose(0, 2, 1) if order == "row" else values.reshape(nz, ny, nx)
    return {"size": size, "origin": [0.0] * 3, "spacing": [1.0] * 3}, np.ascontiguousarray(out)


def read_octave(spark: SparkSession, path: str | list[str], order: str = "row") -> DataFrame:
    return _voxels(spark, path, lambda data: parse_octave(data, order))


# NIfTI-1, plain or gzipped.

_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


class Head(NamedTuple):
    """What a file's first bytes say: ``plain`` pixels are bytes from ``offset`` on, x fastest, then y."""

    size: list[int]
    origin: list[float]
    spacing: list[float]
    kind: str
    offset: int
    plain: bool = True
    slope: float = 1.0
    intercept: float = 0.0

    def scaled(self, values: np.ndarray) -> np.ndarray:
        return values * self.slope + self.intercept if self.slope != 1.0 or self.intercept else values


def nifti_head(data: bytes) -> Head:
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(f"{order}i", data)[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("no NIfTI-1 file")
    dim = struct.unpack_from(f"{order}8h", data, 40)
    kind = struct.unpack_from(f"{order}h", data, 70)[0]
    step = struct.unpack_from(f"{order}8f", data, 76)
    offset, slope, intercept = struct.unpack_from(f"{order}3f", data, 108)
    shift = struct.unpack_from(f"{order}3f", data, 268)
    if kind not in _NIFTI or not 1 <= dim[0] <= 3:
        raise ValueError(f"type {kind} or {dim[0]} dimensions aren't read")
    size = [*dim[1 : dim[0] + 1], 1, 1][:3]
    return Head(list(size), [float(s) for s in shift], [float(s) or 1.0 for s in step[1:4]], order + _NIFTI[kind], int(offset), True, float(slope) or 1.0, float(intercept))


def parse_nifti(data: bytes) -> Volume:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head = nifti_head(data)
    values = head.scaled(np.frombuffer(data, np.dtype(head.kind), int(np.prod(head.size)), head.offset))
    return {"size": head.size, "origin": head.origin, "spacing": head.spacing}, values.reshape(head.size[::-1])


def nifti_bytes(values: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), compressed: bool = True) -> bytes:
    """A NIfTI-1 file, gzipped or plain, of values indexed [z, y, x]."""
    kind = next(k for k, t in _NIFTI.items() if values.dtype == np.dtype(t))
    nz, ny, nx = values.shape
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, nx, ny, nz, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, kind, values.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<3f", head, 268, *origin)
    head[344:348] = b"n+1\0"
    whole = bytes(head) + np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes()
    return gzip.compress(whole) if compressed else whole


def read_nifti(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _voxels(spark, path, parse_nifti)


# MetaImage and NRRD, with the pixels in the file.

_META = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
_NRRD = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "short": "i2", "int16": "i2", "uint": "u4", "uint32": "u4", "int": "i4", "int32": "i4", "float": "f4", "double": "f8"}


def _three(head: Head, data: bytes) -> Volume:
    """The volume of a head and its plain pixels."""
    values = np.frombuffer(data, head.kind)
    if len(values) < np.prod(head.size):
        raise ValueError(f"{len(values)} values for a size of {head.size}")
    return {"size": head.size, "origin": head.origin, "spacing": head.spacing}, values[: int(np.prod(head.size))].reshape(head.size[::-1])


def _head(size: list[int], origin: list[float], spacing: list[float], kind: str, offset: int, plain: bool) -> Head:
    """Of up to three dimensions, as one of three."""
    more = 3 - len(size)
    if more < 0:
        raise ValueError(f"{len(size)} dimensions aren't read")
    return Head([*size, *[1] * more], origin + [0.0] * more, spacing + [1.0] * more, kind, offset, plain)


def metaimage_head(data: bytes) -> Head:
    """Of a MetaImage file whose header ends with ``ElementDataFile = LOCAL``."""
    end = data.find(b"ElementDataFile")
    if end < 0 or not data[:end].isascii():
        raise ValueError("no MetaImage file")
    end = data.index(b"\n", end) + 1
    head = dict([x.strip() for x in line.split("=", 1)] for line in data[:end].decode().splitlines() if "=" in line)
    if head["ElementDataFile"] != "LOCAL" or head.get("ElementType") not in _META or int(head.get("ElementNumberOfChannels", 1)) != 1:
        raise ValueError("pixels in another file, of another type or of several channels aren't read")
    size = [int(x) for x in head["DimSize"].split()]
    numbers = lambda names, default: next(([float(x) for x in head[n].split()] for n in names if n in head), [default] * len(size))
    order = ">" if "True" in (head.get("BinaryDataByteOrderMSB"), head.get("ElementByteOrderMSB")) else "<"
    return _head(size, numbers(("Offset", "Position", "Origin"), 0.0), numbers(("ElementSpacing", "ElementSize"), 1.0), order + _META[head["ElementType"]], end, head.get("CompressedData", "False") != "True")


def parse_metaimage(data: bytes) -> Volume:
    head = metaimage_head(data)
    return _three(head, data[head.offset :] if head.plain else zlib.decompress(data[head.offset :]))


def nrrd_head(data: bytes) -> Head:
    """Of an NRRD file with its pixels attached, raw or gzipped; spacings are those given or the directions' lengths."""
    if data[:4] != b"NRRD":
        raise ValueError("no NRRD file")
    end = data.index(b"\n\n") + 2
    head = dict([x.strip() for x in line.split(":", 1)] for line in data[:end].decode().splitlines()[1:] if ":" in line and not line.startswith("#"))
    if "data file" in head or "datafile" in head or head.get("type") not in _NRRD or head.get("encoding") not in ("raw", "gzip", "gz"):
        raise ValueError("pixels in another file, of another type or encoding aren't read")
    size = [int(x) for x in head["sizes"].split()]
    vectors = [[float(x) for x in v.strip("() ").split(",")] for v in head.get("space directions", "").replace(") (", ")|(").split("|") if v.strip("() ")]
    spacing = [float(x) for x in head["spacings"].split()] if "spacings" in head else [float(np.linalg.norm(v)) for v in vectors] or [1.0] * len(size)
    origin = [float(x) for x in head["space origin"].strip("()").split(",")] if "space origin" in head else [0.0] * len(size)
    return _head(size, origin, spacing, (">" if head.get("endian") == "big" else "<") + _NRRD[head["type"]], end, head["encoding"] == "raw")


def parse_nrrd(data: bytes) -> Volume:
    head = nrrd_head(data)
    return _three(head, data[head.offset :] if head.plain else gzip.decompress(data[head.offset :]))


def plain_head(data: bytes) -> Head | None:
    """The head of a file whose pixels are plain bytes, from its first ones; None of any other."""
    try:
        head = nrrd_head(data) if data[:4] == b"NRRD" else nifti_head(data) if data[344:347] in (b"n+1", b"ni1") else metaimage_head(data)
    except (ValueError, KeyError, UnicodeDecodeError, struct.error):
        return None
    return head if head.plain else None


def metaimage_bytes(values: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), compressed: bool = True) -> bytes:
    """A file of values indexed [z, y, x]."""
    kind = next(k for k, t in _META.items() if values.dtype == np.dtype(t))
    numbers = lambda xs: " ".join(f"{x:g}" for x in xs)
    head = f"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nCompressedData = {compressed}\nOffset = {numbers(origin)}\nElementSpacing = {numbers(spacing)}\nDimSize = {numbers(values.shape[::-1])}\nElementType = {kind}\nElementDataFile = LOCAL\n"
    raw = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes()
    return head.encode() + (zlib.compress(raw) if compressed else raw)


def nrrd_bytes(values: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), compressed: bool = True) -> bytes:
    """A file of values indexed [z, y, x], its pixels gzipped or raw."""
    kind = next(k for k, t in _NRRD.items() if values.dtype == np.dtype(t))
    numbers = lambda xs: " ".join(f"{x:g}" for x in xs)
    directions = " ".join("(" + ",".join(f"{s if i == j else 0:g}" for j in range(3)) + ")" for i, s in enumerate(spacing))
    head = f"NRRD0004\ntype: {kind}\ndimension: 3\nspace dimension: 3\nsizes: {numbers(values.shape[::-1])}\nspace directions: {directions}\nspace origin: ({','.join(f'{x:g}' for x in origin)})\nendian: little\nencoding: {'gzip' if compressed else 'raw'}\n\n"
    raw = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes()
    return head.encode() + (gzip.compress(raw) if compressed else raw)


def parse_image(data: bytes) -> Volume:
    """A volume file of any kind that is read, told by its first bytes."""
    if data[:3] == b"HR2":
        return parse_hr2(data)
    if data[:4] == b"NRRD":
        return parse_nrrd(data)
    if data[:2] == b"\x1f\x8b" or data[344:347] in (b"n+1", b"ni1"):
        return parse_nifti(data)
    if data[128:132] == b"DICM":
        s = parse_dicom(data)
        return {"size": [*s["values"].shape[::-1], 1], "origin": [0.0, 0.0, s["position"]], "spacing": [*s["spacing"][::-1], 1.0]}, s["values"][None]
    if b"ElementDataFile" in data[:4096]:
        return parse_metaimage(data)
    return parse_octave(data)


def read_images(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    return _voxels(spark, path, parse_image, glob)


def image_geometry(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    return _geometry(spark, path, parse_image, glob)


def nifti_files(voxels: DataFrame, value: str = "v", kind: str = "f4", geometry: DataFrame | None = None, compressed: bool = True) -> DataFrame:
    """(volume_id, content) of each volume as a file, gzipped or plain, with spacing and origin of ``geometry`` (volume_id, origin, spacing) if it is given.

    Slices are packed in tasks of their own; the task that writes a volume holds its bytes.
    """
    item = np.dtype(kind)
    # One row a volume: how far it goes.
    sizes = voxels.groupBy("volume_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in ("x", "y", "z")])
    known = geometry.select("volume_id", "origin", "spacing") if geometry is not None else sizes.select("volume_id", F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(*[F.lit(1.0)] * 3).alias("spacing"))
    sizes = sizes.join(known, "volume_id", "left")

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(frame["ny"].iloc[0]), int(frame["nx"].iloc[0])), item)
        grid[frame["y"], frame["x"]] = frame[value]
        first = frame.iloc[:1]
        return pd.DataFrame({c: first[c] for c in ("volume_id", "z", "nx", "ny", "nz", "origin", "spacing")} | {"data": [zlib.compress(grid.tobytes(), 1)]})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        nx, ny, nz = (int(frame[c].iloc[0]) for c in ("nx", "ny", "nz"))
        grid = np.zeros((nz, ny, nx), item)
        for z, data in zip(frame["z"], frame["data"], strict=True):
            grid[z] = np.frombuffer(zlib.decompress(data), item).reshape(ny, nx)
        origin, spacing = ([float(x) for x in frame[c].iloc[0]] if frame[c].iloc[0] is not None else d for c, d in (("origin", [0.0] * 3), ("spacing", [1.0] * 3)))
        return pd.DataFrame({"volume_id": [frame["volume_id"].iloc[0]], "content": [nifti_bytes(grid, spacing, origin, compressed)]})

    rows = voxels.join(sizes, "volume_id")
    slices = rows.groupBy("volume_id", "z").applyInPandas(packed, "volume_id string, z long, nx long, ny long, nz long, origin array<double>, spacing array<double>, data binary")
    return slices.groupBy("volume_id").applyInPandas(whole, "volume_id string, content binary")


# Pairs of files: a list says which mask belongs to which image.


def pair_voxels(spark: SparkSession, pairs: DataFrame, parse: Callable[[bytes], Volume] = parse_image) -> DataFrame:
    """Voxels (volume_id, x, y, z, v, m) of the pairs (first, second) of image and mask files; volume_id is the image's path.

    The list of pairs is one that people write; its paths go to the reader.
    """
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = pairs.select(local(F.col("first")).alias("first"), local(F.col("second")).alias("second"))
    paths = named.distinct().collect()
    if not paths:
        return spark.createDataFrame([], VOXELS + ", m int")
    images, masks = (_voxels(spark, sorted({p[k] for p in paths}), parse).withColumn("volume_id", local(F.col("volume_id"))) for k in ("first", "second"))
    keyed = named.join(images, named["first"] == images["volume_id"]).select("first", "second", "x", "y", "z", "v")
    own = masks.select(F.col("volume_id").alias("second"), "x", "y", "z", F.col("v").cast("int").alias("m"))
    return keyed.join(own, ["second", "x", "y", "z"]).select(F.col("first").alias("volume_id"), "x", "y", "z", "v", "m")


# DICOM: files of one slice each; pixels plain, in run lengths or as lossless JPEG.

#: Transfer syntaxes that are read, and the tags used.
_EXPLICIT, _IMPLICIT, _BIG, _DEFLATED = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
_RLE, _JPEG, _JPEG_FIRST = "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70"
_LONG_VR = frozenset({b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"})
_TAGS = {
    (0x0002, 0x0010): "syntax", (0x0008, 0x0005): "characters", (0x0008, 0x0020): "study_date", (0x0008, 0x0021): "series_date", (0x0010, 0x0020): "patient", (0x0018, 0x1210): "kernel", (0x0020, 0x000E): "series_uid", (0x0020, 0x0013): "number",
    (0x0020, 0x0032): "position", (0x0020, 0x0037): "orientation", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0030): "spacing", (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed",
    (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope", (0x7FE0, 0x0010): "pixels",
}
_NUMBERS = ("rows", "columns", "bits", "signed")
#: Character sets of text that aren't read as Latin-1.
_CHARACTERS = {"ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620"} | {f"ISO_IR {n}": f"iso8859-{k}" for n, k in ((101, 2), (109, 3), (110, 4), (144, 5), (127, 6), (126, 7), (138, 8), (148, 9))}


def _elements(data: bytes, at: int, explicit: bool, until: int | None = None, order: str = "<"):
    """(tag, value) of a data set; what is in sequences is passed over; compressed pixels are a list of their fragments."""
    end, depth = len(data) if until is None else until, 0
    while at + 8 <= end:
        group, element = struct.unpack_from(f"{order}HH", data, at)
        kind = data[at + 4 : at + 6]
        if group == 0xFFFE or not explicit:
            size, at = struct.unpack_from(f"{order}I", data, at + 4)[0], at + 8
        elif kind in _LONG_VR:
            size, at = struct.unpack_from(f"{order}I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from(f"{order}H", data, at + 6)[0], at + 8
        if size == 0xFFFFFFFF and (group, element) == (0x7FE0, 0x0010):
            parts = []
            while at + 8 <= end:
                number, n = struct.unpack_from("<2xHI", data, at)
                at += 8
                if number == 0xE0DD:
                    break
                parts.append(data[at : at + n])
                at += n
            yield (group, element), parts[1:]  # the first is a table of where frames begin
            continue
        if size == 0xFFFFFFFF:
            # A sequence, or an item of one, that ends with an element of its own.
            depth += group != 0xFFFE
            continue
        if group == 0xFFFE:
            depth -= element == 0xE0DD
        elif not depth:
            yield (group, element), data[at : at + size]
        at += size


def _pixels(found: dict, syntax: str, order: str) -> np.ndarray:
    rows, columns, size = found["rows"], found["columns"], found["bits"] // 8
    kind = f"{'i' if found.get('signed') else 'u'}{size}"
    if isinstance(found["pixels"], bytes) == (syntax in (_RLE, _JPEG, _JPEG_FIRST)):
        raise ValueError(f"pixels aren't as transfer syntax {syntax} has them")
    if isinstance(found["pixels"], bytes):
        values = np.frombuffer(found["pixels"], order + kind, rows * columns).reshape(rows, columns)
    elif syntax == _RLE:
        values = rle_values(found["pixels"][0], rows, columns, size)
    else:
        values = jpeg_values(b"".join(found["pixels"])).astype(f"u{size}")
    if values.shape != (rows, columns):
        raise ValueError(f"{values.shape} pixels for {rows} rows and {columns} columns")
    return values if isinstance(found["pixels"], bytes) else values.view(kind)


def parse_dicom(data: bytes) -> dict:
    """A slice: series_uid, series_date, patient, study_date, kernel, position (along its normal, or its number), origin, spacing, values indexed [y, x].

    The normal is that of the orientation's two directions, or the third axis.
    """
    if data[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    length = struct.unpack_from("<I", data, 140)[0] if data[132:136] == b"\x02\x00\x00\x00" else 0
    found: dict = {}
    begin = 144 + length if length else 132
    for tag, value in _elements(data, 132, True, begin if length else None):
        if tag[0] == 2 and tag in _TAGS:
            found[_TAGS[tag]] = value.strip(b"\0 ").decode()
    syntax = found.get("syntax", _IMPLICIT)
    if syntax not in (_EXPLICIT, _IMPLICIT, _BIG, _DEFLATED, _RLE, _JPEG, _JPEG_FIRST):
        raise ValueError(f"transfer syntax {syntax} isn't read")
    order = ">" if syntax == _BIG else "<"
    if syntax == _DEFLATED:
        data, begin = zlib.decompress(data[begin:], -15), 0
    for tag, value in _elements(data, begin, syntax != _IMPLICIT, order=order):
        name = _TAGS.get(tag)
        if name and name not in found:
            found[name] = int.from_bytes(value[:2], "big" if order == ">" else "little") if name in _NUMBERS else value if name == "pixels" else value.strip(b"\0 ").decode(_CHARACTERS.get(found.get("characters"), "latin-1"), "replace")
    missing = {"rows", "columns", "bits", "pixels", "series_uid"} - set(found)
    if missing:
        raise ValueError(f"{', '.join(sorted(missing))} not there")
    numbers = lambda name, default: [float(x) for x in found[name].split("\\")] if found.get(name) else default
    values = _pixels(found, syntax, order) * numbers("slope", [1.0])[0] + numbers("intercept", [0.0])[0]
    origin, turned = numbers("position", []), numbers("orientation", [])
    normal = np.cross(turned[:3], turned[3:6]) if len(turned) == 6 else np.array([0.0, 0.0, 1.0])
    position = float(np.dot(normal, origin)) if len(origin) == 3 else numbers("number", [0.0])[0]
    named = {k: found.get(k, "") for k in ("series_date", "patient", "study_date", "kernel")}
    return {"series_uid": found["series_uid"], **named, "position": position, "origin": origin if len(origin) == 3 else [0.0, 0.0, position], "spacing": numbers("spacing", [1.0, 1.0]), "values": values}


def dicom_bytes(values: np.ndarray, series_uid: str, series_date: str, position: float | list[float], explicit: bool = True, slope: float = 1.0, intercept: float = 0.0, syntax: str | None = None, **more) -> bytes:
    """A file of one slice of 16-bit values, indexed [y, x]; ``more`` has text of other tags, by the names they are read with.

    Text beyond ASCII is written, and declared, as UTF-8.
    """
    syntax = syntax or (_EXPLICIT if explicit else _IMPLICIT)
    order = ">" if syntax == _BIG else "<"

    def element(group: int, number: int, kind: bytes, content: bytes | list[bytes], long: bool = True, order: str = order) -> bytes:
        head = struct.pack(f"{order}HH", group, number)
        if isinstance(content, list):
            items = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(c)) + c for c in [b"", *[c + b"\0" * (len(c) % 2) for c in content]])
            return head + kind + b"\0\0" + struct.pack("<I", 0xFFFFFFFF) + items + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        content += (b" " if kind not in (b"UI", b"OW") else b"\0") * (len(content) % 2)
        if not long:
            return head + struct.pack("<I", len(content)) + content
        return head + kind + (b"\0\0" + struct.pack(f"{order}I", len(content)) if kind in _LONG_VR else struct.pack(f"{order}H", len(content))) + content

    meta = element(2, 0x10, b"UI", syntax.encode(), True, "<")
    number = lambda x: struct.pack(f"{order}H", x)
    at = position if isinstance(position, list) else [0.0, 0.0, position]
    unsigned = np.ascontiguousarray(values.astype("<i2")).view("<u2")
    pixels = [rle_bytes(unsigned)] if syntax == _RLE else [jpeg_bytes(unsigned, 1 if syntax == _JPEG_FIRST else 6)] if syntax in (_JPEG, _JPEG_FIRST) else values.astype(f"{order}i2").tobytes()
    tags = {name: tag for tag, name in _TAGS.items()}
    rows = {
        tags["series_date"]: (b"DA", series_date.encode()), tags["series_uid"]: (b"UI", series_uid.encode()), tags["position"]: (b"DS", "\\".join(f"{x:g}" for x in at).encode()),
        tags["rows"]: (b"US", number(values.shape[0])), tags["columns"]: (b"US", number(values.shape[1])), tags["bits"]: (b"US", number(16)), tags["signed"]: (b"US", number(1)),
        tags["intercept"]: (b"DS", f"{intercept:g}".encode()), tags["slope"]: (b"DS", f"{slope:g}".encode()), tags["pixels"]: (b"OB" if isinstance(pixels, list) else b"OW", pixels),
    } | {tags[k]: (b"LO", v.encode()) for k, v in more.items()}
    if not all(v.isascii() for v in (series_uid, series_date, *more.values())):
        rows[tags["characters"]] = (b"CS", b"ISO_IR 192")
    body = b"".join(element(*tag, kind, content, syntax != _IMPLICIT) for tag, (kind, content) in sorted(rows.items()))
    if syntax == _DEFLATED:
        deflate = zlib.compressobj(wbits=-15)
        body = deflate.compress(body) + deflate.flush()
    return b"\0" * 128 + b"DICM" + element(2, 0, b"UL", struct.pack("<I", len(meta)), True, "<") + meta + body


SLICES = "series_uid string, series_date string, position double, x long, y long, v double"


def dicom_slices(files: DataFrame) -> DataFrame:
    """(series_uid, series_date, position, x, y, v) of files (path, content), a slice each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    s = parse_dicom(content)
                except (ValueError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                y, x = np.indices(s["values"].shape)
                n = x.size
                cols = [pa.array([s["series_uid"]] * n), pa.array([s["series_date"]] * n), pa.array(np.full(n, s["position"])), *[pa.array(c.ravel(), pa.int64()) for c in (x, y)], pa.array(s["values"].ravel().astype(float))]
                yield pa.RecordBatch.from_arrays(cols, names=["series_uid", "series_date", "position", "x", "y", "v"])

    return files.select("path", "content").mapInArrow(run, SLICES)


def dicom_geometry(files: DataFrame) -> DataFrame:
    """(volume_id, origin, spacing, name) of the series of files (path, content).

    Origin is the first slice's position, spacing its pixels' and the slices' mean
    distance along their normal; the name is made of patient, study date, kernel and
    slice spacing.
    """
    text = ("patient", "study_date", "kernel")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_dicom(c) for c in batch.column("content").to_pylist()]
            cols = [pa.array(["_".join([s["series_uid"], s["series_date"]]) for s in found], pa.string()), *[pa.array([f(s) for s in found], pa.float64()) for f in (lambda s: s["position"], lambda s: s["spacing"][-1], lambda s: s["spacing"][0])]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s["origin"] for s in found], pa.list_(pa.float64())), *[pa.array([s[k] for s in found], pa.string()) for k in text]], names=["volume_id", "position", "dx", "dy", "at", *text])

    heads = files.select("content").mapInArrow(run, "volume_id string, position double, dx double, dy double, at array<double>, " + ", ".join(f"{k} string" for k in text))
    n = F.count_distinct("position")
    step = F.when(n > 1, (F.max("position") - F.min("position")) / (n - 1)).otherwise(1.0)
    found = heads.groupBy("volume_id").agg(F.min_by("at", "position").alias("origin"), F.array(F.min("dx"), F.min("dy"), step).alias("spacing"), *[F.min_by(k, "position").alias(k) for k in text])
    return found.select("volume_id", "origin", "spacing", volume_name([F.col(k) for k in text], F.col("spacing")[2]).alias("name"))


def read_dicom(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Volumes of all series in these files."""
    return series_volumes(dicom_slices(_files(spark, path, glob)))


def series_volumes(slices: DataFrame) -> DataFrame:
    """Volumes of slices (series_uid, series_date, position, x, y, v): one for each series and date, z by position."""
    # Positions are ranked, not voxels: a series has as many as slices.
    order = F.row_number().over(Window.partitionBy("series", "date").orderBy("at")) - 1
    places = slices.select(F.col("series_uid").alias("series"), F.col("series_date").alias("date"), F.col("position").alias("at")).distinct().withColumn("slice", order.cast("long"))
    same = F.col("series_uid").eqNullSafe(F.col("series")) & F.col("series_date").eqNullSafe(F.col("date")) & F.col("position").eqNullSafe(F.col("at"))
    return slices.join(places, same).select(F.concat_ws("_", "series_uid", "series_date").alias("volume_id"), "x", "y", F.col("slice").alias("z"), "v")


def write_volumes(voxels: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, a folder for each volume (and scale and feature), rows in raster order for skipping."""
    keys = by or ["volume_id"]
    voxels.repartition(*keys).sortWithinPartitions(*keys, "z", "y", "x").write.partitionBy(*keys).mode("overwrite").parquet(path)
