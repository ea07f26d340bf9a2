"""Readers and writers of text files: regions, pairs, matrices, histogram specifications, labels, bags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from voxelloom.functions.strings import path_join, six_digits
from voxelloom.operators.stencil import FEATURES

ROI_NUMBERS = ("x0", "y0", "z0", "sx", "sy", "sz")
ROI_PATTERN = r"^\s*\[\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*\]\s*\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]\s*$"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, value) of small text files, whole, with their lines numbered from 0."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def roi_numbers(line: Column) -> list[Column]:
    found = F.regexp_extract_all(line, F.lit(r"(-?\d+)"), 1)
    return [F.get(found, i).cast("long").alias(n) for i, n in enumerate(ROI_NUMBERS)]


def parse_rois(lines: DataFrame, header: bool | None = None) -> DataFrame:
    """Regions of (path, line, value): ``[x, y, z][sx, sy, sz]`` a line, numbered in order.

    A first line that is no region is a header; ``header`` says so for sure.  The last
    line counts without a line feed too.  Any other line that isn't blank is an error.
    """
    rows = lines.filter(F.trim("value") != "")
    first = F.min("line").over(Window.partitionBy("path"))
    rows = rows.withColumns({"first": first, "region": F.col("value").rlike(ROI_PATTERN)})
    drop = F.col("line") == F.col("first")
    drop = drop & ~F.col("region") if header is None else drop & F.lit(header)
    kept = rows.filter(~drop)
    checked = F.when(F.col("region"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no region: "), F.col("value"))))
    numbered = kept.withColumn("roi_id", (F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).cast("long"))
    return numbered.select(F.col("path").alias("volume_id"), "roi_id", *roi_numbers(checked))


def read_rois(spark: SparkSession, path: str | list[str], header: bool | None = None) -> DataFrame:
    return parse_rois(numbered_lines(spark, path), header)


def roi_lines(rois: DataFrame) -> DataFrame:
    """(volume_id, roi_id, line)."""
    return rois.select("volume_id", "roi_id", F.format_string("[%d, %d, %d][%d, %d, %d]", *ROI_NUMBERS).alias("line"))


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """Lines in order, as one text file: for what people read, as labels and bags of a volume."""
    rows.orderBy(*order).coalesce(1).select("line").write.mode("overwrite").text(path)


def parse_pairs(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(path, line, first, second) of lines split at their first separator; blank lines are skipped, others are an error."""
    rows = lines.filter(F.trim("value") != "")
    at = F.locate(separator, F.col("value"))
    checked = F.when(at > 0, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no separator: "), F.col("value"))))
    first = F.trim(F.substring_index(checked, separator, 1))
    second = F.trim(F.expr("substring(value, 1 + char_length(substring_index(value, '" + separator + "', 1)) + " + str(len(separator)) + ")"))
    return rows.select("path", "line", first.alias("first"), second.alias("second"))


def read_pairs(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return parse_pairs(numbered_lines(spark, path), separator)


def parse_sequence(line: Column, separator: str = ",") -> Column:
    """Numbers up to the first part that isn't one."""
    parts = F.transform(F.split(line, "\\Q" + separator + "\\E"), lambda x: F.trim(x).try_cast("double"))
    bad = F.array_position(F.transform(parts, lambda x: x.isNull()), True)
    return F.when(bad > 0, F.slice(parts, F.lit(1), (bad - 1).cast("int"))).otherwise(parts)


def parse_matrix(lines: DataFrame, separator: str = ",", across: bool = False) -> DataFrame:
    """(path, row, values) of lines that aren't blank; all rows of a file have as many numbers as its first, or it is an error.

    With ``across`` all files must have as many.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("values", parse_sequence(F.col("value"), separator))
    w = Window.partitionBy("path").orderBy("line")
    wanted = F.first(F.size("values")).over(w)
    rows = rows.withColumns({"wanted": wanted, "row": (F.row_number().over(w) - 1).cast("long")})
    checked = F.when(F.size("values") == F.col("wanted"), F.col("values")).otherwise(F.raise_error(F.concat(F.lit("row of another length in "), F.col("path"))))
    if across:
        # One row.
        rows = rows.join(F.broadcast(rows.agg(F.min("wanted").alias("least"), F.max("wanted").alias("most"))))
        checked = F.when(F.col("least") == F.col("most"), checked).otherwise(F.raise_error(F.lit("files have different numbers of columns")))
    return rows.select("path", "row", checked.alias("values"))


def read_matrix(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    return parse_matrix(numbered_lines(spark, path), separator)


def bag_paths(lines: DataFrame) -> DataFrame:
    """(bag_idx, path) of a list of bag files, parted by white space."""
    named = lines.select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "path")).filter("path <> ''")
    # As many rows as files that people list.
    return named.select((F.row_number().over(Window.orderBy("line", "at")) - 1).cast("long").alias("bag_idx"), "path")


def read_bags(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(bag, roi_id, features) of bag files, which all have as many columns."""
    return parse_matrix(numbered_lines(spark, paths), across=True).select(F.col("path").alias("bag"), F.col("row").alias("roi_id"), F.col("values").alias("features"))


def read_spec(spark: SparkSession, path: str, scales: list[float] | None = None) -> DataFrame:
    """(hist_idx, edges) of a histogram specification: ``#`` lines are skipped, a blank one ends it.

    With scales there must be a row for each scale and feature.  Such files have some
    dozens of rows.
    """
    rows = []
    for r in numbered_lines(spark, path).orderBy("line").collect():
        if r.value.startswith("#"):
            continue
        if not r.value.strip():
            break
        rows.append([float(x) for x in r.value.split(",")])
    if len({len(r) for r in rows}) > 1:
        raise ValueError("histograms have different numbers of bins")
    if scales is not None and len(rows) != len(FEATURES) * len(scales):
        raise ValueError(f"{len(rows)} histograms for {len(scales)} scales")
    return spark.createDataFrame(pa.table({"hist_idx": pa.array(range(len(rows)), pa.int32()), "edges": pa.array(rows, pa.list_(pa.float64()))}))


def spec_lines(spec: DataFrame, scales: list[float]) -> DataFrame:
    """(hist_idx, line) of a specification, with its two heading lines first."""
    heads = spec.sparkSession.createDataFrame([(-2, "# " + ",".join(FEATURES)), (-1, "# " + ",".join(f"{s:g}" for s in scales))], "hist_idx int, line string")
    return heads.unionByName(spec.select("hist_idx", F.array_join(F.transform("edges", six_digits), ",").alias("line")))


def sequence_line(values: Column, separator: str = ",") -> Column:
    """An array of numbers as text, of six digits each."""
    return F.array_join(F.transform(values, six_digits), separator)


def sample_lines(samples: DataFrame) -> DataFrame:
    """(volume_id, roi_id, line) of the values of each box: whole numbers with all their digits, others with six, as C++ streams write them."""
    whole = isinstance(samples.schema["values"].dataType.elementType, IntegralType)
    line = F.array_join(F.col("values").cast("array<string>"), ",") if whole else sequence_line(F.col("values"))
    return samples.select("volume_id", "roi_id", line.alias("line"))


def label_lines(labels: DataFrame) -> DataFrame:
    return labels.select("volume_id", "roi_id", F.col("label").cast("string").alias("line"))


def feature_file(base: Column, scale: Column, feature: Column) -> Column:
    return F.format_string("%s_scale_%.6f%s.nii.gz", base, scale.cast("double"), feature)


def scale_file(folder: Column, prefix: Column, scale: Column) -> Column:
    return path_join(folder, F.format_string("%sscale_%.6f.nii.gz", prefix, scale.cast("double")))


def slice_file(axis: Column, absolute: Column, relative: Column, suffix: str = "nii.gz") -> Column:
    return F.format_string("axis-%d_absslice-%d_relslice-%d." + suffix, axis, absolute, relative)


def mask_roi_file(base: Column, value: Column) -> Column:
    return F.format_string("%s%d.ROIInfo", base, value)
