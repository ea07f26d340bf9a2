"""Whole workflows: the entry points that users call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.pointwise import apply_mask, intensity_window, remap
from voxelloom.functions.strings import join_paths
from voxelloom.operators import bag as bags
from voxelloom.operators import distance, histogram, lattice, roi, stencil
from voxelloom.operators import resample as resampling
from voxelloom.operators.stencil import FEATURES
from voxelloom.sources import files, text, volumes

Box = tuple[int, int, int]


def extract_features(voxels: DataFrame, scales: list[float], **options) -> DataFrame:
    return stencil.features(voxels, scales, **options)


def write_features(voxels: DataFrame, scales: list[float], path: str, kind: str = "f4", geometry: DataFrame | None = None, overwrite: bool = False, **options) -> None:
    """The features of each volume as files below ``path``, one a scale and feature: <volume_id>_scale_<scale><feature>.nii.gz, all or none.

    ``geometry`` (volume_id, origin, spacing) goes into the files.
    """
    featured = extract_features(voxels, scales, **options)
    pairs = ", ".join(f"'{c}', `{c}`" for c in FEATURES)
    named = featured.selectExpr("volume_id", "x", "y", "z", "scale", f"stack({len(FEATURES)}, {pairs}) AS (feature, v)").withColumn("name", text.feature_file(F.col("volume_id"), F.col("scale"), F.col("feature")))
    known = None if geometry is None else named.select("volume_id", "name").distinct().join(geometry, "volume_id").select(F.col("name").alias("volume_id"), "origin", "spacing")
    made = volumes.nifti_files(named.select(F.col("name").alias("volume_id"), "x", "y", "z", "v"), kind=kind, geometry=known)
    files.write_files(made.withColumnRenamed("volume_id", "name"), path, overwrite)


def generate_rois(voxels: DataFrame, size: Box, n: int = 50, box: Box = (53, 53, 41), mask: str = "m", mask_value: int | None = 1, by_label: bool = False, seed: int = 1) -> DataFrame:
    """Random boxes of each volume around voxels of one mask value, or of each value."""
    if by_label:
        return roi.random_rois(voxels, n, box, size, mask, seed, by=mask)
    chosen = voxels if mask_value is None else voxels.filter(F.col(mask) == mask_value)
    return roi.random_rois(chosen, n, box, size, mask, seed)


def determine_edges(voxels: DataFrame, scales: list[float], n_bins: int, samples: int = 0, foreground: list[int] | None = None, mask: str = "m", seed: int = 1, **options) -> DataFrame:
    """(hist_idx, scale, feature, edges) that equalise the histograms of all images' features in the foreground.

    ``samples`` voxels of each image are drawn by hash, with putting back and anew for
    each scale; 0 takes all.
    """
    inside = F.col(mask).isin(foreground) if foreground else F.col(mask) != 0
    featured = stencil.features(voxels, scales, mask=mask, **options).filter(inside)
    if samples:
        numbers = F.array(*[F.lit(i) for i in range(len(scales))])
        drawn = roi.drawn_again(voxels.filter(inside).select(*lattice.KEYS), samples, seed, numbers)
        featured = featured.join(drawn.select(*lattice.KEYS, F.col("again").alias("scale_idx")), [*lattice.KEYS, "scale_idx"])
    rows = stencil.feature_rows(featured)
    edges = histogram.determine_edges(rows.select("hist_idx", "value"), n_bins)
    spec = edges.groupBy("hist_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("edge_idx", "edge"))), lambda e: e["edge"]).alias("edges"))
    scale = F.element_at(F.array(*[F.lit(float(s)) for s in scales]), (F.col("hist_idx") / len(FEATURES)).cast("int") + 1)
    feature = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("hist_idx") % len(FEATURES) + 1)
    return spec.select("hist_idx", scale.alias("scale"), feature.alias("feature"), "edges")


def make_bag(voxels: DataFrame, spec: DataFrame, scales: list[float], rois: DataFrame | str, size: Box, box: Box = (41, 41, 41), mask: str = "m", **options) -> DataFrame:
    """Long bag of given boxes, or of a box around every voxel in the mask (``rois='dense'``, numbered by raster place)."""
    rows = bags.binned(stencil.features(voxels, scales, mask=mask, **options), spec, [*lattice.KEYS, mask])
    if isinstance(rois, str):
        # A specification has some dozens of rows.
        n_bins = (spec.agg(F.max(F.size("edges"))).first()[0] or 0) + 1
        return bags.dense_bag(rows, box, size, n_bins, mask)
    return bags.bag(rois, rows, mask)


def make_intensity_bag(voxels: DataFrame, edges: list[float], rois: DataFrame, value: str = "v", mask: str = "m") -> DataFrame:
    return bags.intensity_bag(rois, voxels, edges, value, mask)


def assemble_dataset(found: DataFrame, labels: DataFrame | None = None, instance_labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return bags.assembled(found, labels, instance_labels)


def extract_labels(voxels: DataFrame, rois: DataFrame, label: str = "m", ignore: list[int] | None = None, dominant: int = -1) -> DataFrame:
    return roi.labels(rois, voxels, label, ignore, dominant)


def sample_rois(voxels: DataFrame, rois: DataFrame, value: str = "v") -> DataFrame:
    return roi.flattened(rois, voxels, value)


def remap_mask(voxels: DataFrame, include: list[int], inside: int = 1, outside: int = 0, mask: str = "m") -> DataFrame:
    return voxels.withColumn(mask, remap(F.col(mask), include, inside, outside))


def mask_image(voxels: DataFrame, value: str = "v", mask: str = "m", outside: float = 0.0) -> DataFrame:
    return voxels.withColumn(value, apply_mask(F.col(value), F.col(mask), outside))


def masked_normalized_convolution(voxels: DataFrame, scales: list[float], mask: str = "m", masked: bool = True, **options) -> DataFrame:
    """Smoothed values at every scale, one row a voxel and scale; all scales in the same passes."""
    blur = stencil.blurred(voxels, scales, mask=mask, **options).drop("scale_idx")
    return blur.withColumn(FEATURES[0], apply_mask(F.col(FEATURES[0]), F.col(mask))) if masked else blur


def masked_gradient(voxels: DataFrame, mask: str = "m", **options) -> DataFrame:
    g = stencil.gradient_magnitude(voxels, **options)
    return g.withColumn(FEATURES[1], apply_mask(F.col(FEATURES[1]), F.col(mask)))


def crop_to_mask(voxels: DataFrame, mask: str = "m") -> DataFrame:
    return lattice.cropped_to_mask(voxels, mask)


def extract_slices(voxels: DataFrame, axis: str, n: int, **chosen) -> DataFrame:
    return lattice.slices(voxels, axis, n, **chosen)


def extract_window(voxels: DataFrame, spacing: tuple[float, float], width: float = 1500.0, level: float = -500.0, order: int = 3, new_spacing: float = 0.25, mask: str | None = None) -> DataFrame:
    """Slices at an even spacing, their values as 0 to 255, and the mask at the nearest old places if one is named."""
    rows = distance.resampled_slices(voxels, spacing, new_spacing, order, mask=mask)
    return rows.withColumn("value", intensity_window(F.col("value"), width, level))


def pad(voxels: DataFrame, old: tuple[int, ...], new: tuple[int, ...], fill: dict[str, object]) -> DataFrame:
    return lattice.padded(voxels, old, new, fill)


def resample(voxels: DataFrame, old: Box, new: Box, step: tuple[float, float, float] | None = None, align: str = "origin", source_origin: tuple[float, float, float] = (0.0, 0.0, 0.0), target_origin: tuple[float, float, float] = (0.0, 0.0, 0.0), spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), source: dict | None = None, target: dict | None = None, **options) -> DataFrame:
    """A source on a target's grid; ``align='origin'`` lays both origins on each other, ``'physical'`` keeps places.

    Grids of one orientation are told by ``step``, in the source's voxels, and their origins;
    others by ``source`` and ``target``, each with origin, spacing and, if they are turned,
    direction: a matrix whose columns are the cosines of the axes.
    """
    if source is not None and target is not None:
        matrix, offset = resampling.index_map(source, target)
    else:
        matrix, offset = [[s if i == j else 0.0 for j in range(3)] for i, s in enumerate(step)], [(t - s) / d for s, t, d in zip(source_origin, target_origin, spacing, strict=True)]
    return resampling.resampled_onto(voxels, old, new, matrix, offset if align == "physical" else [0.0] * 3, **options)


def expected_distance(voxels: DataFrame, mask: str = "m", probability: str = "p", squared: bool = True) -> DataFrame:
    return distance.expected_distance(distance.signed_distance(voxels, mask, squared), "distance", probability, mask)


def describe_volume(voxels: DataFrame) -> DataFrame:
    return lattice.volume_info(voxels)


def value_counts(voxels: DataFrame, value: str = "v") -> DataFrame:
    return histogram.value_counts(voxels, value)


#: Boxes of each round of a coverage study.
COVERAGE_ROUNDS = [10, 10, 10, 10, 10, 50, 100, 100, 100, 100, 500, 1000]


def roi_coverage(voxels: DataFrame, size: Box, box: Box, rounds: list[int] | None = None, mask: str = "m", seed: int = 1) -> DataFrame:
    rounds = rounds or COVERAGE_ROUNDS
    return roi.coverage(roi.random_rois(voxels, sum(rounds), box, size, mask, seed), voxels, rounds, mask)


def analytic_coverage(spark: SparkSession, size: Box, box: Box, rounds: list[int] | None = None, seed: int = 1) -> DataFrame:
    """Coverage of a volume that is all mask, of which only the size is known."""
    return roi_coverage(lattice.empty_volume(spark, size).withColumn("m", F.lit(1)), size, box, rounds, seed=seed)


def save_dataset(instances: DataFrame, known: DataFrame, path: str) -> None:
    """Instances and bags as two tables below ``path``; instances are dealt out and sorted by bag, so that a bag is read from a file or two."""
    instances.repartitionByRange("bag_idx", "inst_idx").sortWithinPartitions("bag_idx", "inst_idx").write.mode("overwrite").parquet(join_paths(path, "instances"))
    known.write.mode("overwrite").parquet(join_paths(path, "bags"))


def mask_with_rois(voxels: DataFrame, rois: DataFrame, value: str = "v") -> DataFrame:
    return roi.kept_in_rois(voxels, rois, value)


def convert_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(volume_id, content) of volume files of any kind, as NIfTI files with their spacing and origin."""
    return volumes.nifti_files(volumes.read_images(spark, path, glob), geometry=volumes.image_geometry(spark, path, glob))


def convert_dicom(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(volume_id, name, content) of all series in DICOM files, as NIfTI files.

    volume_id is made of series and date; the name, of patient, study date, kernel and
    slice spacing, is for people: two series may have the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob or "*").load(path).select("path", "content")
    geometry = volumes.dicom_geometry(files)
    found = volumes.nifti_files(volumes.series_volumes(volumes.dicom_slices(files)), geometry=geometry)
    return found.join(geometry.select("volume_id", "name"), "volume_id").select("volume_id", "name", "content")
