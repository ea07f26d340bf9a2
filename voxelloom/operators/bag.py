"""Bags of instances: histograms of regions, in long form and as feature arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.functions.pointwise import bin_index, bin_index_of
from voxelloom.functions.strings import six_digits
from voxelloom.operators.bricks import Brick, box_sums, in_bricks
from voxelloom.operators.integral import box_sums_of, worth_summing
from voxelloom.operators.lattice import AXES
from voxelloom.operators.prefix import prefix_sums
from voxelloom.operators.roi import STARTS, box_histograms, candidates, roi_voxels
from voxelloom.operators.stencil import FEATURES


def _frequency(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / F.when(total > 0, total)).otherwise(F.lit(float("nan")))


def binned(featured: DataFrame, spec: DataFrame, kept: list[str]) -> DataFrame:
    """(kept, scale_idx, bins): of each voxel and scale the bin of each feature, by ``spec`` (hist_idx, edges).

    The specification, of a row for each scale and feature, is broadcast; a feature
    without one has a null bin.
    """
    n = len(FEATURES)
    edges = F.map_from_entries(F.collect_list(F.struct((F.col("hist_idx") % n).alias("feature"), "edges"))).alias("by_feature")
    by_scale = spec.groupBy(F.expr(f"cast(hist_idx div {n} AS int)").alias("scale_idx")).agg(edges)
    found = featured.join(F.broadcast(by_scale), "scale_idx")
    bins = [F.when(F.col("by_feature")[i].isNotNull(), bin_index_of(F.col(c), F.col("by_feature")[i])).cast("int") for i, c in enumerate(FEATURES)]
    return found.select(*kept, "scale_idx", F.array(*bins).alias("bins"))


def _long(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("volume_id", "roi_id", "hist_idx"))
    return counts.withColumn("total", total).select("volume_id", "roi_id", "hist_idx", "bin", _frequency(F.col("n"), F.col("total")).alias("freq"))


def bag(rois: DataFrame, rows: DataFrame, mask: str = "m") -> DataFrame:
    """(volume_id, roi_id, hist_idx, bin, freq) of binned voxels (voxel, mask, scale_idx, bins) in each box and the mask.

    A voxel meets its boxes once for a scale, with the bins of all features.
    Frequencies of bins without values aren't rows; ``as_arrays`` puts zeros there.  A
    box without a voxel in the mask has no rows; ``as_arrays`` makes it NaN.
    """
    inside = roi_voxels(rois, rows.filter(F.col(mask) != 0)).select("volume_id", "roi_id", "scale_idx", F.posexplode("bins").alias("feature", "bin")).filter("bin IS NOT NULL")
    hist = (F.col("scale_idx") * len(FEATURES) + F.col("feature")).cast("int")
    return _long(inside.groupBy("volume_id", "roi_id", hist.alias("hist_idx"), "bin").agg(F.count(F.lit(1)).alias("n")))


def dense_bag(rows: DataFrame, box: tuple[int, int, int], size: tuple[int, int, int], n_bins: int, mask: str = "m") -> DataFrame:
    """The bag of a box around every voxel in the mask that has room, numbered by its voxel's raster place.

    Boxes of one size are box sums of each bin's indicator over bricks, so the cost
    doesn't depend on the box, and no voxel is copied for each box that it is in.
    """
    n = len(FEATURES)
    schema = T.StructType([T.StructField("volume_id", T.StringType()), T.StructField("roi_id", T.LongType()), T.StructField("scale_idx", T.IntegerType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(brick: Brick) -> pa.Table:
        table = brick.table
        bins = table.column("bins").combine_chunks()
        bins = pc.fill_null(bins.flatten(), -1).to_numpy(zero_copy_only=False).reshape(-1, n)
        inside = table.column(mask).to_numpy(zero_copy_only=False) != 0
        x, y, z = (p[brick.own] for p in brick.place)
        fits = inside[brick.own]
        for p, b, whole in zip((x, y, z), box, size, strict=True):
            fits &= (p - b // 2 >= 0) & (p - b // 2 + b <= whole)
        at = tuple(i[brick.own][fits] for i in brick.at)
        counts = np.zeros((int(fits.sum()), n, n_bins), np.int32)
        for f in range(n):
            for k in range(n_bins):
                on = inside & (bins[:, f] == k)
                if on.any():
                    grid = np.zeros(brick.shape, np.int32)
                    grid[brick.at] = on
                    counts[:, f, k] = box_sums(grid, box)[at]
        place = ((z * size[1] + y) * size[0] + x)[fits]
        off = pa.array(np.arange(len(place) + 1) * n * n_bins, pa.int32())
        cols = [pa.array([table.column("volume_id")[0].as_py()] * len(place), pa.string()), pa.array(place, pa.int64()), pa.array(np.full(len(place), table.column("scale_idx")[0].as_py(), np.int32)), pa.ListArray.from_arrays(off, pa.array(counts.ravel()))]
        return pa.Table.from_arrays(cols, names=["volume_id", "roi_id", "scale_idx", "counts"])

    halo = tuple(max(b // 2, b - 1 - b // 2) for b in box)
    found = in_bricks(rows.select("volume_id", *AXES, mask, "scale_idx", "bins"), halo, run, schema, ("volume_id", "scale_idx"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.aggregate(F.slice("counts", f * n_bins + 1, n_bins), F.lit(0), lambda a, x: a + x))
    cells = found.withColumn("totals", sums).select("volume_id", "roi_id", "scale_idx", "totals", F.posexplode("counts").alias("at", "n")).filter("n > 0")
    feature = F.expr(f"cast(at div {n_bins} AS int)")
    return cells.select("volume_id", "roi_id", (F.col("scale_idx") * n + feature).cast("int").alias("hist_idx"), (F.col("at") % n_bins).cast("int").alias("bin"), (F.col("n") / F.element_at("totals", feature + 1)).alias("freq"))


def intensity_bag(rois: DataFrame, voxels: DataFrame, edges: list[float], value: str = "v", mask: str = "m", by_sums: bool | None = None) -> DataFrame:
    """(volume_id, roi_id, bin, n, freq) of the raw values of each box, with empty bins.

    ``by_sums`` counts bins from the corners of boxes in summed volumes, at a cost that
    doesn't depend on their sizes; by default it does where boxes have more voxels in all
    than the lattice.
    """
    bins = bin_index(F.col(value), edges).cast("int")
    if worth_summing(rois, voxels) if by_sums is None else by_sums:
        binned_ = voxels.withColumn("_bin", F.when(F.col(mask) != 0, bins))
        counts = {f"n{i}": F.coalesce(F.col("_bin") == i, F.lit(False)).cast("long") for i in range(len(edges) + 1)}
        return long_bins(box_sums_of(rois, binned_, counts), len(edges) + 1)
    inside = roi_voxels(rois, voxels.filter(F.col(mask) != 0)).select("volume_id", "roi_id", bins.alias("bin"))
    per_bin = inside.groupBy("volume_id", "roi_id").agg(*[F.sum((F.col("bin") == i).cast("long")).alias(f"n{i}") for i in range(len(edges) + 1)])
    whole = rois.select("volume_id", "roi_id").join(per_bin, ["volume_id", "roi_id"], "left")
    return long_bins(whole, len(edges) + 1)


def long_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    """Columns n0 .. of each box as rows (bin, n, freq); without any count the frequency is NaN."""
    pairs = ", ".join(f"{i}, coalesce(n{i}, 0L)" for i in range(n_bins))
    total = " + ".join(f"coalesce(n{i}, 0L)" for i in range(n_bins))
    long = rows.selectExpr("volume_id", "roi_id", f"{total} AS total", f"stack({n_bins}, {pairs}) AS (bin, n)")
    return long.select("volume_id", "roi_id", "bin", "n", _frequency(F.col("n"), F.col("total")).alias("freq"))


def dense_intensity_bag(voxels: DataFrame, box: tuple[int, int, int], size: tuple[int, int, int], edges: list[float], value: str = "v", mask: str = "m") -> DataFrame:
    """The bag of a box around every voxel in the mask, by sums along the axes instead of a join."""
    counted = box_histograms(voxels, box, bin_index(F.col(value), edges), len(edges) + 1, mask)
    fits = candidates(counted, box, size, F.col(mask) != 0)
    place = (F.col("z") * size[1] + F.col("y")) * size[0] + F.col("x")
    return long_bins(fits.withColumn("roi_id", place).drop(*STARTS), len(edges) + 1)


def as_arrays(long: DataFrame, rois: DataFrame, n_hists: int, n_bins: int) -> DataFrame:
    """(volume_id, roi_id, features): one array a box, column hist_idx * n_bins + bin; zeros where a histogram has no such bin, NaN where it has no value at all."""
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("hist_idx") * n_bins + F.col("bin")).alias("at"), "freq")))
    have = long.groupBy("volume_id", "roi_id").agg(entries.alias("found"), F.collect_set("hist_idx").alias("hists"))
    empty = lambda i: F.when(F.array_contains("hists", (i / n_bins).cast("int")), F.lit(0.0)).otherwise(F.lit(float("nan")))
    features = F.transform(F.sequence(F.lit(0), F.lit(n_hists * n_bins - 1)), lambda i: F.coalesce(F.element_at("found", i), empty(i)))
    return rois.select("volume_id", "roi_id").join(have, ["volume_id", "roi_id"], "left").select("volume_id", "roi_id", F.coalesce(features, F.array_repeat(F.lit(float("nan")), n_hists * n_bins)).alias("features"))


def bag_lines(arrays: DataFrame) -> DataFrame:
    """One line of comma-separated numbers of six digits a box."""
    return arrays.select("volume_id", "roi_id", F.array_join(F.transform("features", six_digits), ",").alias("line"))


def assembled(bags: DataFrame, labels: DataFrame | None = None, instance_labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Instances and bags of a dataset from (bag, roi_id, features): bags are numbered by name, instances by bag and roi_id.

    Where there are labels (bag, label) there must be one for each bag, and none for
    another, or it is an error; so for instance labels (bag, roi_id, label).  Without
    labels bags have null and instances 0.
    """
    counted = bags.groupBy("bag").agg(F.count(F.lit(1)).alias("n_instances"))
    names = prefix_sums(counted, ["bag"], {"bag_idx": F.lit(1).cast("long"), "first": F.col("n_instances")})
    within = F.row_number().over(Window.partitionBy("bag").orderBy("roi_id")) - 1
    instances = bags.withColumn("within", within).join(names.select("bag", "bag_idx", "first"), "bag").withColumn("inst_idx", F.col("first") + F.col("within"))
    instances = _labelled(instances, instance_labels, ["bag", "roi_id"], "inst_idx") if instance_labels is not None else instances.withColumn("label", F.lit(0.0))
    known = _labelled(names, labels, ["bag"], "bag_idx") if labels is not None else names.withColumn("label", F.lit(None).cast("double"))
    return instances.select("bag_idx", "inst_idx", "features", F.col("label").cast("double").alias("label")), known.select("bag_idx", "bag", "n_instances", "label")


def _labelled(rows: DataFrame, labels: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows with the label of their keys; a row without a label and a label without a row are errors."""
    once = labels.groupBy(*keys).agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("_n"))
    shown = F.concat_ws(" ", *keys)
    wrong = F.when(F.col(number).isNull(), F.concat(F.lit("a label of what isn't there: "), shown)).when(F.col("_n").isNull(), F.concat(F.lit("no label: "), shown)).when(F.col("_n") > 1, F.concat(F.lit("several labels: "), shown))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("label"))
    return rows.join(once, keys, "full").withColumn("label", checked).drop("_n")
