"""Regions of interest: boxes (volume_id, roi_id, x0, y0, z0, sx, sy, sz) and the voxels in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.integral import box_sums_of, worth_summing
from voxelloom.operators.lattice import AXES
from voxelloom.operators.ranks import at_ranks, strips_of

#: Side of the bricks by which boxes and voxels meet.
BRICK = 16
STARTS, SIZES = ("x0", "y0", "z0"), ("sx", "sy", "sz")


def candidates(voxels: DataFrame, box: tuple[int, int, int], size: tuple[int, int, int], mask: Column) -> DataFrame:
    """Boxes around every voxel in the mask that fit in the volume; a box starts half its size before its voxel."""
    start = {s: F.col(a) - b // 2 for s, a, b in zip(STARTS, AXES, box, strict=True)}
    rows = voxels.filter(mask).withColumns({**start, **{s: F.lit(b).cast("long") for s, b in zip(SIZES, box, strict=True)}})
    fits = [(F.col(s) >= 0) & (F.col(s) + b <= n) for s, b, n in zip(STARTS, box, size, strict=True)]
    return rows.filter(fits[0] & fits[1] & fits[2])


def in_raster_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in each volume's raster order: within slices, after the slices before."""
    counts = rows.groupBy("volume_id", "z").agg(F.count(F.lit(1)).alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.partitionBy("volume_id").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("volume_id", "z", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy("volume_id", "z").orderBy("y", "x")) - 1
    return rows.withColumn("_within", within).join(starts, ["volume_id", "z"]).withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_start", "_within")


def dense_rois(voxels: DataFrame, box: tuple[int, int, int], size: tuple[int, int, int], mask: str = "m", by_place: bool = False) -> DataFrame:
    """A box for every voxel in the mask that has room, numbered in raster order.

    ``by_place`` numbers a box by its voxel's raster place instead of by rank, which
    needs neither sort nor shuffle.
    """
    found = candidates(voxels, box, size, F.col(mask) != 0)
    if by_place:
        place = (F.col("z") * size[1] + F.col("y")) * size[0] + F.col("x")
        return found.withColumn("roi_id", place).select("volume_id", "roi_id", *STARTS, *SIZES)
    return in_raster_order(found, "roi_id").select("volume_id", "roi_id", *STARTS, *SIZES)


def place_draw(seed: int) -> Column:
    """A reproducible draw from a voxel's place: MD5 mixes it, so the least draws are spread evenly over a volume."""
    return F.md5(F.concat_ws(",", "x", "y", "z", F.lit(seed)).cast("binary"))


def drawn_number(*parts) -> Column:
    """A number of 60 bits drawn by hash from these columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def random_rois(voxels: DataFrame, n: int, box: tuple[int, int, int], size: tuple[int, int, int], mask: str = "m", seed: int = 1, by: str | None = None) -> DataFrame:
    """n boxes of each volume, or of each value of ``by``, around voxels drawn by hash, without putting back.

    The first n of a group by hash are found by a ranked window with a limit, which
    keeps n rows of each task before the shuffle.  An empty choice is an error.
    """
    rows = candidates(voxels, box, size, F.col(mask) != 0).withColumn("draw", place_draw(seed))
    keys = ["volume_id", *([by] if by else [])]
    order = [F.col("draw"), F.col("z"), F.col("y"), F.col("x")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.select("volume_id", *([by] if by else []), (F.col("rank") - 1).cast("long").alias("roi_id"), *STARTS, *SIZES)


def drawn_again(voxels: DataFrame, n: int, seed: int, times: Column | None = None) -> DataFrame:
    """n draws of each volume's voxels with putting back: (volume_id, draw_id, again, x, y, z, other columns of the voxel drawn).

    The i-th draw takes the voxel whose rank in raster order a hash of i names; ranks are
    looked up in bitmaps, no voxel is sorted.  ``times`` is an array column of names for
    which all draws are made anew, one row each.
    """
    strips = strips_of(voxels)
    count = strips.groupBy("volume_id").agg(F.sum("n").alias("count"))
    asked = count.withColumn("again", F.explode(F.array(F.lit(0)) if times is None else times)).withColumn("draw_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    item = F.col("again").cast("long") * n + F.col("draw_id")
    found = at_ranks(strips, asked.select("volume_id", item.alias("item"), (drawn_number("draw_id", "again", F.lit(seed)) % F.col("count")).alias("rank")))
    drawn = found.select("volume_id", (F.col("item") % n).alias("draw_id"), F.expr(f"cast(item div {n} AS int)").alias("again"), *AXES)
    return drawn.join(voxels, ["volume_id", *AXES]) if set(voxels.columns) - {"volume_id", *AXES} else drawn


def random_rois_again(voxels: DataFrame, n: int, box: tuple[int, int, int], size: tuple[int, int, int], mask: str = "m", seed: int = 1) -> DataFrame:
    """n boxes of each volume, drawn with putting back."""
    drawn = drawn_again(candidates(voxels, box, size, F.col(mask) != 0).select("volume_id", *AXES), n, seed)
    starts = [(F.col(a) - b // 2).alias(s) for s, a, b in zip(STARTS, AXES, box, strict=True)]
    return drawn.select("volume_id", F.col("draw_id").alias("roi_id"), *starts, *[F.lit(b).cast("long").alias(s) for s, b in zip(SIZES, box, strict=True)])


def roi_voxels(rois: DataFrame, voxels: DataFrame, brick: int = BRICK) -> DataFrame:
    """Voxels of each box, with their places within it (dx, dy, dz).

    A box meets only the voxels of the bricks that it touches: an equi-join on brick,
    with the exact bounds left as a filter.
    """
    r = rois
    for a, s, n in zip(AXES, STARTS, SIZES, strict=True):
        r = r.withColumn(f"b{a}", F.explode(F.sequence(F.expr(f"{s} div {brick}"), F.expr(f"({s} + {n} - 1) div {brick}"))))
    v = voxels.withColumns({f"b{a}": F.expr(f"{a} div {brick}") for a in AXES})
    joined = r.join(v, ["volume_id", "bx", "by", "bz"])
    inside = reduce(lambda p, q: p & q, [(F.col(a) >= F.col(s)) & (F.col(a) < F.col(s) + F.col(n)) for a, s, n in zip(AXES, STARTS, SIZES, strict=True)])
    return joined.filter(inside).withColumns({f"d{a}": F.col(a) - F.col(s) for a, s in zip(AXES, STARTS, strict=True)}).drop("bx", "by", "bz")


def same_size(rois: DataFrame) -> DataFrame:
    """The boxes, which must be of one size, or it is an error; there may be none."""
    one = rois.agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_{c}") for c in SIZES])
    # Where sizes are literals the optimizer checks the one row by itself, which has no sizes if there are no boxes.
    even = [(F.col("_n") == 0) | (F.col(c) == F.col(f"_{c}")) for c in SIZES]
    # One row.
    checked = rois.join(F.broadcast(one)).withColumn(SIZES[0], F.when(even[0] & even[1] & even[2], F.col(SIZES[0])).otherwise(F.raise_error(F.lit("regions are of different sizes"))))
    return checked.select(*rois.columns)


def flattened(rois: DataFrame, voxels: DataFrame, value: str = "v") -> DataFrame:
    """(volume_id, roi_id, values): each box's values in raster order, x fastest; boxes of different sizes are an error."""
    cells = roi_voxels(same_size(rois), voxels).groupBy("volume_id", "roi_id").agg(F.sort_array(F.collect_list(F.struct("dz", "dy", "dx", F.col(value).alias("value")))).alias("cells"))
    return cells.select("volume_id", "roi_id", F.col("cells.value").alias("values"))


#: Labels that are counted in one pass of sums, and those that are counted so at most; more are joined.
LABELS_AT_ONCE, MOST_LABELS = 32, 1024


def labels(rois: DataFrame, voxels: DataFrame, label: str = "m", ignore: list[int] | None = None, dominant: int = -1, by_sums: bool | None = None) -> DataFrame:
    """The most frequent label of each box; of equally frequent ones the smallest.

    Ignored labels count as 0 times.  A dominant label wins wherever it is, and so
    does one that is ignored too.  ``by_sums`` counts labels from the corners of boxes
    in summed volumes, at a cost that doesn't depend on their sizes; by default it does
    where boxes have more voxels in all than the lattice.
    """
    ignore = ignore or []
    by_sums = worth_summing(rois, voxels) if by_sums is None else by_sums
    known = sorted(r[0] for r in voxels.select(F.col(label).cast("int")).distinct().limit(MOST_LABELS + 1).collect() if r[0] is not None) if by_sums else []
    counts = _summed_labels(rois, voxels, label, known) if by_sums and len(known) <= MOST_LABELS else roi_voxels(rois, voxels).groupBy("volume_id", "roi_id", F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(F.col("label").isin(ignore), 0).otherwise(F.col("n")) if ignore else F.col("n")
    mode = counts.withColumn("seen", seen).groupBy("volume_id", "roi_id").agg(F.max_by("label", F.struct("seen", -F.col("label"))).alias("mode"), F.bool_or(F.col("label") == dominant).alias("there"))
    wins = F.lit(True) if dominant in ignore and dominant > -1 else F.col("there") & F.lit(dominant > -1)
    return mode.select("volume_id", "roi_id", F.when(wins, F.lit(dominant)).otherwise(F.col("mode")).cast("int").alias("label"))


def _summed_labels(rois: DataFrame, voxels: DataFrame, label: str, known: list[int]) -> DataFrame:
    """(volume_id, roi_id, label, n) by sums of each known label's indicator."""
    parts = None
    for k in range(0, max(len(known), 1), LABELS_AT_ONCE):
        some = known[k : k + LABELS_AT_ONCE] or [0]
        found = box_sums_of(rois.select("volume_id", "roi_id", *STARTS, *SIZES), voxels, {f"n{i}": (F.col(label) == v).cast("long") for i, v in enumerate(some)})
        pairs = ", ".join(f"{v}, n{i}" for i, v in enumerate(some))
        part = found.selectExpr("volume_id", "roi_id", f"stack({len(some)}, {pairs}) AS (label, n)").filter("n > 0")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def coverage(rois: DataFrame, voxels: DataFrame, rounds: list[int], mask: str = "m") -> DataFrame:
    """After each round of so many boxes more: boxes, voxels visited, those in the mask, and their share of the mask.

    A voxel counts from the first round that visits it.
    """
    ends = [sum(rounds[: i + 1]) for i in range(len(rounds))]
    number = F.lit(len(rounds))
    for i in range(len(rounds) - 1, -1, -1):
        number = F.when(F.col("roi_id") < ends[i], i).otherwise(number)
    first = roi_voxels(rois, voxels).withColumn("round", number).filter(F.col("round") < len(rounds)).groupBy("volume_id", *AXES, mask).agg(F.min("round").alias("round"))
    per = first.groupBy("volume_id", "round").agg(F.count(F.lit(1)).alias("new"), F.sum((F.col(mask) != 0).cast("long")).alias("new_hits"))
    all_rounds = voxels.groupBy("volume_id").agg(F.sum((F.col(mask) != 0).cast("long")).alias("region")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(len(rounds) - 1))))
    w = Window.partitionBy("volume_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    whole = all_rounds.join(per, ["volume_id", "round"], "left")
    total = whole.withColumns({"visited": F.sum(F.coalesce("new", F.lit(0))).over(w), "hits": F.sum(F.coalesce("new_hits", F.lit(0))).over(w), "n_rois": F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("round") + 1)})
    return total.select("volume_id", "round", "n_rois", "visited", "hits", "region", F.when(F.col("region") > 0, F.col("hits") / F.when(F.col("region") > 0, F.col("region"))).alias("share"))


def kept_in_rois(voxels: DataFrame, rois: DataFrame, value: str = "v", outside: float = 0.0) -> DataFrame:
    """Voxels with their value where some box has them, else ``outside``."""
    inside = roi_voxels(rois, voxels.select("volume_id", *AXES)).select("volume_id", *AXES).distinct().withColumn("_in", F.lit(True))
    return voxels.join(inside, ["volume_id", *AXES], "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(outside))).drop("_in")


def box_histograms(voxels: DataFrame, box: tuple[int, int, int], bins: Column, n_bins: int, mask: str = "m") -> DataFrame:
    """Counts of each bin over the box around every voxel, as columns n0 .. n(n_bins - 1).

    Boxes of one size are sums of indicators along x, then y, then z: three window
    passes, whatever the size of the box.
    """
    names = [f"n{i}" for i in range(n_bins)]
    rows = voxels.withColumn("_bin", bins)
    rows = rows.withColumns({n: ((F.col("_bin") == i) & (F.col(mask) != 0)).cast("long") for i, n in enumerate(names)}).drop("_bin")
    for a, b in zip(AXES, box, strict=True):
        w = Window.partitionBy("volume_id", *[c for c in AXES if c != a]).orderBy(a).rowsBetween(-(b // 2), b - 1 - b // 2)
        rows = rows.withColumns({n: F.sum(n).over(w) for n in names})
    return rows


def overlap(voxels: DataFrame, one: Column, other: Column) -> DataFrame:
    """Voxels that are in both of two masks."""
    return voxels.filter(one & other)


def mask_values(voxels: DataFrame, mask: str = "m") -> DataFrame:
    """The different values of a mask."""
    return voxels.select(mask).distinct()
