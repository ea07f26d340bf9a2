import random

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import brick_tables as bt
from voxelloom.operators import roi

SIZE = (40, 20, 9)


@pytest.fixture(scope="module")
def lattice(spark):
    voxels = spark.range(2 * SIZE[0] * SIZE[1] * SIZE[2]).selectExpr(
        f"CAST(id div {SIZE[0] * SIZE[1] * SIZE[2]} AS string) AS volume_id", f"id % {SIZE[0]} AS x", f"id div {SIZE[0]} % {SIZE[1]} AS y", f"id div {SIZE[0] * SIZE[1]} % {SIZE[2]} AS z", "cast(id * 7 % 101 AS double) AS v", "cast(id % 3 AS int) AS m"
    )
    image = bt.save_lattice(voxels.select("volume_id", "x", "y", "z", "v"), "brick_image", 4)
    mask = bt.save_lattice(voxels.select("volume_id", "x", "y", "z", "m"), "brick_mask", 4)
    return voxels, image, mask


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_image_and_mask_meet_without_exchange(lattice):
    voxels, image, mask = lattice
    both = bt.joined(image, mask)
    assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
    assert both.drop("brick").exceptAll(voxels).isEmpty() and both.count() == voxels.count()
    assert image.rdd.getNumPartitions() == 4


def test_boxes_go_to_the_voxels(spark, lattice):
    voxels, image, _ = lattice
    rng = random.Random(3)
    rows = [(str(i % 2), i, *[rng.randrange(-5, n) for n in SIZE], *[rng.randrange(1, 25) for _ in range(3)]) for i in range(30)]
    rois = spark.createDataFrame(rows, "volume_id string, roi_id long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    found = bt.boxed(rois, image)
    # Boxes are dealt to the buckets; the table isn't.
    plan = plan_of(found)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("brick_image") < plan.index("Exchange")
    columns = ["roi_id", "x", "y", "z", "dx", "dy", "dz", "v"]
    plain = rois.join(voxels, "volume_id").filter("x >= x0 AND x < x0 + sx AND y >= y0 AND y < y0 + sy AND z >= z0 AND z < z0 + sz").withColumns({f"d{a}": F.col(a) - F.col(f"{a}0") for a in "xyz"})
    assert sorted(found.select(columns).collect()) == sorted(plain.select(columns).collect())
    inside = rois.filter("x0 >= 0 AND y0 >= 0 AND z0 >= 0")
    assert bt.boxed(inside, image).count() == roi.roi_voxels(inside, voxels).count()


def test_z_order(spark):
    got = [r[0] for r in spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 2, 1), (1 << 19, 0, 0)], "x long, y long, z long").select(bt.z_order([F.col(a) for a in "xyz"])).collect()]
    assert got == [0, 1, 2, 4, 0b011101, 1 << 57]
