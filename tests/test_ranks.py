import random

import numpy as np

from voxelloom.operators.ranks import at_ranks, strips_of
from voxelloom.operators.roi import drawn_again


def test_every_rank(spark):
    rng = random.Random(1)
    places = {v: sorted({(rng.randrange(3), rng.randrange(70), rng.randrange(w)) for _ in range(400)}) for v, w in (("a", 5), ("b", 90), ("c", 1000))}
    rows = [(v, x, y, z) for v, found in places.items() for z, y, x in found]
    rng.shuffle(rows)
    strips = strips_of(spark.createDataFrame(rows, "volume_id string, x long, y long, z long").repartition(7))
    assert {r.volume_id: (r.n, r.k) for r in strips.groupBy("volume_id").agg({"n": "sum", "start": "max"}).toDF("volume_id", "n", "k").collect()}.keys() == places.keys()
    asked = [(v, i, k) for v, found in places.items() for i, k in enumerate([*range(len(found)), 0, 0, len(found) - 1])]
    got = {(r.volume_id, r.item): (r.z, r.y, r.x) for r in at_ranks(strips, spark.createDataFrame(asked, "volume_id string, item long, rank long")).collect()}
    assert got == {(v, i): places[v][k] for v, i, k in asked}


def test_draws_are_even_and_sort_no_voxel(spark):
    voxels = spark.range(4000).selectExpr("'v' AS volume_id", "id % 20 AS x", "id div 20 % 20 AS y", "id div 400 AS z", "cast(id % 2 AS int) AS m").filter("m = 1")
    drawn = drawn_again(voxels, 3000, 5)
    rows = drawn.collect()
    assert len(rows) == 3000 and all(r.x % 2 == 1 for r in rows) and {r.draw_id for r in rows} == set(range(3000))
    counts = np.bincount([r.z for r in rows], minlength=10)
    assert abs(counts - 300).max() < 90
    assert drawn_again(voxels.filter("m = 7"), 5, 1).collect() == []
