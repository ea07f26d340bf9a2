import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators.components import component_objects, labelled_components, least_members


def brute(mask, neighbours):
    """Labels by flooding, in raster order (x fastest)."""
    most = {6: 1, 18: 2, 26: 3}[neighbours]
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if 0 < abs(i) + abs(j) + abs(k) <= most]
    label, n = np.zeros(mask.shape, int), 0
    for z in range(mask.shape[2]):
        for y in range(mask.shape[1]):
            for x in range(mask.shape[0]):
                if mask[x, y, z] and not label[x, y, z]:
                    n += 1
                    label[x, y, z], todo = n, [(x, y, z)]
                    while todo:
                        p = todo.pop()
                        for d in around:
                            q = tuple(a + b for a, b in zip(p, d, strict=True))
                            if all(0 <= a < s for a, s in zip(q, mask.shape, strict=True)) and mask[q] and not label[q]:
                                label[q] = n
                                todo.append(q)
    return label


def rows_of(mask, volume):
    x, y, z = (i.ravel() for i in np.indices(mask.shape))
    return [(volume, int(a), int(b), int(c), int(mask[a, b, c])) for a, b, c in zip(x, y, z, strict=True)]


def snake(shape):
    """One long component that goes through all bricks and back again."""
    mask = np.zeros(shape, bool)
    for k in range(0, shape[2], 2):
        for j in range(0, shape[1], 2):
            mask[:, j, k] = True
            if j + 2 < shape[1]:
                mask[-1 if j % 4 == 0 else 0, j + 1, k] = True
        if k + 2 < shape[2]:
            mask[0, 0, k + 1] = True
    return mask


@pytest.mark.parametrize("neighbours,few", [(6, 10**6), (26, 0), (18, 5)])
def test_against_flooding(spark, neighbours, few):
    rng = np.random.default_rng(neighbours)
    masks = {"a": rng.random((11, 9, 7)) < (0.3 if neighbours == 6 else 0.12), "b": snake((13, 9, 5)), "c": np.zeros((3, 3, 3), bool)}
    voxels = spark.createDataFrame([r for k, m in masks.items() for r in rows_of(m, k)], "volume_id string, x long, y long, z long, m int")
    want = {k: brute(m, neighbours) for k, m in masks.items()}
    assert want["b"].max() == 1 and want["a"].max() > 10
    got = {(r.volume_id, r.label): tuple(r)[2:] for r in component_objects(voxels, neighbours=neighbours, side=4, few=few).collect()}
    there = {}
    for k, label in want.items():
        for i in range(1, label.max() + 1):
            at = np.nonzero(label == i)
            there[k, i] = (len(at[0]), *(int(f(p)) for p in at for f in (np.min, np.max)))
    assert got == there
    if neighbours == 6:
        labels = labelled_components(voxels, neighbours=6, side=4).collect()
        assert len(labels) == voxels.count() and all(r.label == want[r.volume_id][r.x, r.y, r.z] for r in labels)


def test_chains_of_links_are_contracted(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n)
    links = [("v", *sorted((int(order[i]), int(order[i + 1])))) for i in range(n - 1) if i % 100 != 99]
    roots = {r.node: r.root for r in least_members(spark.createDataFrame(links, "volume_id string, a long, b long"), few=3).collect()}
    assert roots == {int(k): int(order[i : i + 100].min()) for i in range(0, n, 100) for k in order[i : i + 100]}


def test_without_voxels(spark):
    voxels = spark.createDataFrame([("v", 0, 0, 0, 0)], "volume_id string, x long, y long, z long, m int")
    assert component_objects(voxels).collect() == [] and component_objects(voxels.filter(F.lit(False))).collect() == []
    assert [r.label for r in labelled_components(voxels).collect()] == [0]
