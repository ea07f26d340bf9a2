import numpy as np
import pytest

from voxelloom.operators.resample import index_map, resampled_onto


def brute(grid, new, a, b, order, outside):
    out = np.full(new, outside)
    for i in np.ndindex(*new):
        p = np.round(a @ np.array(i) + b, 9)
        if (p < 0).any() or (p > np.array(grid.shape) - 1).any():
            continue
        if order == 0:
            out[i] = grid[tuple(np.floor(p + 0.5).astype(int))]
            continue
        low, total = np.floor(p).astype(int), 0.0
        for c in np.ndindex(2, 2, 2):
            w = np.prod([p[k] - low[k] if c[k] else 1 - (p[k] - low[k]) for k in range(3)])
            if w:
                total += w * grid[tuple(low + c)]
        out[i] = total
    return out


def turned(*angles):
    m = np.eye(3)
    for k, t in enumerate(angles):
        r, (i, j) = np.eye(3), [(1, 2), (0, 2), (0, 1)][k]
        r[i, i] = r[j, j] = np.cos(t)
        r[i, j], r[j, i] = -np.sin(t), np.sin(t)
        m = m @ r
    return m.tolist()


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("direction", [turned(0.3, -0.7, 1.1), turned(0, 0, np.pi / 2), turned(np.pi, 0, 0)])
def test_against_every_place(spark, order, direction):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(9, 11, 6))
    rows = [("v", *map(int, i), float(grid[i])) for i in np.ndindex(*grid.shape)]
    voxels = spark.createDataFrame(rows, "volume_id string, x long, y long, z long, v double")
    a, b = index_map({"origin": [0, 0, 0], "spacing": [1, 1, 1]}, {"origin": [6.0, 5.0, 1.0], "spacing": [0.5, 0.75, 2.0], "direction": direction})
    new = (13, 10, 5)
    want = brute(grid, new, a, b, order, -7.0)
    got = np.full(new, np.nan)
    for r in resampled_onto(voxels, grid.shape, new, a, b, order=order, outside=-7.0, side=4).collect():
        got[r.x, r.y, r.z] = r.v
    assert np.allclose(got, want, atol=1e-9) and (want != -7.0).sum() > 10


def test_a_target_that_touches_nothing(spark):
    voxels = spark.createDataFrame([("v", 0, 0, 0, 1.0)], "volume_id string, x long, y long, z long, v double")
    far = resampled_onto(voxels, (1, 1, 1), (3, 2, 1), np.eye(3), [50.0, 0.0, 0.0], outside=2.0)
    assert sorted((r.x, r.y, r.z, r.v) for r in far.collect()) == [(x, y, 0, 2.0) for x in range(3) for y in range(2)]
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
