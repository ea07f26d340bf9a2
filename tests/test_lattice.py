import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import bag, distance, integral, lattice, roi, stencil
from voxelloom.plans import tools

SIZE = (7, 6, 5)
rng = np.random.default_rng(4)
V = rng.normal(size=SIZE[::-1]) * 10
M = rng.integers(0, 3, SIZE[::-1])


@pytest.fixture(scope="module")
def voxels(spark):
    rows = [("a", x, y, z, float(V[z, y, x]), int(M[z, y, x]), 0.5) for z in range(SIZE[2]) for y in range(SIZE[1]) for x in range(SIZE[0])]
    return spark.createDataFrame(rows, "volume_id string, x long, y long, z long, v double, m int, p double").cache()


def grid(df, name):
    out = np.full(SIZE[::-1], np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


def shift(a, axis, k):
    i = np.clip(np.arange(a.shape[axis]) + k, 0, a.shape[axis] - 1)
    return np.take(a, i, axis)


def d(a, axis, order=1):
    return (shift(a, axis, 1) - shift(a, axis, -1)) / 2 if order == 1 else shift(a, axis, 1) - 2 * a + shift(a, axis, -1)


def smooth(a, sigma, width=4.0):
    k = stencil.gaussian_kernel(sigma, 1.0, width)
    for axis in (2, 1, 0):
        a = sum(w * shift(a, axis, i - len(k) // 2) for i, w in enumerate(k))
    return a


def features(sigma):
    mask = (M != 0).astype(float)
    b = smooth(V * mask, sigma) / smooth(mask, sigma)
    h = np.empty((*b.shape, 3, 3))
    for i, p in enumerate((2, 1, 0)):
        for j, q in enumerate((2, 1, 0)):
            h[..., i, j] = d(b, p, 2) if i == j else d(d(b, p), q)
    e = np.linalg.eigvalsh((h + np.swapaxes(h, -1, -2)) / 2)
    e = np.take_along_axis(e, np.argsort(-np.abs(e), axis=-1), -1)
    g = np.sqrt(sum(d(b, a) ** 2 for a in range(3)))
    return [x * mask for x in (b, g, e[..., 0], e[..., 1], e[..., 2], e.sum(-1), e.prod(-1), np.sqrt((e**2).sum(-1)))]


@pytest.mark.parametrize("sigma", [0.6, 4.0])
def test_features(voxels, sigma):
    got = stencil.features(voxels, [sigma]).cache()
    for name, want in zip(stencil.FEATURES, features(sigma), strict=True):
        assert np.allclose(grid(got, name), want, atol=1e-6), name
    rows = stencil.feature_rows(got)
    assert rows.count() == 8 * V.size and {r.hist_idx for r in rows.select("hist_idx").distinct().collect()} == set(range(8))


def test_rois_and_histograms(voxels):
    box = (3, 2, 3)
    rois = roi.dense_rois(voxels, box, SIZE)
    want = [(x - 1, y - 1, z - 1) for z in range(SIZE[2]) for y in range(SIZE[1]) for x in range(SIZE[0]) if M[z, y, x] and 0 <= x - 1 and x + 2 <= SIZE[0] and 0 <= y - 1 and y + 1 <= SIZE[1] and 0 <= z - 1 and z + 2 <= SIZE[2]]
    assert [(r.x0, r.y0, r.z0) for r in rois.orderBy("roi_id").collect()] == want
    edges = [-5.0, 0.0, 5.0]
    long = bag.intensity_bag(rois, voxels, edges)
    cut = lambda a, i: a[want[i][2] : want[i][2] + 3, want[i][1] : want[i][1] + 2, want[i][0] : want[i][0] + 3]
    counts = {(r.roi_id, r.bin): (r.n, r.freq) for r in long.collect()}
    for i in range(len(want)):
        n = np.bincount(np.searchsorted(edges, cut(V, i)[cut(M, i) != 0], "left"), minlength=4)
        assert [counts[i, b][0] for b in range(4)] == n.tolist() and np.allclose([counts[i, b][1] for b in range(4)], n / n.sum())
    by_place = {(r.roi_id, r.bin): r.n for r in bag.dense_intensity_bag(voxels, box, SIZE, edges).collect()}
    assert sorted(by_place.values()) == sorted(n for n, _ in counts.values()) and len(by_place) == len(counts)
    flat = roi.flattened(rois, voxels).orderBy("roi_id").collect()
    assert all(np.allclose(r["values"], cut(V, i).ravel()) for i, r in enumerate(flat))
    got = {r.roi_id: r.label for r in roi.labels(rois, voxels, ignore=[1], dominant=2).collect()}
    for i in range(len(want)):
        n = np.bincount(cut(M, i).ravel(), minlength=3)
        n[1] = 0
        assert got[i] == (2 if n[2] else int(n.argmax()))
    small = {(r.volume_id, r.roi_id) for r in roi.roi_voxels(rois, voxels, brick=2).collect()}
    assert roi.roi_voxels(rois, voxels, brick=2).count() == roi.roi_voxels(rois, voxels).count() and len(small) == len(want)


def test_bag_of_features(spark, voxels):
    rois = tools.generate_rois(voxels, SIZE, 4, (3, 3, 3), mask_value=None)
    spec = tools.determine_edges(voxels, [0.6], 5, samples=60)
    assert spec.count() == 8 and all(len(r.edges) == 4 for r in spec.collect())
    arrays = bag.as_arrays(tools.make_bag(voxels, spec, [0.6], rois, SIZE), rois, 8, 5).collect()
    assert len(arrays) == 4 and all(len(r.features) == 40 and np.allclose(np.array(r.features).reshape(8, 5).sum(1), 1) for r in arrays)
    empty = spark.createDataFrame([("a", 9, 0, 0, 0, 1, 1, 1)], rois.schema)
    none = bag.as_arrays(tools.make_bag(voxels.withColumn("m", F.lit(0)), spec, [0.6], empty, SIZE), empty, 8, 5).first()
    assert np.isnan(none.features).all()


def test_saved_dataset(spark, tmp_path):
    found = spark.createDataFrame([("b", 1, [1.0]), ("a", 2, [2.0]), ("a", 1, [3.0])], "bag string, roi_id long, features array<double>")
    marks = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("b", 1, 7.0)], "bag string, roi_id long, label double")
    named = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "bag string, label double")
    instances, known = tools.assemble_dataset(found, named, marks)
    tools.save_dataset(instances, known, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "instances")).orderBy("inst_idx").collect()
    assert [(r.inst_idx, r.bag_idx, r.features, r.label) for r in got] == [(0, 0, [3.0], 5.0), (1, 0, [2.0], 6.0), (2, 1, [1.0], 7.0)]
    assert [(r.bag, r.n_instances, r.label) for r in spark.read.parquet(str(tmp_path / "bags")).orderBy("bag").collect()] == [("a", 2, 1.0), ("b", 1, 2.0)]
    plain = tools.assemble_dataset(found)
    assert [r.label for r in plain[0].collect()] == [0.0] * 3 and [r.label for r in plain[1].collect()] == [None] * 2


def test_counts_of_labels_are_checked(spark):
    found = spark.createDataFrame([("b", 1, [1.0]), ("a", 2, [2.0])], "bag string, roi_id long, features array<double>")
    for labels in ([("a", 1.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 1.0), ("a", 2.0), ("b", 1.0)]):
        with pytest.raises(Exception, match="label"):
            tools.assemble_dataset(found, spark.createDataFrame(labels, "bag string, label double"))[1].collect()
    with pytest.raises(Exception, match="label"):
        tools.assemble_dataset(found, None, spark.createDataFrame([("a", 2, 1.0)], "bag string, roi_id long, label double"))[0].collect()


def test_draws_are_spread_evenly(spark):
    # The least draws of all places of a large volume, over its slices, halves and residues.
    size = (256, 256, 200)
    least = lattice.empty_volume(spark, size).withColumn("draw", roi.place_draw(1)).orderBy("draw").limit(4000).collect()
    for of, cells in ((lambda r: r.z // 10, 20), (lambda r: r.y // 16, 16), (lambda r: r.x % 16, 16), (lambda r: (r.x + r.y + r.z) % 7, 7)):
        count = np.bincount([of(r) for r in least], minlength=cells)
        assert ((count - 4000 / cells) ** 2 / (4000 / cells)).sum() < cells - 1 + 4 * np.sqrt(2 * (cells - 1))
    again = np.array([r.n for r in spark.range(6000).select((roi.drawn_number("id", F.lit(0), F.lit(1)) % 30).alias("n")).collect()])
    count = np.bincount(again, minlength=30)
    assert ((count - 200) ** 2 / 200).sum() < 29 + 4 * np.sqrt(58)


def test_regions_of_different_sizes(spark, voxels):
    rois = spark.createDataFrame([("v", 0, 0, 0, 0, 2, 2, 2), ("v", 1, 0, 0, 0, 2, 2, 3)], "volume_id string, roi_id long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    with pytest.raises(Exception, match="different sizes"):
        roi.flattened(rois, voxels).collect()


def test_envelopes():
    rng = np.random.default_rng(8)
    height = np.where(rng.random((60, 23)) < 0.4, rng.integers(0, 90, (60, 23)).astype(float), np.inf)
    height[3], height[4, 1:] = np.inf, np.inf
    i = np.arange(23)
    for step in (1.0, 0.7):
        want = ((step * (i[:, None] - i[None, :])) ** 2 + height[:, None, :]).min(axis=2)
        assert np.allclose(distance.envelopes(height, step), want)


def test_samples_with_putting_back(spark, voxels):
    drawn = roi.drawn_again(voxels.filter("v > 4"), 500, 3, F.array(F.lit(0), F.lit(1))).collect()
    assert len(drawn) == 1000 and all(r.v > 4 for r in drawn)
    by = [[(r.x, r.y, r.z) for r in sorted(drawn, key=lambda r: r.draw_id) if r.again == k] for k in (0, 1)]
    assert by[0] != by[1] and len(set(by[0])) < 500
    spec = tools.determine_edges(voxels.withColumn("m", F.lit(1)), [0.5, 0.7], 3, samples=200).collect()
    assert len(spec) == 16 and all(len(r.edges) <= 2 for r in spec)


def test_bricks_give_what_windows_give(spark):
    rng = np.random.default_rng(11)
    size = (70, 37, 5)
    rows = [("v", x, y, z, float(rng.normal()), int(rng.random() < 0.8)) for x in range(size[0]) for y in range(size[1]) for z in range(size[2])]
    voxels = spark.createDataFrame(rows, "volume_id string, x long, y long, z long, v double, m int")
    got = stencil.features(voxels, [0.8], spacing=(1.0, 0.5, 2.0)).toPandas().sort_values(["x", "y", "z"])
    binary = voxels.withColumn("_m", F.col("m").cast("double"))
    blur = stencil.normalized_convolution(binary, "v", "_m", 0.8, stencil.FEATURES[0], (1.0, 0.5, 2.0))
    d = stencil.derivatives(blur, stencil.FEATURES[0], (1.0, 0.5, 2.0)).toPandas().sort_values(["x", "y", "z"])
    inside = got["m"].to_numpy() != 0
    assert np.allclose(got["GaussianBlur"][inside], d["GaussianBlur"][inside])
    assert np.allclose(got["GradientMagnitude"][inside], np.sqrt(d["dx"] ** 2 + d["dy"] ** 2 + d["dz"] ** 2)[inside])
    assert np.allclose(got["LaplacianOfGaussian"][inside], (d["hxx"] + d["hyy"] + d["hzz"])[inside])
    assert not got[list(stencil.FEATURES)].to_numpy()[~inside].any()


def test_distance(voxels):
    target = V > 12
    got = grid(distance.squared_distance(voxels, F.col("v") > 12), "d2")
    places = np.argwhere(target)
    for p in np.ndindex(V.shape):
        assert got[p] == ((places - p) ** 2).sum(axis=1).min()
    assert np.isinf(grid(distance.squared_distance(voxels, F.lit(False)), "d2")).all()


def test_geometry(voxels):
    out = lattice.padded(voxels.select(*lattice.KEYS, "v"), SIZE, (10, 7, 5), {"v": 0.0})
    got = np.zeros((5, 7, 10))
    for r in out.collect():
        got[r.z, r.y, r.x] = r.v
    assert np.allclose(got, np.pad(V, ((0, 0), (0, 1), (1, 2))))
    with pytest.raises(ValueError):
        lattice.padded(voxels, SIZE, (6, 6, 5), {"v": 0.0})
    assert lattice.slice_indices(10, locations=[0.5, 2.0], window=4, stride=0) == [3, 4, 5, 6, 7]
    assert lattice.slice_indices(4) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        lattice.slice_indices(4, indices=[4])
    fine = tools.resample(voxels, SIZE, (13, 6, 5), (0.5, 1.0, 1.0))
    want = np.empty((5, 6, 13))
    want[..., ::2], want[..., 1::2] = V, (V[..., 1:] + V[..., :-1]) / 2
    got = np.empty((5, 6, 13))
    for r in fine.collect():
        got[r.z, r.y, r.x] = r.v
    assert np.allclose(got, want)
    box = lattice.bounding_box(voxels.withColumn("m", F.when((F.col("x") == 2) & F.col("y").between(1, 3), 1).otherwise(0))).first()
    assert (box.min_x, box.max_x, box.min_y, box.max_y, box.min_z, box.max_z) == (2, 2, 1, 3, 0, 4)


def test_coverage(voxels):
    got = tools.roi_coverage(voxels, SIZE, (3, 3, 3), [2, 3]).orderBy("round").collect()
    rois = roi.random_rois(voxels, 5, (3, 3, 3), SIZE).collect()
    for r, n in zip(got, (2, 5), strict=True):
        seen = np.zeros(V.shape, bool)
        for b in (b for b in rois if b.roi_id < n):
            seen[b.z0 : b.z0 + 3, b.y0 : b.y0 + 3, b.x0 : b.x0 + 3] = True
        assert (r.visited, r.hits, r.region) == (seen.sum(), (seen & (M != 0)).sum(), (M != 0).sum())


def test_recursive_smoothing():
    for sigma in (0.6, 1.0, 2.4, 5.0):
        one, other = np.array(stencil.gaussian_kernel(sigma)), np.array(stencil.recursive_kernel(sigma))
        assert abs(other.sum() - 1) < 1e-12 and len(other) > len(one)
        wide = np.zeros(len(other))
        at = (len(other) - len(one)) // 2
        wide[at : at + len(one)] = one
        # What smoothing a step or a line of up to 1 can differ by.
        assert np.abs(other - wide).sum() < 6e-3

    # A recursion of fourth order, forward and backward, on a line whose ends repeat.
    rng, sigma = np.random.default_rng(5), 1.7
    line = np.pad(rng.normal(size=40), 200, "edge")
    poles = np.exp([(d + s * 1j * w) / sigma for _, _, w, d in stencil._RECURSIVE for s in (1, -1)])
    down = np.real(np.poly(poles))
    at = np.arange(4) / sigma
    first = sum((a * np.cos(w * at) + b * np.sin(w * at)) * np.exp(d * at) for a, b, w, d in stencil._RECURSIVE)
    up = [sum(down[j] * first[i - j] for j in range(i + 1)) for i in range(4)]

    def forward(x):
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = sum(up[k] * x[i - k] for k in range(min(i, 3) + 1)) - sum(down[k] * y[i - k] for k in range(1, min(i, 4) + 1))
        return y

    both = forward(line) + forward(line[::-1])[::-1] - first[0] * line
    gain = 2 * sum(up) / sum(down) - first[0]
    kernel = stencil.recursive_kernel(sigma, least=1e-9)
    assert np.allclose(np.convolve(line, kernel, "same")[200:240], (both / gain)[200:240], atol=1e-6)


def test_recursive_features(spark, voxels):
    one = stencil.features(voxels, [0.7]).toPandas().sort_values(["x", "y", "z"])
    other = stencil.features(voxels, [0.7], recursive=True).toPandas().sort_values(["x", "y", "z"])
    scale = one["GaussianBlur"].abs().max()
    assert 0 < (one["GaussianBlur"] - other["GaussianBlur"]).abs().max() < 0.02 * scale


def test_recursion_over_lines_is_the_impulse_response(spark, voxels):
    rng = np.random.default_rng(8)
    grid = rng.normal(size=(5, 60, 4))
    for sigma, step in ((0.6, 1.0), (3.0, 0.7), (25.0, 1.0)):
        kernel = np.array(stencil.recursive_kernel(sigma, step, least=1e-12))
        radius = len(kernel) // 2
        padded = np.pad(grid, [(0, 0), (radius, radius), (0, 0)], "edge")
        want = np.stack([[np.convolve(padded[i, :, k], kernel, "valid") for k in range(4)] for i in range(5)]).transpose(0, 2, 1)
        assert np.abs(stencil.recursive_lines(grid, 1, sigma, step) - want).max() < 1e-5
    both = stencil.recursive_smooth(voxels, {"a": ("v", 1.0), "b": ("v", 40.0)})
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    one = stencil.gaussian_smooth(voxels, ["v"], 40.0, recursive=True).toPandas().set_index(["x", "y", "z"])["v"]
    assert np.allclose(both.toPandas().set_index(["x", "y", "z"])["b"].sort_index(), one.sort_index())


def test_labels_and_histograms_by_sums_and_by_join(spark):
    rng = np.random.default_rng(11)
    rows = [("v", x, y, z, float(rng.integers(0, 9)), int(rng.integers(0, 40))) for x in range(9) for y in range(7) for z in range(5)]
    voxels = spark.createDataFrame(rows, "volume_id string, x long, y long, z long, v double, m int")
    boxes = [("v", i, *(int(rng.integers(-2, n)) for n in (9, 7, 5)), *(int(rng.integers(1, 9)) for _ in range(3))) for i in range(25)]
    rois = spark.createDataFrame(boxes, "volume_id string, roi_id long, x0 long, y0 long, z0 long, sx long, sy long, sz long")
    inside = rois.filter("x0 >= 0 AND y0 >= 0 AND z0 >= 0")
    # More labels than one pass counts.
    one, other = (roi.labels(inside, voxels, ignore=[3], by_sums=s) for s in (True, False))
    assert sorted(one.collect()) == sorted(other.collect()) and one.count() > 2
    one, other = (bag.intensity_bag(inside, voxels, [2.0, 5.0], by_sums=s).fillna(-1.0) for s in (True, False))
    assert sorted(one.collect()) == sorted(other.collect())
    # A lattice with holes is joined, whatever the boxes.
    assert not integral.worth_summing(rois, voxels.filter("x <> 4")) and integral.worth_summing(rois.unionByName(rois), voxels)
