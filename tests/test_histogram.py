import random
from bisect import bisect_left

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxelloom.functions.pointwise import bin_index_of
from voxelloom.operators.histogram import determine_edges, distinct_edges, equalised_edges, frequencies, histogram, walked_edges

VALUES = [-1, 0, 0.5, 1, 1.5, 2.1, 2.6, 2.9, 3.2, 3.5, 4.2, 4.6, 5, 6, 7, 8, 9, 10]
EDGES = [1, 2.5, 3.0, 4.7, 6.2, 8.3]
COUNTS = [4, 2, 2, 4, 2, 2, 2]


def test_counts_and_frequencies(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in VALUES] + [("b", float("nan")), ("b", 99.0)], "k string, value double")
    counts = histogram(rows, ["k"], "value", EDGES)
    assert [r.n for r in counts.filter("k = 'a'").orderBy("bin").collect()] == COUNTS
    assert [r.n for r in counts.filter("k = 'b'").orderBy("bin").collect()] == [1, 0, 0, 0, 0, 0, 1]
    freq = frequencies(counts, ["k"]).filter("k = 'a'").orderBy("bin").collect()
    assert np.allclose([r.freq for r in freq], np.array(COUNTS) / 18)
    from pyspark.sql import functions as F

    bins = rows.select("value", bin_index_of(F.col("value"), F.array(*[F.lit(float(e)) for e in EDGES])).alias("b")).collect()
    assert all(r.b == (0 if r.value != r.value else bisect_left(EDGES, r.value)) for r in bins)


def runs(values):
    v = sorted(set(values))
    return v, [values.count(x) for x in v]


def test_edges_of_known_cases():
    assert equalised_edges(*runs(list(range(1, 10))), 3) == [4, 7]
    assert equalised_edges([1], [8], 2) == [1]
    assert equalised_edges([1, 2, 3], [5, 2, 3], 3) == [2, 3]
    with pytest.raises(ValueError):
        equalised_edges(*runs(list(range(1, 10))), 10)


def test_edges_of_random_values():
    rng = random.Random(7)
    values = sorted(rng.uniform(-10, 10) for _ in range(1000))
    edges = equalised_edges(values, [1] * 1000, 50)
    assert all(a < b for a, b in zip(edges, edges[1:], strict=False))
    sizes = np.bincount(np.searchsorted(edges, values, "right"))
    assert set(sizes) == {20}


def step_by_step(s, n_bins):
    """The walk over the sorted samples themselves."""
    n, at, surplus, deficit, out = len(s), 0, len(s) % n_bins, 0, []
    for k in range(n_bins - 1):
        step = n // n_bins
        if surplus:
            t = max(1, surplus // (n_bins - k))
            step, surplus = step + t, surplus - t
        elif deficit:
            t = min(step, max(1, deficit // (n_bins - k)))
            step, deficit = step - t, deficit - t
        at += step
        if at >= n:
            return None
        first = s.index(s[at])
        if first != at:
            after = at
            while after < n and s[after] == s[at]:
                after += 1
            if after == n:
                at = first
            elif at - first < after - at or at - first == after - at and deficit > 0:
                d, at = at - first, first
                surplus, deficit = (d - deficit, 0) if d > deficit else (surplus, deficit - d)
            else:
                d, at = after - at, after
                deficit, surplus = (d - surplus, 0) if d > surplus else (deficit, surplus - d)
        out.append(s[at])
    return out


@given(st.lists(st.integers(0, 25), min_size=5, max_size=150), st.integers(2, 8))
def test_edges_against_walk(values, n_bins):
    values.sort()
    if len(values) < n_bins:
        return
    want = step_by_step(values, n_bins)
    if want is None:
        with pytest.raises(ValueError):
            equalised_edges(*runs(values), n_bins)
    else:
        assert equalised_edges(*runs(values), n_bins) == want


def test_edges_in_tasks_and_walked(spark):
    rng = random.Random(3)
    rows = [(h, float(rng.randrange(400) if h else rng.random())) for h in range(3) for _ in range(500)]
    df = spark.createDataFrame(rows, "hist_idx int, value double")
    want = {(h, i, e) for h in range(3) for i, e in enumerate(step_by_step(sorted(v for g, v in rows if g == h), 9))}
    assert {tuple(r) for r in determine_edges(df, 9).collect()} == want
    counts = df.groupBy("hist_idx", "value").count().withColumnRenamed("count", "n")
    assert {tuple(r) for r in walked_edges(counts, 9, "hist_idx", "value").collect()} == want
    one = df.filter("hist_idx = 0")
    assert {(r.edge_idx, r.edge) for r in distinct_edges(one, 9, "value").collect()} == {(i, e) for h, i, e in want if h == 0}
