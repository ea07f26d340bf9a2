import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import multiindex as mi

SF = "/root/testdata/sf0.1/embeddings.parquet"


def brute(ids, vectors, query, own, nearest=10):
    apart = np.sqrt(((vectors - query) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, apart)) if ids[i] != own][:nearest]
    return [(int(ids[i]), float(apart[i])) for i in order]


def test_recall_scores_and_order(spark):
    rows = spark.read.parquet(SF)
    table = rows.toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    got = {}
    for r in mi.op11_nearest_vectors(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    reached = 0
    for q, found in got.items():
        vector = vectors[ids == q][0]
        assert [x[0] for x in found] == list(range(1, 11)) and [x[2] for x in found] == sorted(x[2] for x in found)
        for _, i, score in found:
            assert score == np.sqrt(((vectors[ids == i][0] - vector) ** 2).sum())
        reached += len({x[1] for x in found} & {i for i, _ in brute(ids, vectors, vector, q)})
    assert reached >= 0.95 * 10 * len(got)


@pytest.mark.parametrize("bits,substrings", [(64, 2), (128, 4)])
def test_every_code_within_the_radius_is_found_once(bits, substrings):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=(400, 24)), np.repeat(rng.normal(size=(3, 24)), 40, 0) + rng.normal(size=(120, 24)) * 0.01])
    model = mi.Model(vectors, len(vectors), 9, bits, substrings)
    codes = model.codes(vectors)
    dealt = model.blocks_of(codes, rng.integers(0, 1000, len(vectors)))
    for radius in (0, 1, 5, model.radius, bits):
        reach = mi.reach_of(radius, substrings)
        for q in range(0, len(vectors), 37):
            found = []
            for block in model.asked(codes[q], reach):
                j = block // (len(model.edges[0]) + 1)
                for i in np.flatnonzero(dealt[:, j] == block):
                    near = [int(x) <= r for x, r in zip(np.bitwise_count(codes[i].view(np.uint32) ^ codes[q].view(np.uint32)), reach, strict=True)]
                    if mi.differing(codes[i : i + 1], codes[q])[0] <= radius and near[j] and not any(near[:j]):
                        found.append(int(i))
            assert sorted(found) == np.flatnonzero(mi.differing(codes, codes[q]) <= radius).tolist()


def made(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, query string").repartition(4)


def asked(df, nearest=10):
    got = {}
    for r in mi.nearest_vectors(df, F.col("vec_id") % 100 == 0, nearest).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_a_vector_that_a_third_of_all_rows_have(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=8).astype(np.float32)
    vectors = np.array([common if i % 3 == 0 else rng.normal(size=8) for i in range(900)], np.float32).astype(float)
    got = asked(made(spark, [(i, v.tolist(), 0, None) for i, v in enumerate(vectors)]))
    ids = np.arange(900)
    assert len(got) == 9
    for q in (0, 300, 600):
        assert got[q] == brute(ids, vectors, vectors[q], q) and got[q][-1][1] == 0.0
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in brute(ids, vectors, vectors[q], q)}) for q in got) >= 85


def test_odd_rows(spark):
    odd = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0])]
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-0.0, 1.0]), (None, [0.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (200, [5.0, 5.0]), (200, [5.0, 6.0])]
    df = made(spark, [(i, v, 0, "q") for i, v in odd + rows])
    got = asked(df)
    assert sorted(got) == [0, 200]
    assert [i for i, _ in got[0]] == [3, 1, 2, None, 200, 200] and got[0][1][1] == pytest.approx(2**0.5)
    assert len(got[200]) == 10 and {i for i, _ in got[200]} == {0, 1, 2, 3, None}
    assert asked(df.filter("vec_id BETWEEN 100 AND 105")) == {} and asked(df.limit(0)) == {}
    assert asked(df.filter("vec_id = 0")) == {} and asked(made(spark, [(0, [1.0, 1e-200], 0, None), (1, [1.0, 2e-200], 0, None)], "double")) == {0: [(1, 0.0)]}


def test_far_queries_find_all_that_there_is(spark):
    rng = np.random.default_rng(6)
    near = rng.normal(size=(300, 16)) * 0.01 + 5
    vectors = np.concatenate([[np.full(16, -40.0)], near])
    got = asked(made(spark, [(i, v.tolist(), 0, None) for i, v in enumerate(vectors)], "double"))
    assert len(got[0]) == 10 and [i for i, _ in got[0]] == [i for i, _ in brute(np.arange(301), vectors, vectors[0], 0)]


def test_more_dimensions_than_vectors():
    rng = np.random.default_rng(9)
    for n, d in ((1, 3), (2, 500), (40, 300), (300, 40)):
        model = mi.Model(rng.normal(size=(n, d)), n, 1)
        assert model.codes(rng.normal(size=(5, d))).shape == (5, 16) and 0 <= model.radius <= 128
