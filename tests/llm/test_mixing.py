from collections import defaultdict

from voxelloom.llm.mixing import mix, op3_mix_sources


def targets(sizes):
    """Share again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest = whole - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 2.0 * sizes[s] for s in over}


def check(rows, docs):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert t - 1 - 1e-6 <= taken[s] <= t + 1e-6
    again = {(r.doc_id, r.taken) for r in op3_mix_sources(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    check(rows, docs)
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    assert {r.doc_id: r.size for r in mix(docs).collect()} == sizes


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 50), ["a", "b", None, "Z", "é"][i % 5], "x") for i in range(400)] + [(1000, None, "empty", None), (1001, "", "empty", "y"), (1002, " v " * 50_000, "big", None), (None, "a b", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    check(rows, docs)
    assert mix(docs.limit(0)).collect() == []
    assert [r.taken for r in mix(docs.filter("source = 'empty'")).collect()] == [0, 0]
