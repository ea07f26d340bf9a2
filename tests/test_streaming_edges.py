import random

from voxelloom.operators.histogram import equalised_edges
from voxelloom.streaming import edges


def test_edges_after_each_batch(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(h, float(rng.choice([rng.randrange(9), rng.random()]))) for h in (0, 1, 7) for _ in range(60)] for _ in range(3)]
    batches[1] += [(7, None), (0, -0.0), (0, 0.0)]
    every: dict = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "hist_idx int, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("hist_idx int, value double").parquet(str(tmp_path / "in"))
        edges.keep_runs(stream, str(tmp_path / "runs"), str(tmp_path / "state"), parts=3).awaitTermination()
        for h, v in rows:
            if v is not None:
                every.setdefault(h, {}).setdefault(v + 0.0, 0)
                every[h][v + 0.0] += 1
        got = {}
        for r in edges.edges_so_far(spark, str(tmp_path / "runs"), 5).orderBy("edge_idx").collect():
            got.setdefault(r.hist_idx, []).append(r.edge)
        assert got == {h: equalised_edges(sorted(c), [c[v] for v in sorted(c)], 5) for h, c in every.items()}
        # A batch tells on the values that it has, no others.
        told = spark.read.parquet(str(tmp_path / "runs")).filter(f"epoch = {k}")
        assert told.count() == len({(h, v + 0.0) for h, v in rows if v is not None})
    first = {(r.hist_idx, r.edge) for r in edges.edges_so_far(spark, str(tmp_path / "runs"), 5, upto=0).collect()}
    assert first != {(h, e) for h, es in got.items() for e in es}
