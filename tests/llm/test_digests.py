import hashlib
import re
import uuid
from collections import Counter

from voxelloom.llm import digests
from voxelloom.llm.digests import DigestIndex, deduplicate, op4_exact_dedup


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def test_odd_rows(spark):
    rows = [(1, "Abc", "x"), (2, "aBC", None), (3, "É", None), (4, "é", None), (5, None, "y"), (6, "", None), (7, "z" * 200_000, None), (None, "abc", None), (2, "aBC", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = op4_exact_dedup(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got if r.doc_id == 2) == 1
    by = {(r.doc_id, r.text_sha256): r for r in got}
    for doc, text, _ in rows:
        same = [d for d, t, _ in rows if lower(t) == lower(text)]
        r = by[doc, hashlib.sha256(lower(text).encode()).hexdigest()]
        keep = max(d for d in same if d is not None)
        assert (r.keep_id, r.group_size) == (keep, len(same))
        assert doc == 2 or r.kept == (doc == keep)
    assert op4_exact_dedup(docs.limit(0)).collect() == []


def test_later_batches(spark):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "a"), (10, "c"), (11, "C")], "doc_id long, text string")
    assert {r.doc_id for r in deduplicate(one, index).collect() if r.kept} == {2, 3}
    got = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(two, index).collect()}
    assert got == {9: (3, False), 10: (11, False), 11: (11, True)}
    assert index.table().count() == 3
    assert not any(r.kept for r in deduplicate(two, index).collect())
    plan = index.unseen(two.selectExpr("unhex(sha2(text, 256)) AS digest", "doc_id AS keep_id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    index.drop()


def test_the_query_goes_through_the_index(spark, monkeypatch):
    plans, kept = [], DigestIndex.append
    monkeypatch.setattr(DigestIndex, "append", lambda self, new, batch: (plans.append(new._jdf.queryExecution().executedPlan().toString()), kept(self, new, batch)))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = op4_exact_dedup(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert got.count() == docs.count()
    (plan,) = plans
    join = plan[plan.index("SortMergeJoin") :]
    left, index = join.split("FileScan parquet spark_catalog.default.digest_index_", 1)
    assert "LeftAnti" in join and "Bucketed: true" in index
    # One exchange, of the new groups; none between the join and the index.
    assert len(re.findall(r"Exchange hashpartitioning\(digest", left)) == 1 and "Exchange" not in left[left.index("FileScan") if "FileScan" in left else 0 :]


def test_a_batch_run_again_gets_the_same(spark):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (None, "c"), (None, "c")], "doc_id long, text string")
    first = sorted(map(str, deduplicate(docs, index, "one").collect()))
    assert first == sorted(map(str, deduplicate(docs, index, "one").collect())) and index.table().count() == 3
    assert Counter(r.doc_id for r in digests.kept_rows(docs, index, "one").collect()) == Counter([2, 3, None])
    assert digests.kept_rows(docs, index, "two").count() == 0
    index.drop()


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(6000)] + [(None, "same")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op4_exact_dedup(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 4001
    assert {(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id in (None, 0, 5997)} == {(5997, 4000, False), (5997, 4000, True)}
