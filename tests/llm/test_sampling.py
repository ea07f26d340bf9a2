import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxelloom.llm.sampling import RUN, SAMPLES, fingerprints, op7_fingerprints, signatures


def words(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)


def jaccard(a, b):
    a, b = words(a), words(b)
    return 1.0 if not a and not b else sum((a & b).values()) / sum((a | b).values())


def edited(rows):
    rows = sorted(rows)
    out = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        out[doc] = (text, text[: len(text) - half] + after[:half], after)
    return out


@pytest.mark.parametrize("samples", [SAMPLES, 128])
def test_against_exact_similarity(spark, samples):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = edited([(r.doc_id, r.text) for r in docs.collect()])
    got = fingerprints(docs, samples=samples).collect()
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    errors = []
    for r in got:
        text, other, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, other), r.near_next - jaccard(text, after)]
    # The standard deviation of a share of n samples is half of 1 / sqrt(n) at most: 0.072 of 48, 0.044 of 128.
    bound = 0.5 / np.sqrt(samples)
    assert abs(np.mean(errors)) < 0.012 and np.sqrt(np.mean(np.square(errors))) < 1.02 * bound and max(map(abs, errors)) < 4.6 * bound
    by_text = {}
    for r in got:
        assert by_text.setdefault(want[r.doc_id][0], r.fingerprint) == r.fingerprint


def test_weights_count(spark):
    rows = [(i, "a " * (i + 1) + "b c d") for i in range(0, 40)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), samples=64).collect()}
    errors = [got[i].near_next - (i + 4) / (i + 5) for i in range(39)]
    assert abs(np.mean(errors)) < 0.03 and got[39].next_id == 0


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "é" * 5, None), (4, " \n", None), (6, "a b " * 30_000, "y"), (7, "one two three", None), (7, "one two three", None), (None, "last\tone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = op7_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    distinct = {(d if d is not None else 99, t or "") for d, t, _ in rows}
    want = edited(list(distinct))
    for d, r in by.items():
        text, other, after = want[d if d is not None else 99]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
    assert by[1].near_edited == by[1].near_next == 1.0 and by[2].near_next == 0.0 and by[None].next_id == 1
    assert by[1].fingerprint == by[4].fingerprint == ""
    assert op7_fingerprints(docs.limit(0)).collect() == []
    assert [r.near_next for r in op7_fingerprints(docs.filter("doc_id = 6")).collect()] == [1.0]


def test_terms_of_both_texts_are_ranked_once(spark):
    """One rank a sample, and the signatures that the two texts have by themselves."""
    rows = [(1, "a b b c", "d e", "f b"), (2, "x y", "", "x"), (3, "", "p q q", ""), (4, "", "u v", "v u u"), (5, " ", "", ""), (6, "m n n", "n", "n")]
    docs = spark.createDataFrame(rows, "id long, start string, one string, two string")
    start, one, two = (F.concat(F.lit(" "), F.col(c)) for c in ("start", "one", "two"))
    found = signatures(docs, ["id"], [(start, True, True), (one, True, False), (two, False, True)], 8)
    alone = [signatures(docs, ["id"], [(F.concat(start, end), True, False)], 8).select("id", "fingerprint") for end in (one, two)]
    want = [{r.id: r.fingerprint for r in d.collect()} for d in alone]
    none = bytearray()
    got = {r.id: r for r in found.collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    for i, r in got.items():
        assert (r.fingerprint, r.edited_fingerprint) == tuple(w.get(i, none) for w in want)
    assert found._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.Floor\"") == 8


def test_no_python(spark):
    plan = op7_fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_copies_and_the_largest_id(spark):
    rows = [(1, "one text")] * (2 * RUN + 3) + [((1 << 63) - 1, "last named"), (None, "nameless")]
    got = Counter((r.doc_id, r.next_id) for r in op7_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, (1 << 63) - 1): 2 * RUN + 3, ((1 << 63) - 1, None): 1, (None, 1): 1} or got == {(1, None): 2 * RUN + 3, (None, (1 << 63) - 1): 1, ((1 << 63) - 1, 1): 1}
