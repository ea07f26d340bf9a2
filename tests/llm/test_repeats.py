import hashlib

import pytest

from voxelloom.llm.repeats import HOT, op2_suffix_array_dedup, remove_repeated_bytes

SF = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, length):
    first, texts = {}, {}
    for doc, text in rows:
        b = texts[doc] = (text or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, doc), doc)
    out = {}
    for doc, b in texts.items():
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize(("length", "hot"), [(50, HOT), (50, 3), (50, 40), (12, HOT), (12, 9)])
def test_against_brute_force(spark, length, hot):
    docs = spark.read.parquet(SF)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], length)
    assert sum(x[1] for x in want.values()) > 0
    assert result(remove_repeated_bytes(docs, length, hot)) == want


def test_runs_and_periods(spark):
    rows = [(1, "a" * 200), (2, "b" + "a" * 120 + "c"), (3, "ab" * 100), (4, "x" + "ab" * 60), (5, "\x00" * 80), (6, "é" + "\x00" * 60), (7, "é" * 40), (8, "ü" + "é" * 30), (9, "=" * 49), (10, "=" * 49), (11, "=" * 50), (12, "=" * 51)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeated_bytes(docs)) == brute(rows, 50)


def test_odd_rows(spark):
    long = "".join(f"word{i} " for i in range(9000))
    part = long[1000:1200]
    rows = [(3, long, "x"), (5, part + "tail", None), (4, part, None), (7, None, None), (8, "", None), (None, part, None), (5, part, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_removed) for r in op2_suffix_array_dedup(docs).collect())
    assert got == [(3, len(long), 0), (4, 200, 200), (5, 200, 200), (5, 204, 200), (7, 0, 0), (8, 0, 0), (99, 200, 200)]
    assert op2_suffix_array_dedup(docs.limit(0)).collect() == []


def test_structured_words_and_the_largest_id(spark):
    def thue_morse(k):
        one, other = "a", "b"
        for _ in range(k):
            one, other = one + other, other + one
        return one, other

    rows = []
    for k in range(8, 13):
        one, other = thue_morse(k)
        frame = " ".join(f"w{k}x{i}" for i in range(40))
        rows += [(10 * k, f"{frame} {one} {frame}"), (10 * k + 1, f"{frame} {other} {frame}"), (10 * k + 2, f"{frame} {one} {frame}")]
    rows += [((1 << 63) - 1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op2_suffix_array_dedup(docs)) == brute(rows, 50)


def test_null_ids_and_one_text_in_a_third_of_all_rows(spark):
    same = " ".join(f"s{i}" for i in range(70))
    rows = [(i, same) for i in range(300)] + [(None, f"{same} n{i}") for i in range(300)] + [(1000 + i, " ".join(f"o{i}y{j}" for j in range(60))) for i in range(300)]
    got = op2_suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 900 and sum(r.n_removed == 0 for r in got) == 301
    assert sum(r.doc_id is None and r.n_removed >= 70 for r in got) == 300
