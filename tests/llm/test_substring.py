import hashlib

import pytest

from voxelloom.llm.substring import op5_substring_dedup, remove_repeated_words

SF = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, window):
    first = {}
    words = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        words[doc] = w
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("window", [50, 7, 1])
def test_against_brute_force(spark, window):
    docs = spark.read.parquet(SF)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], window)
    assert sum(x[1] for x in want.values()) > 0
    assert result(remove_repeated_words(docs, window)) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    part = " ".join(f"w{i}" for i in range(100, 170))
    rows = [(3, long, "x"), (5, part + " tail", None), (4, "\t" + part, None), (7, None, None), (8, "", None), (9, " \n ", "y"), (2, "a b c", None), (None, part, None), (5, part, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in op5_substring_dedup(docs).collect())
    assert got == [(2, 2, 0), (3, 5000, 0), (4, 70, 70), (5, 70, 70), (5, 71, 70), (7, 0, 0), (8, 0, 0), (9, 0, 0), (99, 70, 70)]
    assert op5_substring_dedup(docs.limit(0)).collect() == []


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
    assert result(op5_substring_dedup(docs)) == brute(rows, 50)


def test_null_ids_and_one_text_in_a_third_of_all_rows(spark):
    same = " ".join(f"s{i}" for i in range(70))
    rows = [(i, same) for i in range(300)] + [(None, f"{same} n{i}") for i in range(300)] + [(1000 + i, " ".join(f"o{i}y{j}" for j in range(60))) for i in range(300)]
    got = op5_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 900 and sum(r.n_removed == 0 for r in got) == 301
    assert sum(r.doc_id is None and r.n_removed >= 70 for r in got) == 300
