import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm.runs import found_runs, islands, lag_counts, op13_periodic_runs, word_runs

SF = "/root/testdata/sf0.001/documents.parquet"


def brute(words, least=24, exponent=3):
    """All maximal stretches of each lag; one counts if no smaller lag is a period of it."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    return np.unique(np.array(words), return_inverse=True)[1].astype(np.int32)


def stretches(rng, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            unit = [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 12, 20]))]
            times = rng.uniform(1, 7)
            out += (unit * 8)[: int(len(unit) * times)]
        else:
            out += [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(20))]
    return out[:n]


def test_runs_against_brute_force():
    rng = random.Random(3)
    some = 0
    for _ in range(250):
        words = stretches(rng, rng.choice([0, 1, 23, 24, 30, 60, 150, 300]))
        for least, exponent in ((24, 3), (6, 2)) if len(words) < 100 else ((24, 3),):
            want = brute(words, least, exponent)
            some += len(want)
            assert found_runs(np.array(words, np.int32), least, exponent) == want
    assert some > 300


def test_runs_of_few_words_and_of_nested_periods():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    for words in ([0] * 500, [0, 1] * 200, b[:400], ([0] * 30 + [1]) * 9, ([0, 1] * 20 + [2]) * 5 + [0] * 40):
        assert found_runs(np.array(words, np.int32)) == brute(words)


def test_lags_of_frequent_and_rare_words():
    rng = np.random.default_rng(1)
    words = np.where(rng.random(3000) < 0.6, rng.integers(0, 2, 3000), rng.integers(2, 400, 3000))
    got = lag_counts(words, 1000)
    assert got[0] == 0 and got[1:].tolist() == [int((words[:-q] == words[q:]).sum()) for q in range(1, 1001)]


def test_long_texts_of_one_and_of_two_words():
    assert found_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 60_000).astype(np.int32)
    words[20_000:50_000] = np.resize(words[20_000:27_001], 30_000)
    assert any(q == 7001 and s <= 20_000 and s + n >= 50_000 for s, n, q in found_runs(words))
    assert islands(words, 7001, 20_000)


def expected(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(numbered(words).tolist() if words else [])
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(kept)))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(SF).filter(F.length("text") < 6000)
    want = {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in op13_periodic_runs(docs).collect()}
    assert got == want and sum(x[0] for x in want.values()) > 5


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (None, "a b " * 20, None), (None, "a b " * 20, None), (4, "a " * 30, None), (4, "é à\tü\n" * 9 + "z", None), (5, "w " * 200_000 + "v", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed_text) for r in word_runs(docs).collect()}
    assert got == {(1, 0): ([], ""), (2, 0): ([], ""), (3, 0): ([], ""), (None, 40): ([(0, 40, 2)], "a b"), (4, 30): ([(0, 30, 1)], "a"), (4, 28): ([(0, 27, 3)], "é à ü z"), (5, 200_001): ([(0, 200_000, 1)], "w v")}
    assert op13_periodic_runs(docs).count() == 8 and op13_periodic_runs(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["a b c " * 8 + "a", "x " + "a b c " * 8])
def test_repeats_are_taken_out(spark, text):
    row = word_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.collapsed_text.split() == (["x"] if text[0] == "x" else []) + ["a", "b", "c"]
